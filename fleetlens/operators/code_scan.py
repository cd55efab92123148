"""Models, routes and components declared in source files.

Every scanner turns one file into an array of facts with regular expressions
that run in the JVM.  A file is read once per kind of fact and nothing is
shuffled: array -> explode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import values as V
from fleetlens.functions.regexkit import let, match_sql, match_structs, newlines, once, rx, sql_text
from fleetlens.functions.text import constant_map
from fleetlens.operators.python_scan import python_facts

FIELD_TYPE = "struct<name:string,type:string,confidence:string,note:string,classification_hint:string>"
MODEL_TYPE = f"struct<name:string,line:int,orm:string,fields:array<{FIELD_TYPE}>,confidence:string>"
ROUTE_TYPE = "struct<route:string,method:string,handler:string,line:int,framework:string,confidence:string>"
COMPONENT_TYPE = (
    "struct<name:string,line:int,type:string,public_methods:array<string>,dependencies:array<string>,confidence:string,note:string>"
)
TYPES = {"models": MODEL_TYPE, "routes": ROUTE_TYPE, "components": COMPONENT_TYPE}

TEXT = "content"
LANGUAGE_ORDER = ["python", "typescript", "javascript", "ruby", "go", "java", "prisma"]


def _no_fields() -> Column:
    return F.array().cast(f"array<{FIELD_TYPE}>")


def _field(name: Column, kind: Column, confidence: str = "high") -> Column:
    return F.struct(name, kind, F.lit(confidence), F.lit(None).cast("string"), F.lit(None).cast("string")).cast(FIELD_TYPE)


def _model(name: Column, line: Column, orm: str | Column, confidence: str, fields: Column | None = None) -> Column:
    orm = F.lit(orm) if isinstance(orm, str) else orm
    return F.struct(name, line, orm, _no_fields() if fields is None else fields, F.lit(confidence)).cast(MODEL_TYPE)


def _library(name: Column, line: Column, confidence: str, note: str) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(name, line, F.lit("library"), none, none, F.lit(confidence), F.lit(note)).cast(COMPONENT_TYPE)


def _each_match(pattern: str, groups: tuple[int, ...], values: list[str], kind: str) -> Callable[[Column], Column]:
    """Every match ``m`` as one fact; the values are expression texts.

    Whole scanners as one text are parsed in one call to the JVM.
    """
    sql = f"transform({match_sql(TEXT, pattern, groups)}, m -> CAST(struct({', '.join(values)}) AS {kind}))"
    return lambda text: F.expr(sql)


def _named_models(pattern: str, orm: str, confidence: str = "high") -> Callable[[Column], Column]:
    fields = f"CAST(array() AS array<{FIELD_TYPE}>)"
    return _each_match(rx(pattern), (1,), ["m.g1", "m.line", sql_text(orm), fields, sql_text(confidence)], MODEL_TYPE)


def _named_routes(pattern: str, method: str, handler: str, framework: str) -> Callable[[Column], Column]:
    """Routes of a pattern with method and path as its groups."""
    at = f"concat({sql_text(handler + '@')}, CAST(m.line AS STRING))"
    return _each_match(pattern, (1, 2), ["m.g2", method, at, "m.line", sql_text(framework), "'high'"], ROUTE_TYPE)


def _names(structs: Column) -> Column:
    return F.transform(structs, lambda m: m["g1"])


def _after_first(items: Column) -> Column:
    return let(items, lambda x: F.slice(x, F.lit(2), F.size(x)))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+", -1), lambda w: w != "")


# --- TypeScript, JavaScript, Prisma ---------------------------------------


def typeorm_models(text: Column, window: int | None = None) -> Column:
    """Entities with the columns of their own class.

    The entities cut a text into stretches, in one pass.  An entity's columns
    lie in its stretch, before the next ``@Entity(`` of whatever form and
    before the class after its own; with ``window`` only that many characters
    from the entity on are looked at.  Its name is the next class, if need be
    one of a later stretch.
    """
    column, entity = rx(V.TYPEORM_COLUMN), rx(V.TYPEORM_ENTITY)
    empty = F.array().cast(f"array<{MODEL_TYPE}>")

    def own(e: Column, stretch: Column) -> Column:
        near = stretch if window is None else F.substring(stretch, F.lit(1), F.greatest(F.lit(0), F.lit(window) - (e["stop"] - e["start"])))
        return F.array_join(F.slice(F.split(F.substring_index(near, "@Entity(", 1), rx(V.CLASS_LINE, multiline=True), -1), 1, 2), "\n")

    def fields(body: Column) -> Column:
        pairs = F.arrays_zip(
            F.regexp_extract_all(body, F.lit(column), F.lit(2)), F.regexp_extract_all(body, F.lit(column), F.lit(1))
        ).cast("array<struct<name:string,kind:string>>")
        return F.transform(pairs, lambda p: _field(p["name"], F.when(p["kind"] == "", "unknown").otherwise(p["kind"])))

    def build(cut: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            later = F.get(F.filter(F.slice(cut, i + 2, F.size(cut)), lambda d: d["name"] != ""), F.lit(0))["name"]
            table = F.when(c["e"]["g1"] != "", c["e"]["g1"])
            name = F.when(c["name"] != "", c["name"]).otherwise(F.coalesce(later, table, F.lit("Unknown")))
            return _model(name, c["e"]["line"], "typeorm", "high", let(c["body"], fields))

        return F.transform(cut, one)

    stretches = _after_first(F.split(text, entity, -1))
    cut = F.zip_with(
        match_structs(TEXT, entity),
        stretches,
        lambda e, s: F.struct(e.alias("e"), F.regexp_extract(s, rx(V.NEXT_CLASS), 1).alias("name"), own(e, s).alias("body")),
    )
    return F.when(text.rlike(entity), let(cut, build)).otherwise(empty)


def sequelize_models(text: Column) -> Column:
    return F.concat(
        _named_models(V.SEQUELIZE_DEFINE, "sequelize")(text), _named_models(V.SEQUELIZE_INIT, "sequelize", "medium")(text)
    )


_NO_NAMES = "CAST(array() AS array<string>)"
ts_classes = _each_match(
    rx(V.TS_CLASS), (1,), ["m.g1", "m.line", "'library'", _NO_NAMES, _NO_NAMES, "'medium'", sql_text(V.NOTE_TS_CLASS)], COMPONENT_TYPE
)


def module_exports(text: Column) -> Column:
    """Exported names that are no class of the file, each once."""

    def build(exports: Column) -> Column:
        names = _names(exports)
        fresh = let(
            F.struct(names.alias("exported"), _names(match_structs(TEXT, rx(V.TS_CLASS))).alias("classes")),
            lambda known: F.filter(
                exports,
                lambda e, i: ~F.array_contains(known["classes"], e["g1"])
                & (F.array_position(known["exported"], e["g1"]) == i + 1),
            ),
        )
        return F.transform(fresh, lambda m: _library(m["g1"], m["line"], "medium", V.NOTE_MODULE_EXPORTS))

    empty = F.array().cast(f"array<{COMPONENT_TYPE}>")
    return F.when(text.contains("module.exports"), let(match_structs(TEXT, rx(V.MODULE_EXPORTS)), build)).otherwise(empty)


def prisma_models(text: Column) -> Column:
    """``model X { .. }`` blocks; the line is that of the first text "model X"."""

    def body_fields(block: Column) -> Column:
        body = F.substring_index(F.regexp_replace(block, r"^[^{]*\{", ""), "}", 1)
        rows = F.transform(F.split(body, "\n", -1), _words)
        kept = F.filter(rows, lambda w: (F.size(w) >= 2) & ~F.get(w, F.lit(0)).startswith("//") & ~F.get(w, F.lit(0)).startswith("@"))
        return F.transform(kept, lambda w: _field(F.get(w, F.lit(0)), F.regexp_replace(F.get(w, F.lit(1)), r"[?\[\]]+$", "")))

    def build(blocks: Column) -> Column:
        head = rx(r"^(\w+)\s*\{")

        def one(b: Column) -> Column:
            name = F.regexp_extract(b["block"], head, 1)
            first = F.get(F.filter(blocks, lambda other: other["block"].startswith(name)), F.lit(0))["line"]
            return _model(name, first, "prisma", "high", body_fields(b["block"]))

        return F.transform(F.filter(blocks, lambda b: b["block"].rlike(head)), one)

    empty = F.array().cast(f"array<{MODEL_TYPE}>")
    heads = match_structs(TEXT, "model ", ())
    tails = _after_first(F.split(text, "model ", -1))
    blocks = F.zip_with(heads, tails, lambda m, t: F.struct(m["line"].alias("line"), t.alias("block")))
    return F.when(text.contains("model "), let(blocks, build)).otherwise(empty)


# --- Ruby ------------------------------------------------------------------


def rails_routes(text: Column) -> Column:
    method = "CASE WHEN upper(m.g1) IN ('RESOURCES', 'RESOURCE') THEN 'CRUD' ELSE upper(m.g1) END"
    found = _named_routes(rx(V.RAILS_ROUTE, ignore_case=True), method, "routes", "rails")(text)
    base = F.substring_index(F.col("path"), "/", -1)
    is_routes = F.lower(base).contains("routes") | F.col("path").contains("config")
    return F.when(is_routes, found).otherwise(F.array().cast(f"array<{ROUTE_TYPE}>"))


def ruby_classes(text: Column) -> Column:
    models = F.concat(_names(match_structs(TEXT, rx(V.ACTIVE_RECORD_CLASS))), _names(match_structs(TEXT, rx(V.SEQUEL_CLASS))))
    other = let(
        models, lambda known: F.filter(match_structs(TEXT, rx(V.RUBY_CLASS)), lambda m: ~F.array_contains(known, m["g1"]))
    )
    return F.transform(other, lambda m: _library(m["g1"], m["line"], "medium", V.NOTE_RUBY_CLASS))


# --- Go ----------------------------------------------------------------------


def _go_structs(text: Column) -> Column:
    """Struct heads with the body up to the first closing brace."""
    head = rx(V.GO_STRUCT)
    tails = _after_first(F.split(text, head, -1))

    def with_body(m: Column, tail: Column) -> Column:
        rest = F.substring(text, m["stop"] + 1, F.length(text))
        body = (
            F.when(tail.contains("}"), F.substring_index(tail, "}", 1))
            .when(rest.contains("}"), F.substring_index(rest, "}", 1))
            .otherwise("")
        )
        return F.struct(m["line"].alias("line"), m["g1"].alias("g1"), body.alias("body"))

    return F.zip_with(match_structs(TEXT, head), F.when(text.rlike(head), tails).otherwise(F.array().cast("array<string>")), with_body)


def _go_orm(body: Column) -> Column:
    return F.when(body.rlike(rx(V.GORM_TAG)), "gorm").when(body.rlike(rx(V.SQLX_TAG)), "sqlx")


def go_models(text: Column) -> Column:
    def fields(body: Column) -> Column:
        rows = F.transform(F.split(body, "\n", -1), _words)
        kept = F.filter(rows, lambda w: (F.size(w) >= 2) & F.get(w, F.lit(0)).rlike(r"^\p{Lu}"))
        return F.transform(kept, lambda w: _field(F.get(w, F.lit(0)), F.get(w, F.lit(1))))

    tagged = F.filter(_go_structs(text), lambda s: _go_orm(s["body"]).isNotNull())
    found = F.transform(tagged, lambda s: _model(s["g1"], s["line"], _go_orm(s["body"]), "high", fields(s["body"])))
    empty = F.array().cast(f"array<{MODEL_TYPE}>")
    return F.when(text.rlike(rx(V.GORM_TAG)) | text.rlike(rx(V.SQLX_TAG)), found).otherwise(empty)


GO_METHOD = "CASE WHEN upper(m.g1) IN ('HANDLE', 'HANDLEFUNC') THEN 'ANY' ELSE upper(m.g1) END"


def go_struct_components(text: Column) -> Column:
    """Exported structs whose name no model of the file has."""
    models = F.transform(go_models(text), lambda m: m["name"])
    other = let(
        models,
        lambda known: F.filter(
            match_structs(TEXT, rx(V.GO_STRUCT)), lambda m: m["g1"].rlike(r"^\p{Lu}") & ~F.array_contains(known, m["g1"])
        ),
    )
    return F.transform(other, lambda m: _library(m["g1"], m["line"], "low", V.NOTE_GO_STRUCT))


# --- Java --------------------------------------------------------------------


def jpa_models(text: Column) -> Column:
    """The first class of a file that mentions an entity annotation."""
    column = rx(V.JPA_COLUMN)
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(column), F.lit(3)), F.regexp_extract_all(text, F.lit(column), F.lit(2))
    ).cast("array<struct<name:string,kind:string>>")
    fields = F.transform(pairs, lambda p: _field(p["name"], F.lower(p["kind"])))
    first = F.slice(match_structs(TEXT, rx(V.JAVA_CLASS)), 1, 1)
    empty = F.array().cast(f"array<{MODEL_TYPE}>")
    found = F.transform(first, lambda m: _model(m["g1"], m["line"], "jpa", "high", fields))
    return F.when(text.contains(V.JPA_ENTITY), found).otherwise(empty)


def java_class_components(text: Column) -> Column:
    def build(classes: Column) -> Column:
        entity = F.when(text.contains(V.JPA_ENTITY), F.get(classes, F.lit(0))["g1"])
        other = F.filter(classes, lambda m: ~F.equal_null(m["g1"], entity))
        return F.transform(other, lambda m: _library(m["g1"], m["line"], "low", V.NOTE_JAVA_CLASS))

    return let(match_structs(TEXT, rx(V.JAVA_CLASS)), build)


# --- registry and drivers ------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    kind: str
    languages: tuple[str, ...]
    build: Callable[[Column], Column]


_TSJS = ("typescript", "javascript")
SPRING_METHOD = "CASE m.g1 " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in V.SPRING_METHOD.items()) + " END"

# in the order their results appear within a file
SCANS: dict[str, Scan] = {
    "ts_typeorm_models": Scan("models", _TSJS, typeorm_models),
    "ts_sequelize_models": Scan("models", _TSJS, sequelize_models),
    "ts_mongoose_models": Scan("models", _TSJS, _named_models(V.MONGOOSE_MODEL, "mongoose")),
    "ts_drizzle_models": Scan("models", _TSJS, _named_models(V.DRIZZLE_TABLE, "drizzle")),
    "ts_express_routes": Scan("routes", _TSJS, _named_routes(rx(V.EXPRESS_ROUTE, ignore_case=True), "upper(m.g1)", "anonymous", "express")),
    "ts_classes": Scan("components", _TSJS, ts_classes),
    "prisma_models": Scan("models", ("prisma",), prisma_models),
    "js_module_exports": Scan("components", ("javascript",), module_exports),
    "rb_activerecord_models": Scan("models", ("ruby",), _named_models(V.ACTIVE_RECORD_CLASS, "activerecord")),
    "rb_sequel_models": Scan("models", ("ruby",), _named_models(V.SEQUEL_CLASS, "sequel")),
    "rb_rails_routes": Scan("routes", ("ruby",), rails_routes),
    "rb_classes": Scan("components", ("ruby",), ruby_classes),
    "go_models": Scan("models", ("go",), go_models),
    "go_http_routes": Scan("routes", ("go",), _named_routes(rx(V.GO_HTTP_ROUTE, ignore_case=True), GO_METHOD, "handler", "net/http")),
    "go_gin_routes": Scan("routes", ("go",), _named_routes(rx(V.GIN_ROUTE), "upper(m.g1)", "handler", "gin")),
    "go_structs": Scan("components", ("go",), go_struct_components),
    "java_jpa_models": Scan("models", ("java",), jpa_models),
    "java_spring_routes": Scan("routes", ("java",), _named_routes(rx(V.SPRING_MAPPING), SPRING_METHOD, "handler", "spring")),
    "java_classes": Scan("components", ("java",), java_class_components),
}


def _native_array(kind: str, keys: list[str] | None = None) -> tuple[Column, list[str]]:
    """Facts of one kind as an array column, and the languages it covers."""
    chosen = {k: s for k, s in SCANS.items() if s.kind == kind and (keys is None or k in keys)}
    languages = sorted({lang for s in chosen.values() for lang in s.languages}, key=LANGUAGE_ORDER.index)
    # languages with the same scanners share one branch
    branches: dict[tuple[str, ...], list[str]] = {}
    for lang in languages:
        branches.setdefault(tuple(k for k, s in chosen.items() if lang in s.languages), []).append(lang)
    column = None
    for scanners, langs in branches.items():
        parts = [chosen[k].build(F.col(TEXT)) for k in scanners]
        joined = F.concat(*parts) if len(parts) > 1 else parts[0]
        hit = F.col("lang").isin(langs)
        column = F.when(hit, joined) if column is None else column.when(hit, joined)
    return column, languages


def _python_array(kind: str, parsed: Column) -> Column:
    facts = parsed[kind]
    if kind == "models":
        def one(m: Column) -> Column:
            fields = F.transform(m["fields"], lambda f: _field(f["name"], f["type"]))
            return F.struct(m["name"], m["line"], m["orm"], fields, m["confidence"]).cast(MODEL_TYPE)
    elif kind == "routes":
        def one(r: Column) -> Column:
            return F.struct(r["path"], r["method"], r["handler"], r["line"], r["framework"], F.lit("high")).cast(ROUTE_TYPE)
    else:
        def one(c: Column) -> Column:
            return F.struct(
                c["name"], c["line"], c["type"], c["public_methods"], c["dependencies"], F.lit("medium"), F.lit(V.NOTE_PY_CLASS)
            ).cast(COMPONENT_TYPE)
    return F.transform(facts, one)


def files_with(corpus: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """The corpus plus a column ``facts`` with one kind of fact per file."""
    frames = []
    native = keys is None or any(k in SCANS for k in keys)
    if native:
        column, languages = _native_array(kind, keys)
        frames.append(once(corpus.where(F.col("lang").isin(languages)), "facts", column))
    if keys is None or "python" in keys:
        frames.append(once(corpus.where(F.col("lang") == "python"), "facts", _python_array(kind, python_facts(F.col("content")))))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def with_syntax(corpus: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``corpus`` with the column ``py``: the facts of a Python file's one parse; other files are not sent."""
    here = F.col("lang") == "python" if wanted is None else (F.col("lang") == "python") & wanted
    return once(corpus, "py", python_facts(F.when(here, F.col(TEXT))))


def fact_array(kind: str) -> Column:
    """Facts of one kind of a file of any language as an array; needs ``with_syntax``."""
    column, _ = _native_array(kind)
    none = F.array().cast(f"array<{TYPES[kind]}>")
    return F.coalesce(column.when(F.col("lang") == "python", _python_array(kind, F.col("py"))), none)


def language_rank() -> Column:
    return constant_map({lang: str(i) for i, lang in enumerate(LANGUAGE_ORDER)})[F.col("lang")].cast("int")


def scan(corpus: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """One row per fact, with ``ord`` giving the order of discovery."""
    rows = files_with(corpus, kind, keys).select(
        "project", "path", language_rank().alias("lang_rank"), F.posexplode("facts").alias("pos", "fact")
    )
    return rows.select(
        "project",
        F.col("path").alias("source_file"),
        "fact.*",
        F.struct(F.col("lang_rank").alias("lang"), "path", "pos").alias("ord"),
    )


def models(corpus: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scan(corpus, "models", keys)


def routes(corpus: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scan(corpus, "routes", keys)


def components(corpus: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scan(corpus, "components", keys)

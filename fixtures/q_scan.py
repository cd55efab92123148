"""Queries over source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.registry import fields_text, joined, query
from fleetlens import values as V
from fleetlens.operators import code_scan as code, discovery, line_scan
from fleetlens.sources import corpus as C

W = r"[\p{L}\p{N}_]"
Q = "['\"]"


def sql_list(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def sql_rows(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- corpus ---------------------------------------------------------------------


@query("corpus_read")
def _(t):
    return C.corpus_read(t.spark, t.sf_dir, project="data").select("project", "path", "lang", "bytes")


@query(
    "corpus_language",
    f"""WITH ext(e, lang) AS ({sql_rows(V.EXTENSION_LANGUAGE.items())})
SELECT c.project, c.path, ext.lang FROM code_corpus c JOIN ext ON ends_with(c.path, ext.e)
WHERE regexp_extract(c.path, '[.][^./]+$') = ext.e""",
)
def _(t):
    return C.corpus_language(t.code_corpus.select("project", "path"))


@query(
    "corpus_exclude",
    f"""SELECT project, path FROM code_corpus
WHERE NOT list_has_any(string_split(path, '/'), [{sql_list(V.SOURCE_EXCLUDE)}])""",
)
def _(t):
    return C.corpus_exclude(t.code_corpus.select("project", "path"))


EVIDENCE_OK = f"""(NOT list_has_any(string_split(path, '/'), [{sql_list(V.EVIDENCE_EXCLUDED_PARTS)}])
  AND NOT starts_with(path, 'tests/compliance/') AND NOT starts_with(path, 'compliance/controls/'))"""


@query(
    "evidence_file_select",
    f"""SELECT project, path FROM code_corpus WHERE {EVIDENCE_OK}
  AND NOT (path LIKE '%.rb' OR path LIKE 'docs/%') AND (path LIKE 'src/m_/%' OR path LIKE '%/config/%' OR path LIKE 'docs/%' OR path LIKE 'services/%/src/%')""",
)
def _(t):
    return C.evidence_file_select(
        t.code_corpus.select("project", "path"),
        include=["src/m?/*", "*/config/*", "docs/*", "services/*/src/**"],
        exclude=["*.rb", "docs/*"],
    )


@query(
    "binary_filter",
    """SELECT project, path FROM code_corpus WHERE length(path) % 3 = 2""",
)
def _(t):
    # a NUL in front, one far behind, or none
    n = F.length("path") % 3
    raw = F.when(n == 0, F.concat(F.lit("a\0"), "content")).when(
        n == 1, F.concat(F.repeat(F.lit("x"), 8192), F.lit("\0"), "content")
    ).otherwise(F.col("content"))
    return C.binary_filter(t.code_corpus.select("project", "path", raw.cast("binary").alias("raw"))).select("project", "path")


@query("corpus_lines", "SELECT project, path, CAST(line AS INTEGER) AS line, text FROM lines")
def _(t):
    return C.corpus_lines(t.code_corpus)


# --- line scanners ------------------------------------------------------------------

KEYS_SQL = f"""SELECT project, path, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(text, '{V.PACT_KEY_FORMAT}')) AS key, 'high' AS confidence FROM lines"""


@query("scan_pact_keys", KEYS_SQL)
def _(t):
    return line_scan.scan_pact_keys(t.code_corpus).drop("pos")


def _env_sql() -> str:
    parts = []
    for p in V.ENV_ACCESS:
        parts.append(
            f"SELECT project, path, line, unnest(regexp_extract_all(text, {sq(p.replace(chr(92) + 'w', W))}, 1)) AS name FROM lines"
        )
    return " UNION ALL ".join(parts)


ENV_SQL = f"SELECT project, path, CAST(line AS INTEGER) AS line, name FROM ({_env_sql()}) e"
ENV_FIRST_SQL = f"SELECT project, path, name, min(line) AS line FROM ({ENV_SQL}) f GROUP BY 1, 2, 3"
_HINT_SQL = "CASE " + " ".join(
    f"WHEN starts_with(upper(name), '{p.rstrip('?').removesuffix('S') if p.endswith('?') else p}') THEN '{b}'" for p, b in V.ENV_BACKENDS
) + " END"
ENV_VARS_SQL = f"SELECT * FROM (SELECT project, path, name, line, {_HINT_SQL} AS backend_hint, 'medium' AS confidence FROM ({ENV_FIRST_SQL}) g) h WHERE backend_hint IS NOT NULL"


@query("scan_env_vars", ENV_SQL)
def _(t):
    return line_scan.scan_env_vars(t.code_corpus).drop("pos")


@query("env_first_per_file", ENV_FIRST_SQL)
def _(t):
    return line_scan.env_first_per_file(t.code_corpus).drop("pos")


@query("env_backend_hint", ENV_VARS_SQL)
def _(t):
    return line_scan.env_vars(t.code_corpus).drop("pos")


_TOKENS = f"""tok AS (SELECT project, path, line, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok
  FROM (SELECT project, path, line, regexp_extract_all(text, '{W}+') AS toks FROM lines) l)"""


def _sensitive_sql(terms: str) -> str:
    return f"""WITH {_TOKENS}, terms AS ({terms})
SELECT project, path, CAST(line AS INTEGER) AS line, arg_min(tok, pos) AS field_name, any_value(terms.pattern) AS pattern_matched,
  any_value(terms.tier) AS classification_hint, 'low' AS confidence
FROM tok JOIN terms ON lower(tok.tok) = terms.lookup WHERE regexp_full_match(tok.tok, '[A-Za-z_][A-Za-z0-9_]*')
GROUP BY project, path, line, terms.lookup"""


_TERM_ROWS = [(tier, i, p, term) for i, (tier, ts) in enumerate(V.SENSITIVE_TERMS.items()) for p, term in enumerate(ts)]
SENSITIVE_SQL = _sensitive_sql(
    f"SELECT t.term AS lookup, t.term AS pattern, t.tier FROM ({sql_rows(_TERM_ROWS)}) t(tier, tier_ord, pos, term)"
)
MERGED_SQL = f"""SELECT lower(term) AS lookup, arg_max(term, ord) AS pattern, arg_max(tier, ord) AS tier FROM (
  SELECT tier, term, CAST(tier_ord AS BIGINT) * 1000000000 + pos AS ord FROM ({sql_rows(_TERM_ROWS)}) d(tier, tier_ord, pos, term)
  UNION ALL
  SELECT tier, term, CASE tier WHEN 'PII' THEN 0 WHEN 'FINANCIAL' THEN 1 WHEN 'AUTH' THEN 2 WHEN 'COMPLIANCE' THEN 3 ELSE 4 + tier_ord END::BIGINT * 1000000000 + 1000 + pos
  FROM custom_terms WHERE (tier, term) NOT IN (SELECT tier, term FROM ({sql_rows(_TERM_ROWS)}) d(tier, tier_ord, pos, term))
) u GROUP BY 1"""


@query("scan_sensitive_fields", SENSITIVE_SQL)
def _(t):
    return line_scan.scan_sensitive_fields(t.code_corpus).drop("pos")


@query("sensitive_patterns_merge", MERGED_SQL)
def _(t):
    return line_scan.sensitive_patterns_merge(t.custom_terms)


@query("scan_sensitive_fields_custom", _sensitive_sql(MERGED_SQL))
def _(t):
    return line_scan.scan_sensitive_fields(t.code_corpus, line_scan.sensitive_patterns_merge(t.custom_terms)).drop("pos")


@query(
    "match_line_numbers",
    f"SELECT project, path, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(text, 'class\\s+({W}+)', 1)) AS hit FROM lines",
)
def _(t):
    return line_scan.match_line_numbers(t.code_corpus, V.NEXT_CLASS).drop("pos")


# --- source structure: reference SQL ---------------------------------------------------


def _line_hits(langs: str, pattern: str, groups: tuple[int, ...], columns: str, where: str = "TRUE") -> str:
    """One row per match of a pattern in single lines."""
    pat = sq(pattern.replace(r"\w", W))
    extracts = ", ".join(f"unnest(regexp_extract_all(text, {pat}, {g})) AS g{i + 1}" for i, g in enumerate(groups))
    return f"""SELECT project, path AS source_file, {columns} FROM (
  SELECT project, path, lang, CAST(line AS INTEGER) AS line, text, {extracts} FROM lines WHERE lang IN ({langs})) h WHERE {where}"""


def _models(langs: str, pattern: str, orm: str, confidence: str = "high") -> str:
    return _line_hits(langs, pattern, (1,), f"g1 AS name, line, '{orm}' AS orm, '' AS fields, '{confidence}' AS confidence")


TSJS = "'typescript', 'javascript'"

PY_CLASS = r"^class (\w+)\((Base|db\.Model|models\.Model|BaseModel)\):$"
PY_MODELS_SQL = _line_hits(
    "'python'", PY_CLASS, (1, 2),
    """g1 AS name, line, CASE g2 WHEN 'models.Model' THEN 'django' WHEN 'BaseModel' THEN 'pydantic' ELSE 'sqlalchemy' END AS orm,
  'id:integer,email:string,note:mapped,card_number:str,owner:unknown' AS fields, CASE g2 WHEN 'BaseModel' THEN 'medium' ELSE 'high' END AS confidence""",
)
PY_FIELDS_SQL = f"""SELECT project, source_file, name, unnest(string_split(fields, ',')) AS field FROM ({PY_MODELS_SQL}) m"""
PY_COMPONENTS_SQL = _line_hits(
    "'python'", r"^class ((?:Service|Model)(\d+)).*:$", (1, 2),
    """g1 AS name, line, CASE WHEN g1 LIKE 'Service%' AND CAST(g2 AS INTEGER) % 16 = 0 THEN 'service' ELSE 'library' END AS type,
  CASE WHEN g1 LIKE 'Service%' THEN 'handle' ELSE 'save,load' END AS public_methods,
  CASE WHEN g1 LIKE 'Service%' AND CAST(g2 AS INTEGER) % 16 = 0 THEN concat('store', g2, ',service', g2, ',database') ELSE '' END AS dependencies,
  'medium' AS confidence, 'Class with public methods detected' AS note""",
)
PY_ROUTES_SQL = f"""SELECT a.project, a.path AS source_file, regexp_extract(a.text, '"([^"]*)"', 1) AS route,
  CASE WHEN a.text LIKE '@router.get%' THEN 'GET' ELSE 'ANY' END AS method, regexp_extract(b.text, 'def ({W}+)', 1) AS handler,
  CAST(b.line AS INTEGER) AS line, CASE WHEN a.text LIKE '@router%' THEN 'fastapi' ELSE 'flask' END AS framework, 'high' AS confidence
FROM lines a JOIN lines b ON a.project = b.project AND a.path = b.path AND b.line = a.line + 1
WHERE a.lang = 'python' AND regexp_matches(a.text, '^@(router[.]get|app[.]route)[(]') AND regexp_matches(b.text, '^(async )?def ')"""

_ENTITY = r"@Entity\(\s*(?:['\"](\w+)['\"])?\s*\)".replace(r"\w", W)
_COLUMN = V.TYPEORM_COLUMN.replace(r"\w", W)
TYPEORM_SQL = f"""SELECT project, source_file, coalesce(nullif(regexp_extract(rest, {sq(V.NEXT_CLASS.replace(chr(92) + 'w', W))}, 1), ''),
    nullif(regexp_extract(rest, {sq('^' + _ENTITY)}, 1), ''), 'Unknown') AS name, line, 'typeorm' AS orm,
  coalesce(array_to_string(list_transform(range(1, len(regexp_extract_all(win, {sq(_COLUMN)}, 2)) + 1), lambda i: concat(regexp_extract_all(win, {sq(_COLUMN)}, 2)[i], ':',
    coalesce(nullif(regexp_extract_all(win, {sq(_COLUMN)}, 1)[i], ''), 'unknown'))), ','), '') AS fields, 'high' AS confidence
FROM (
  SELECT project, path AS source_file, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS INTEGER) AS line,
    substr(content, length(head) + 1) AS rest, concat('@Entity(', own) AS win
  FROM (SELECT project, path, content, array_to_string(parts[1:i], '@Entity(') AS head, parts[i + 1] AS own
    FROM (SELECT project, path, content, string_split(content, '@Entity(') AS parts, unnest(range(1, len(string_split(content, '@Entity(')))) AS i
      FROM code_corpus WHERE lang IN ({TSJS})) a) b) c
WHERE regexp_matches(rest, {sq('^' + _ENTITY)})"""
SEQUELIZE_SQL = _models(TSJS, V.SEQUELIZE_DEFINE, "sequelize") + " UNION ALL " + _models(TSJS, V.SEQUELIZE_INIT, "sequelize", "medium")
MONGOOSE_SQL = _models(TSJS, V.MONGOOSE_MODEL, "mongoose")
DRIZZLE_SQL = _models(TSJS, V.DRIZZLE_TABLE, "drizzle")


def _routes(langs: str, pattern: str, method: str, handler: str, framework: str, where: str = "TRUE") -> str:
    return _line_hits(
        langs, pattern, (1, 2),
        f"g2 AS route, {method} AS method, concat('{handler}@', CAST(line AS VARCHAR)) AS handler, line, '{framework}' AS framework, 'high' AS confidence",
        where,
    )


EXPRESS_SQL = _routes(TSJS, "(?i)" + V.EXPRESS_ROUTE, "upper(g1)", "anonymous", "express")


def _library(langs: str, pattern: str, confidence: str, note: str, where: str = "TRUE") -> str:
    return _line_hits(
        langs, pattern, (1,),
        f"g1 AS name, line, 'library' AS type, '' AS public_methods, '' AS dependencies, '{confidence}' AS confidence, {sq(note)} AS note",
        where,
    )


TS_CLASSES_SQL = _library(TSJS, V.TS_CLASS, "medium", V.NOTE_TS_CLASS)
EXPORTS_SQL = f"""SELECT project, source_file, name, min(line) AS line, any_value(type) AS type, '' AS public_methods, '' AS dependencies, 'medium' AS confidence, any_value(note) AS note
FROM ({_library("'javascript'", V.MODULE_EXPORTS, "medium", V.NOTE_MODULE_EXPORTS)}) e
WHERE (project, source_file, name) NOT IN (SELECT (project, source_file, name) FROM ({TS_CLASSES_SQL}) c) GROUP BY 1, 2, 3"""
PRISMA_SQL = _line_hits(
    "'prisma'", r"^model (\w+) \{", (1,),
    "g1 AS name, line, 'prisma' AS orm, CASE WHEN g1 LIKE 'Person%' THEN 'id:Int,email:String,tags:String' ELSE 'id:Int' END AS fields, 'high' AS confidence",
)
RB_MODELS_SQL = _models("'ruby'", V.ACTIVE_RECORD_CLASS, "activerecord") + " UNION ALL " + _models("'ruby'", V.SEQUEL_CLASS, "sequel")
RAILS_SQL = _routes(
    "'ruby'", "(?i)" + V.RAILS_ROUTE, "CASE WHEN upper(g1) LIKE 'RESOURCE%' THEN 'CRUD' ELSE upper(g1) END", "routes", "rails",
    "(lower(regexp_extract(path, '[^/]*$')) LIKE '%routes%' OR path LIKE '%config%')",
)
RB_CLASSES_SQL = f"""SELECT * FROM ({_library("'ruby'", V.RUBY_CLASS, "medium", V.NOTE_RUBY_CLASS)}) c
WHERE (project, source_file, name) NOT IN (SELECT (project, source_file, name) FROM ({RB_MODELS_SQL}) m)"""
GO_MODELS_SQL = _line_hits(
    "'go'", r"^type ((User|Row)\d+) struct \{", (1, 2),
    "g1 AS name, line, CASE g2 WHEN 'User' THEN 'gorm' ELSE 'sqlx' END AS orm, CASE g2 WHEN 'User' THEN 'ID:int,Email:string' ELSE 'Name:string' END AS fields, 'high' AS confidence",
)
GO_HTTP_SQL = _routes("'go'", "(?i)" + V.GO_HTTP_ROUTE, "CASE WHEN upper(g1) LIKE 'HANDLE%' THEN 'ANY' ELSE upper(g1) END", "handler", "net/http")
GIN_SQL = _routes("'go'", V.GIN_ROUTE, "upper(g1)", "handler", "gin")
GO_STRUCTS_SQL = f"""SELECT * FROM ({_library("'go'", V.GO_STRUCT, "low", V.NOTE_GO_STRUCT, "regexp_matches(g1, '^[A-Z]')")}) c
WHERE (project, source_file, name) NOT IN (SELECT (project, source_file, name) FROM ({GO_MODELS_SQL}) m)"""
_JPA = V.JPA_COLUMN.replace(r"\w", W)
JPA_SQL = f"""SELECT project, path AS source_file, first.name, first.line, 'jpa' AS orm,
  coalesce(array_to_string(list_transform(range(1, len(regexp_extract_all(content, {sq(_JPA)}, 3)) + 1), lambda i: concat(regexp_extract_all(content, {sq(_JPA)}, 3)[i], ':', lower(regexp_extract_all(content, {sq(_JPA)}, 2)[i]))), ','), '') AS fields, 'high' AS confidence
FROM code_corpus JOIN (SELECT project AS p, source_file AS f, arg_min(name, line) AS name, min(line) AS line FROM ({_library("'java'", V.JAVA_CLASS, "low", "")}) c GROUP BY 1, 2) first
  ON first.p = project AND first.f = path WHERE contains(content, '@Entity')"""
SPRING_SQL = _routes(
    "'java'", V.SPRING_MAPPING, "CASE g1 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SPRING_METHOD.items()) + " END", "handler", "spring"
)
JAVA_CLASSES_SQL = f"""SELECT * FROM ({_library("'java'", V.JAVA_CLASS, "low", V.NOTE_JAVA_CLASS)}) c
WHERE (project, source_file, name) NOT IN (SELECT (project, source_file, name) FROM ({JPA_SQL}) m)"""

MODELS_SQL = " UNION ALL ".join([PY_MODELS_SQL, TYPEORM_SQL, SEQUELIZE_SQL, MONGOOSE_SQL, DRIZZLE_SQL, PRISMA_SQL, RB_MODELS_SQL, GO_MODELS_SQL, JPA_SQL])
ROUTES_SQL = " UNION ALL ".join([PY_ROUTES_SQL, EXPRESS_SQL, RAILS_SQL, GO_HTTP_SQL, GIN_SQL, SPRING_SQL])
COMPONENTS_SQL = " UNION ALL ".join([PY_COMPONENTS_SQL, TS_CLASSES_SQL, EXPORTS_SQL, RB_CLASSES_SQL, GO_STRUCTS_SQL, JAVA_CLASSES_SQL])


# --- source structure: queries -----------------------------------------------------------


def flat_models(df):
    return df.select("project", "source_file", "name", "line", "orm", fields_text(), "confidence")


def flat_routes(df):
    return df.select("project", "source_file", "route", "method", "handler", "line", "framework", "confidence")


def flat_components(df):
    return df.select("project", "source_file", "name", "line", "type", joined("public_methods"), joined("dependencies"), "confidence", "note")


_FLAT = {"models": flat_models, "routes": flat_routes, "components": flat_components}


def _register(name: str, kind: str, keys: list[str], sql: str) -> None:
    query(name, sql)(lambda t: _FLAT[kind](code.scan(t.code_corpus, kind, keys)))


_register("py_models", "models", ["python"], PY_MODELS_SQL)
_register("py_components", "components", ["python"], PY_COMPONENTS_SQL)
_register("py_routes", "routes", ["python"], PY_ROUTES_SQL)
_register("ts_typeorm_models", "models", ["ts_typeorm_models"], TYPEORM_SQL)
_register("ts_sequelize_models", "models", ["ts_sequelize_models"], SEQUELIZE_SQL)
_register("ts_mongoose_models", "models", ["ts_mongoose_models"], MONGOOSE_SQL)
_register("ts_drizzle_models", "models", ["ts_drizzle_models"], DRIZZLE_SQL)
_register("ts_express_routes", "routes", ["ts_express_routes"], EXPRESS_SQL)
_register("ts_classes", "components", ["ts_classes"], TS_CLASSES_SQL)
_register("prisma_models", "models", ["prisma_models"], PRISMA_SQL)
_register("js_module_exports", "components", ["js_module_exports"], EXPORTS_SQL)
_register("rb_models", "models", ["rb_activerecord_models", "rb_sequel_models"], RB_MODELS_SQL)
_register("rb_rails_routes", "routes", ["rb_rails_routes"], RAILS_SQL)
_register("rb_classes", "components", ["rb_classes"], RB_CLASSES_SQL)
_register("go_models", "models", ["go_models"], GO_MODELS_SQL)
_register("go_http_routes", "routes", ["go_http_routes"], GO_HTTP_SQL)
_register("go_gin_routes", "routes", ["go_gin_routes"], GIN_SQL)
_register("go_structs", "components", ["go_structs"], GO_STRUCTS_SQL)
_register("java_jpa_models", "models", ["java_jpa_models"], JPA_SQL)
_register("java_spring_routes", "routes", ["java_spring_routes"], SPRING_SQL)
_register("java_classes", "components", ["java_classes"], JAVA_CLASSES_SQL)


@query("py_model_fields", PY_FIELDS_SQL)
def _(t):
    rows = code.models(t.code_corpus, ["python"]).select("project", "source_file", "name", F.explode("fields").alias("f"))
    return rows.select("project", "source_file", "name", F.concat("f.name", F.lit(":"), "f.type").alias("field"))


@query(
    "ts_typeorm_fields",
    f"""SELECT project, source_file, name, unnest(string_split(fields, ',')) AS field FROM ({TYPEORM_SQL}) m WHERE fields <> ''""",
)
def _(t):
    rows = code.models(t.code_corpus, ["ts_typeorm_models"]).select("project", "source_file", "name", F.explode("fields").alias("f"))
    return rows.select("project", "source_file", "name", F.concat("f.name", F.lit(":"), "f.type").alias("field"))


# --- API specifications, union, summary ---------------------------------------------------

_PAGE = """SELECT project, source, CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) AS page_id FROM openapi_specs"""
OPENAPI_ROUTES_SQL = f"""SELECT project, source AS source_file, route, method, handler, 0 AS line, 'openapi' AS framework, 'high' AS confidence FROM (
  SELECT project, source, concat('/p/', page_id) AS route, 'GET' AS method, CASE WHEN page_id % 3 = 0 THEN concat('read', page_id) ELSE concat('get_/p/', page_id) END AS handler FROM ({_PAGE}) p
  UNION ALL SELECT project, source, concat('/p/', page_id), 'POST', concat('write', page_id) FROM ({_PAGE}) p
  UNION ALL SELECT project, source, concat('/q/', page_id), 'DELETE', concat('delete_/q/', page_id) FROM ({_PAGE}) p) o"""
OPENAPI_COMPONENTS_SQL = f"""SELECT project, source AS source_file, CASE WHEN page_id % 6 <> 0 THEN concat('Api ', page_id) ELSE 'unknown' END AS name, 0 AS line, 'service' AS type,
  concat(CASE WHEN page_id % 3 = 0 THEN concat('read', page_id) ELSE concat('get_/p/', page_id) END, ',write', page_id, ',delete_/q/', page_id) AS public_methods,
  '' AS dependencies, 'high' AS confidence, concat('Discovered from OpenAPI spec: 1.', page_id % 4) AS note FROM ({_PAGE}) p"""


@query("openapi_routes", OPENAPI_ROUTES_SQL)
def _(t):
    return flat_routes(discovery.openapi_routes(t.openapi_specs))


@query("openapi_components", OPENAPI_COMPONENTS_SQL)
def _(t):
    return flat_components(discovery.openapi_components(t.openapi_specs))


def _as_union(kind: str, name: str, sql: str, file: str = "source_file") -> str:
    return f"SELECT project, '{kind}' AS kind, {name} AS name, {file} AS source_file, line, confidence FROM ({sql}) {kind}_"


UNION_SQL = " UNION ALL ".join(
    [
        _as_union("models", "name", MODELS_SQL),
        _as_union("routes", "route", ROUTES_SQL),
        _as_union("routes", "route", OPENAPI_ROUTES_SQL),
        _as_union("components", "name", COMPONENTS_SQL),
        _as_union("components", "name", OPENAPI_COMPONENTS_SQL),
        _as_union("pact_keys", "key", KEYS_SQL, "path"),
        _as_union("env_vars", "name", ENV_VARS_SQL, "path"),
        _as_union("sensitive_fields", "field_name", SENSITIVE_SQL, "path"),
    ]
)


def facts(t):
    return discovery.discover(t.code_corpus, t.openapi_specs)


@query("discovery_union", UNION_SQL)
def _(t):
    return discovery.discovery_union(t.code_corpus, t.openapi_specs)


@query("discovery_summary", f"SELECT project, kind, count(*) AS n FROM ({UNION_SQL}) u GROUP BY 1, 2")
def _(t):
    return discovery.discovery_summary(discovery.discovery_union(t.code_corpus, t.openapi_specs))

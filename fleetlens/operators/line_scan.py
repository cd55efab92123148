"""Scanners that look at single lines, whatever the language."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens import values as V
from fleetlens.functions.regexkit import WORD, let, match_structs, once, rx
from fleetlens.functions.text import constant_map
from fleetlens.sources.corpus import corpus_lines

# anchors and look-around see line ends in a single line but not in a whole file
_LINE_SENSITIVE = re.compile(r"\^|\$|\\[AZz]|\(\?[=!<]")


def line_facts(text: Column, pattern: str, each: Callable[[Column, Column], Column], whole: bool = True) -> Column:
    """Facts of the lines that match, as one array: ``each(line number, line)`` gives those of a line.

    Texts without a match cost one test; ``whole`` False skips it, for
    patterns that see more in a line than in a text.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    found = F.flatten(F.transform(F.filter(lines, lambda x: x["text"].rlike(pattern)), lambda x: each(x["line"], x["text"])))
    return F.when(text.rlike(pattern), found) if whole else found


def _rows(corpus: DataFrame, facts: Column) -> DataFrame:
    """(project, path, fact's fields) of an array of facts per file."""
    return once(corpus.select("project", "path", "content"), "facts", facts).select("project", "path", F.explode("facts").alias("f")).select("project", "path", "f.*")


def pact_key_facts(text: Column, pattern: str = V.PACT_KEY_FORMAT) -> Column:
    p = rx(pattern)

    def each(line: Column, value: Column) -> Column:
        keys = F.regexp_extract_all(value, F.lit(p), F.lit(0))
        return F.transform(keys, lambda k, i: F.struct(line.alias("line"), i.alias("pos"), k.alias("key"), F.lit("high").alias("confidence")))

    return line_facts(text, p, each, not _LINE_SENSITIVE.search(pattern))


def scan_pact_keys(corpus: DataFrame, pattern: str = V.PACT_KEY_FORMAT) -> DataFrame:
    """Every instrumentation key in every line; repeats are kept."""
    return _rows(corpus, pact_key_facts(F.col("content"), pattern))


_ENV_ACCESS = rx("(?:" + "|".join(V.ENV_ACCESS) + ")")


def env_access_facts(text: Column) -> Column:
    def each(line: Column, value: Column) -> Column:
        hits = F.regexp_extract_all(value, F.lit(_ENV_ACCESS), F.lit(0))
        # the name follows the first quote, or the dot after "env"
        name = rx(r"(?:['\"]|^process\.env\.)(\w+)")
        return F.transform(hits, lambda h, i: F.struct(line.alias("line"), i.alias("pos"), F.regexp_extract(h, name, 1).alias("name")))

    return line_facts(text, _ENV_ACCESS, each)


def scan_env_vars(corpus: DataFrame) -> DataFrame:
    """Every environment access: (project, path, line, pos, name)."""
    return _rows(corpus, env_access_facts(F.col("content")))


def _first_of_each_name(accesses: Column) -> Column:
    """The first access of each name, by order in the array."""

    def firsts(found: Column) -> Column:
        return let(
            F.transform(found, lambda x: x["name"]),
            lambda names: F.transform(F.array_distinct(names), lambda n: F.get(found, (F.array_position(names, n) - 1).cast("int"))),
        )

    return let(accesses, firsts)


def _backend(name: Column) -> Column:
    """The backend a name points at, or NULL."""
    return F.coalesce(*[F.when(name.rlike(rx("^(?:" + p + ")", ignore_case=True)), F.lit(b)) for p, b in V.ENV_BACKENDS])


def env_backend_hint(accesses: DataFrame) -> DataFrame:
    """Names that point at a backend; all others are dropped."""
    return accesses.withColumn("backend_hint", _backend(F.col("name"))).where(F.col("backend_hint").isNotNull())


def env_var_facts(text: Column) -> Column:
    """First access of every name with a backend hint, reduced inside the file."""
    hinted = F.filter(
        F.transform(env_access_facts(text), lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line"), x["pos"].alias("pos"), _backend(x["name"]).alias("backend_hint"))),
        lambda x: x["backend_hint"].isNotNull(),
    )
    return F.transform(_first_of_each_name(hinted), lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line"), x["pos"].alias("pos"), x["backend_hint"].alias("backend_hint"), F.lit("medium").alias("confidence")))


def env_first_per_file(corpus: DataFrame) -> DataFrame:
    """The first access of a name in each file; a file is one row, so nothing is shuffled."""
    return _rows(corpus, _first_of_each_name(env_access_facts(F.col("content")))).select("project", "path", "name", "line", "pos")


def env_vars(corpus: DataFrame) -> DataFrame:
    """First access per file of every name with a backend hint."""
    return _rows(corpus, env_var_facts(F.col("content")))


def default_terms(spark: SparkSession) -> DataFrame:
    rows = [
        (tier, tier_ord, pos, term)
        for tier_ord, (tier, terms) in enumerate(V.SENSITIVE_TERMS.items())
        for pos, term in enumerate(terms)
    ]
    return spark.createDataFrame(rows, "tier string, tier_ord int, pos bigint, term string")


def sensitive_patterns_merge(custom: DataFrame) -> DataFrame:
    """Default terms plus custom ones (tier, tier_ord, pos, term).

    A custom term its default tier already lists is ignored; of equal terms
    in lower case the one of the later tier, then position, wins.
    """
    base = default_terms(custom.sparkSession)
    known = {tier: i for i, tier in enumerate(V.SENSITIVE_TERMS)}
    shift = len(known)
    tier_rank = F.coalesce(constant_map({t: str(i) for t, i in known.items()})[F.col("tier")].cast("int"),
                           F.col("tier_ord").cast("int") + shift)
    added = (
        custom.join(F.broadcast(base.select("tier", "term")), ["tier", "term"], "left_anti")
        .select("tier", tier_rank.alias("tier_ord"), (F.col("pos").cast("bigint") + 1000).alias("pos"), "term")
    )
    return (
        base.unionByName(added)
        .groupBy(F.lower("term").alias("lookup"))
        .agg(F.max(F.struct("tier_ord", "pos", "term", "tier")).alias("last"))
        .select("lookup", F.col("last.term").alias("pattern"), F.col("last.tier").alias("tier"))
    )


def _identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))


def _first_spellings(tokens: Column) -> Column:
    """Per distinct lower-case token its first spelling, in order of appearance."""
    return let(
        tokens,
        lambda toks: F.transform(
            F.array_distinct(F.transform(toks, F.lower)),
            lambda low: F.struct(low.alias("low"), F.get(F.filter(toks, lambda t: F.lower(t) == low), F.lit(0)).alias("tok")),
        ),
    )


def _any_term(terms: list[str]) -> str:
    """A pattern for whole identifiers that equal a term, whatever the case; terms that start alike share their start."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in [*term, ""]:
            node = node.setdefault(c, {})

    def spelled(node: dict) -> str:
        ways = [re.escape(c) + spelled(below) if c else "" for c, below in sorted(node.items(), reverse=True)]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return f"(?<!{WORD})(?i:{spelled(tree)})(?!{WORD})"


_TIER_OF = {t.lower(): tier for tier, ts in V.SENSITIVE_TERMS.items() for t in ts}
_TERM_OF = {t.lower(): t for ts in V.SENSITIVE_TERMS.values() for t in ts}
_DEFAULT_TERM = _any_term([t for t in _TERM_OF if re.fullmatch("[a-z_][a-z0-9_]*", t)])


def sensitive_facts(text: Column) -> Column:
    """Identifiers that equal a default term, once per term and line."""

    def each(line: Column, value: Column) -> Column:
        firsts = _first_spellings(F.regexp_extract_all(value, F.lit(_DEFAULT_TERM), F.lit(0)))
        return F.transform(
            firsts,
            lambda t, i: F.struct(
                line.alias("line"),
                i.alias("pos"),
                t["tok"].alias("field_name"),
                constant_map(_TERM_OF)[t["low"]].alias("pattern_matched"),
                constant_map(_TIER_OF)[t["low"]].alias("classification_hint"),
                F.lit("low").alias("confidence"),
            ),
        )

    return line_facts(text, _DEFAULT_TERM, each)


def scan_sensitive_fields(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Identifiers that equal a sensitive term, once per term and line.

    The default terms are one pattern, so only lines with a hit are looked
    at.  A term table of unknown size is joined instead; Spark broadcasts it
    if its size allows.
    """
    if terms is None:
        return _rows(corpus, sensitive_facts(F.col("content")))
    lines = corpus_lines(corpus)
    ascii_name = "^[A-Za-z_][A-Za-z0-9_]*$"
    toks = F.filter(_identifiers(F.col("text")), lambda t: t.rlike(ascii_name))
    named = lines.select("project", "path", "line", F.posexplode(toks).alias("pos", "tok"))
    return (
        named.join(terms.withColumnRenamed("lookup", "low"), F.lower("tok") == F.col("low"))
        .groupBy("project", "path", "line", "low", "pattern", "tier")
        .agg(F.min(F.struct("pos", "tok")).alias("first"))
        .select(
            "project",
            "path",
            "line",
            F.col("first.pos").alias("pos"),
            F.col("first.tok").alias("field_name"),
            F.col("pattern").alias("pattern_matched"),
            F.col("tier").alias("classification_hint"),
            F.lit("low").alias("confidence"),
        )
    )


def match_line_numbers(corpus: DataFrame, pattern: str) -> DataFrame:
    """(project, path, pos, line, hit) of a one-group pattern over whole files."""
    found = match_structs("content", rx(pattern), (1,))
    return corpus.select("project", "path", F.posexplode(found).alias("pos", "m")).select(
        "project", "path", "pos", "m.line", F.col("m.g1").alias("hit")
    )

"""Regular expressions over whole file texts, on the JVM side."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[\p{L}\p{N}_]"
CHUNK = 1024  # matches handled per inner fold; keeps array growth linear


def rx(pattern: str, multiline: bool = False, ignore_case: bool = False) -> str:
    """A Python-notation pattern in the form Spark's engine reads the same way.

    Unicode classes, LF as the only line end, Python's spelling of named
    groups and of the absolute end of text.
    """
    flags = "Ud" + ("m" if multiline else "") + ("iu" if ignore_case else "")

    def swap(found: re.Match) -> str:
        escaped = found.group(0)
        return {r"\w": WORD, r"\Z": r"\z"}.get(escaped, escaped)

    body = re.sub(r"\\.", swap, pattern, flags=re.DOTALL)
    body = body.replace("(?P<", "(?<")
    body = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", body)
    return f"(?{flags})" + body


# characters that stand for themselves, and a choice of such words
_PLAIN = r"[A-Za-z0-9 _/:,;'\"<>=@%&~!-]+"
_WORDS = re.compile(rf"{_PLAIN}|\((?:\?:)?{_PLAIN}(?:\|{_PLAIN})*\)")
_CHOICE = re.compile(r"((?:\(\?[a-zA-Z]+\))?)(?=\((?:\?:)?([A-Za-z0-9_]+(?:\|[A-Za-z0-9_]+)*)\)(?![?*+{]))")


def hasten(pattern: str) -> str:
    """The same pattern; one that starts with a choice of words first looks at the next character alone."""
    choice = _CHOICE.match(pattern)
    if not choice:
        return pattern
    firsts = "".join(sorted({word[0] for word in choice.group(2).split("|")}))
    return f"{choice.group(1)}(?=[{firsts}]){pattern[choice.end():]}"


def holds(text: Column, pattern: str, multiline: bool = False) -> Column:
    """Does a Python-notation pattern match anywhere in ``text``?

    Words that any match holds are searched first, as plain text; the pattern
    itself only sees the texts that have them, if it is more than its words.
    """
    pieces = pattern.split(".*")
    matched = text.rlike(hasten(rx(pattern, multiline)))
    if not all(map(_WORDS.fullmatch, pieces)):
        return matched
    held = [reduce(Column.__or__, map(text.contains, re.sub(r"^\((\?:)?|\)$", "", piece).split("|"))) for piece in pieces]
    return reduce(Column.__and__, held if len(pieces) == 1 else [*held, matched])


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed exactly once per row.

    The optimizer copies a plain column's expression into every filter above
    it, its own inferred ones included; a generator's output it leaves alone.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def sql_text(text: str) -> str:
    """A string literal for expression texts."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# what makes a match hang on the text around it: look-around, borders, anchors, and what never gives back
_CONTEXT = re.compile(r"\(\?<?[=!]|\(\?>|[*+?}]\+|\\[bBAZzGX]|\^|\$")


def stands_alone(pattern: str) -> bool:
    """Would the pattern match the text of each of its matches just as it did in the whole text?"""
    return not _CONTEXT.search(pattern.replace(r"\\", "").replace("[^", "["))


_MATCHES = """
CASE WHEN {text} RLIKE {p} THEN transform(array(
  transform(
    filter(
      CAST(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0){extracts}) AS ARRAY<STRUCT<gap: STRING, hit: STRING{typed}>>),
      p -> p.hit IS NOT NULL),
    p -> struct(
      octet_length(p.gap) - octet_length(replace(p.gap, '\\n', '')) AS gap_nl,
      octet_length(p.hit) - octet_length(replace(p.hit, '\\n', '')) AS hit_nl,
      length(p.gap) AS gap_len, length(p.hit) AS hit_len{named}))),
  pieces -> CASE WHEN size(pieces) > 0 THEN flatten(aggregate(
    sequence(0, CAST((size(pieces) - 1) DIV {chunk} AS INT)),
    struct(1 AS line, 0 AS off, CAST(array() AS ARRAY<{out}>) AS done, CAST(array() AS {out}) AS out),
    (acc, c) -> aggregate(
      slice(pieces, c * {chunk} + 1, {chunk}),
      acc,
      (a, p) -> struct(
        a.line + p.gap_nl + p.hit_nl AS line,
        a.off + p.gap_len + p.hit_len AS off,
        a.done AS done,
        concat(a.out, array(struct(a.line + p.gap_nl AS line, a.off + p.gap_len AS start, a.off + p.gap_len + p.hit_len AS stop{carried}))) AS out),
      a -> struct(a.line AS line, a.off AS off, concat(a.done, array(a.out)) AS done, CAST(array() AS {out}) AS out)),
    acc -> acc.done)) ELSE CAST(array() AS {out}) END)[0]
ELSE CAST(array() AS {out}) END"""


def match_sql(text: str, pattern: str, groups: tuple[int, ...] = (1,)) -> str:
    """Expression text of ``match_structs``."""
    names = [f"g{i + 1}" for i in range(len(groups))]
    p = sql_text(hasten(pattern))
    fields = "".join(f", {n}: STRING" for n in names)
    alone = stands_alone(pattern)  # then groups are read from the matches, without another pass over the text each
    return _MATCHES.format(
        text=text,
        p=p,
        chunk=CHUNK,
        extracts="" if alone else "".join(f", regexp_extract_all({text}, {p}, {g})" for g in groups),
        typed="" if alone else fields,
        named="".join(f", regexp_extract(p.hit, {p}, {g}) AS {n}" if alone else f", p.{n} AS {n}" for n, g in zip(names, groups, strict=True)),
        carried="".join(f", p.{n} AS {n}" for n in names),
        out=f"ARRAY<STRUCT<line: INT, start: INT, stop: INT{fields}>>",
    )


def match_structs(text: str, pattern: str, groups: tuple[int, ...] = (1,)) -> Column:
    """All matches in column ``text`` as ``array<struct<line, start, stop, g1..>>``.

    ``start`` and ``stop`` are 0-based character offsets, ``line`` is the
    1-based line of the match start.  One linear walk over the pieces between
    matches; the fold runs in chunks so that growing the output array never
    becomes quadratic on files with very many matches.
    """
    return F.expr(match_sql(text, pattern, groups))


def glob_regex(glob: str) -> str:
    """Shell-style glob as an anchored regex; ``*`` crosses folder borders."""
    return "^" + fnmatch.translate(glob).replace(r"\Z", r"\z")


def matches_any_glob(path: Column, globs: list[str]) -> Column:
    """True if the relative path or its last part fits one of the globs."""
    base = F.substring_index(path, "/", -1)
    hit = F.lit(False)
    for glob in globs:
        hit = hit | path.rlike(glob_regex(glob)) | base.rlike(glob_regex(glob))
    return hit


def escape_regex(text: Column) -> Column:
    """Backslash-escape every character that is special in a pattern."""
    return F.regexp_replace(text, r"([\\\-\[\]{}()*+?.^$|#&~\s])", r"\\$1")

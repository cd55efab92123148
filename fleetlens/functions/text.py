"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens.functions.regexkit import sql_text


def snake(name: Column) -> Column:
    """CamelCase to snake_case; other characters become underscores."""
    spaced = F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))
    return F.regexp_replace(spaced, r"[^a-z0-9_]", "_")


def version_below(version: Column, minimum: str) -> Column:
    """Dotted versions by number; by text when a part is not a number."""
    numbers = F.transform(F.split(version, r"\."), lambda p: F.trim(p).try_cast("int"))
    try:
        want = [int(p) for p in minimum.split(".")]
    except ValueError:
        return version < F.lit(minimum)
    wanted = F.array(*[F.lit(p) for p in want])
    return F.when(F.exists(numbers, lambda n: n.isNull()), version < F.lit(minimum)).otherwise(numbers < wanted)


def percent(part: Column, total: Column) -> Column:
    """Share in percent, one decimal, ties to even; 100.0 of nothing."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.bround(part / total * 100, 1))


def sql_value(value) -> str:
    """A constant in expression text; building it there is one call to the JVM."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        kind = "INT" if value and all(isinstance(v, int) for v in value) else "STRING"
        return "CAST(array(" + ", ".join(map(sql_value, value)) + f") AS ARRAY<{kind}>)"
    return str(value) if isinstance(value, (int, float)) else sql_text(value)


def constant_map(table: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_value(k)}, {sql_value(v)}" for k, v in table.items()) + ")")


def constant_rows(rows: list[dict], names: list[str]) -> Column:
    """A constant array of structs, one per row."""
    structs = ("struct(" + ", ".join(f"{sql_value(r[n])} AS `{n}`" for n in names) + ")" for r in rows)
    return F.expr("array(" + ", ".join(structs) + ")")

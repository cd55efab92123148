"""Profiles of data stores from their exported catalogues and samples.

Each result is a model row like those of the source scanners: name,
source_file, orm, fields, confidence.  ``backend`` takes the place of the
project key.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from fleetlens.operators.code_scan import FIELD_TYPE


def _fields(ordered: Column) -> Column:
    """Ordered structs (ord.., name, type, confidence, note) as field structs."""
    return F.transform(
        ordered,
        lambda f: F.struct(f["name"], f["type"], f["confidence"], f["note"], F.lit(None).cast("string")).cast(FIELD_TYPE),
    )


def profile_catalog_columns(columns: DataFrame) -> DataFrame:
    """Base tables of the public schema from information-schema shaped rows."""
    size = F.when(F.coalesce("character_maximum_length", F.lit(0)) != 0, F.col("character_maximum_length")).when(
        F.coalesce("numeric_precision", F.lit(0)) != 0, F.col("numeric_precision")
    )
    kind = F.when(size.isNotNull(), F.concat("data_type", F.lit("("), size.cast("string"), F.lit(")"))).otherwise(F.col("data_type"))
    field = F.struct(
        F.col("ordinal_position").cast("bigint").alias("at"),
        F.col("column_name").alias("name"),
        kind.alias("type"),
        F.lit("high").alias("confidence"),
        F.concat(F.lit("nullable="), "is_nullable").alias("note"),
    )
    tables = columns.where((F.col("table_schema") == "public") & (F.col("table_type") == "BASE TABLE"))
    return tables.groupBy("backend", "table_name").agg(_fields(F.array_sort(F.collect_list(field))).alias("fields")).select(
        "backend",
        F.col("table_name").alias("name"),
        F.concat(F.lit("postgres://"), "backend", F.lit("/"), "table_name").alias("source_file"),
        F.lit("postgres").alias("orm"),
        "fields",
        F.lit("high").alias("confidence"),
    )


def _walk(node: dict, prefix: str = ""):
    for key, value in node.items():
        path = f"{prefix}{key}"
        yield {"path": path, "type": type(value).__name__}
        if isinstance(value, dict):
            yield from _walk(value, path + ".")


def _paths(docs: pa.Array) -> pa.Array:
    out = []
    for doc in docs.to_pylist():
        try:
            data = json.loads(doc)
        except (TypeError, ValueError):
            data = None
        out.append(list(_walk(data)) if isinstance(data, dict) else [])
    return pa.array(out, type=pa.list_(pa.struct([("path", pa.string()), ("type", pa.string())])))


def profile_json_documents(documents: DataFrame, sample: int | None = None) -> DataFrame:
    """Field paths and their types over the documents of each collection.

    documents(collection, seq, doc as JSON text), parsed to any depth.  All
    are read; ``sample`` keeps the first by ``seq`` of each collection, before
    the shuffle.
    """
    sampled = documents.where(~F.col("collection").startswith("system."))
    if sample is not None:
        place = F.row_number().over(Window.partitionBy("collection").orderBy("seq"))
        sampled = sampled.withColumn("place", place).where(F.col("place") <= sample)
    sampled = sampled.select("collection", "doc")
    counts = sampled.groupBy("collection").agg(F.count(F.lit(1)).alias("sampled"))
    per_path = (
        sampled.select("collection", F.explode(arrow_udf(_paths, "array<struct<path:string,type:string>>")(F.col("doc"))).alias("p"))
        .groupBy("collection", "p.path")
        .agg(F.array_join(F.array_sort(F.collect_set("p.type")), "|").alias("types"))
    )
    return per_path.join(counts, "collection").select(
        "collection",
        F.col("path").alias("field"),
        F.col("types").alias("type"),
        F.lit("medium").alias("confidence"),
        F.concat(F.lit("Inferred from "), F.col("sampled").cast("string"), F.lit(" sampled documents")).alias("note"),
    )


def key_pattern(key: Column) -> Column:
    """A key with numbers, UUIDs and object ids replaced by ``*``."""
    ids = r"^(?:(?U:\d+)|(?i:[0-9a-f-]{36})|(?i:[0-9a-f]{24}))$"
    return F.array_join(F.transform(F.split(key, ":", -1), lambda p: F.when(p.rlike(ids), "*").otherwise(p)), ":")


def profile_key_patterns(keys: DataFrame, sample: int | None = None, kept: int | None = None) -> DataFrame:
    """The key patterns of each backend, the most frequent first.

    keys(backend, seq, key).  All keys count and all patterns are returned;
    ``sample`` takes the first keys by ``seq`` only, ``kept`` the first patterns.
    """
    if sample is not None:
        first = F.row_number().over(Window.partitionBy("backend").orderBy("seq"))
        keys = keys.withColumn("place", first).where(F.col("place") <= sample)
    sampled = keys.select("backend", key_pattern(F.col("key")).alias("name"))
    counted = sampled.groupBy("backend", "name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("backend").orderBy(F.desc("n"), "name"))
    ranked = counted.withColumn("rank", rank)
    if kept is not None:
        ranked = ranked.where(F.col("rank") <= kept)
    return ranked.select(
        "backend",
        "rank",
        "name",
        F.concat(F.lit("redis://"), "backend").alias("source_file"),
        F.lit("redis").alias("orm"),
        F.col("n"),
        F.concat(F.lit("Sampled "), F.col("n").cast("string"), F.lit(" keys matching this pattern")).alias("note"),
        F.lit("medium").alias("confidence"),
    )


def profile_topics(topics: DataFrame, schemas: DataFrame) -> DataFrame:
    """Topics with their partition count and record fields, value before key.

    topics(backend, topic, partitions); schemas(backend, subject, schema).
    One row per field: (backend, topic, part, pos, field, type, note).
    """
    shown = topics.where(~F.col("topic").startswith("__"))
    head = shown.select(
        "backend",
        "topic",
        F.lit(0).alias("part"),
        F.lit(0).alias("pos"),
        F.lit("partitions").alias("field"),
        F.concat(F.lit("int("), F.col("partitions").cast("string"), F.lit(")")).alias("type"),
        F.lit(None).cast("string").alias("note"),
    )
    suffix = F.regexp_extract("subject", "(-value|-key)$", 1)
    record = F.from_json("schema", "struct<type:string,fields:array<struct<name:string,type:string>>>")
    parsed = (
        schemas.select("backend", F.regexp_replace("subject", "(-value|-key)$", "").alias("topic"), suffix.alias("suffix"), record.alias("r"))
        .where((F.col("suffix") != "") & (F.col("r.type") == "record"))
        .join(shown.select("backend", "topic"), ["backend", "topic"])
        .select("backend", "topic", "suffix", F.posexplode("r.fields").alias("pos", "f"))
    )
    kind = F.coalesce("f.type", F.lit("unknown"))
    text = (
        F.when(kind.startswith("["), F.array_join(F.from_json(kind, "array<string>"), "|"))
        .when(kind.startswith("{"), F.coalesce(F.get_json_object(kind, "$.type"), F.lit("complex")))
        .otherwise(kind)
    )
    body = parsed.select(
        "backend",
        "topic",
        F.when(F.col("suffix") == "-value", 1).otherwise(2).alias("part"),
        "pos",
        F.col("f.name").alias("field"),
        text.alias("type"),
        F.concat(F.lit("From schema registry ("), "suffix", F.lit(")")).alias("note"),
    )
    return head.unionByName(body)

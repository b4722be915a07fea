"""Typed access to values of the ``nodes`` relation, as column expressions.

A mismatch is null: an integer takes an integral real, a number takes both, a text is
decoded from a string's bytes. ``pick`` turns paths of objects into typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.filters import IMAGE
from quirelake.operators.joins import apart


def integer() -> Column:
    fits = (F.col("d") == F.floor("d")) & (F.abs("d") < float(1 << 63))
    return F.coalesce("i", F.when(fits, F.expr("try_cast(d AS BIGINT)")))


def number() -> Column:
    return F.coalesce(F.col("i").cast("double"), "d")


def text() -> Column:
    """UTF-16 after a byte-order mark, otherwise Latin-1."""
    mark, rest = F.hex(F.expr("substring(bytes, 1, 2)")), F.expr("substring(bytes, 3)")
    return F.when(mark == "FEFF", F.decode(rest, "UTF-16BE")).when(mark == "FFFE", F.decode(rest, "UTF-16LE")).otherwise(F.decode("bytes", "ISO-8859-1"))


TYPES = {"integer": integer, "number": number, "text": text, "name": lambda: F.col("name"), "boolean": lambda: F.col("b"), "reference": lambda: F.col("ref_obj")}


def pick(nodes: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """(doc_id, holder, one column per argument): ``pick(nodes, count=("/Count",
    "integer"))``. One aggregation serves all columns."""
    paths = sorted({path for path, _ in columns.values()})
    chosen = [F.max(F.when(F.col("path") == path, TYPES[kind]())).alias(name) for name, (path, kind) in columns.items()]
    return nodes.where(F.col("path").isin(paths)).groupBy("doc_id", "holder").agg(*chosen)


def of_type(objects: DataFrame, type_name: str, subtype: str | None = None) -> DataFrame:
    """Objects whose /Type, and /Subtype if given, are these names."""
    found = objects.where(F.col("type_name") == type_name)
    return found if subtype is None else found.where(F.col("subtype") == subtype)


def presence(refs: DataFrame, index: DataFrame, objects: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """References with what their target is: defined, unproduced (indexed but not to be
    had), missing; and with ``structure`` unindexed, where a bound cut the chain of sections
    and the index may not hold what the file does."""
    there = index.where("kind <> 'free' and obj > 0").selectExpr("doc_id", "obj AS dst", "true AS indexed")
    known = objects.selectExpr("doc_id", "obj AS dst", "presence")
    out = refs.join(apart(there), ["doc_id", "dst"], "left").join(apart(known), ["doc_id", "dst"], "left")
    absent = F.lit("missing")
    if structure is not None:
        out = out.join(apart(structure.select("doc_id", "chain_cut")), "doc_id", "left")
        absent = F.when(F.col("chain_cut"), "unindexed").otherwise(absent)
    told = F.when(F.col("indexed").isNull(), absent).otherwise(F.coalesce("presence", F.lit("unproduced")))
    return out.withColumn("presence", told).drop("indexed", "chain_cut")


def raw_bytes(files: DataFrame, objects: DataFrame, structure: DataFrame) -> DataFrame:
    """(doc_id, obj, raw): the bytes of each stream as they stand in its file."""
    places = objects.where("data_offset IS NOT NULL").select("doc_id", "obj", "data_offset", "raw_length")
    base = structure.select("doc_id", F.coalesce("header_pos", F.lit(0)).alias("base"))
    rows = places.join(apart(base), "doc_id").join(apart(files.select("doc_id", "content")), "doc_id")
    return rows.select("doc_id", "obj", F.expr("substring(content, CAST(base + data_offset + 1 AS INT), CAST(raw_length AS INT))").alias("raw"))


def merged_runs(left: Column | str, right: Column | str) -> Column:
    """Two sorted arrays of offsets as one, each offset once."""
    return F.array_sort(F.array_union(left, right))


def has_image_filter(streams: DataFrame) -> DataFrame:
    """Streams whose chain an image filter ends."""
    return streams.where(F.col("chain_end") == "image")


def image_filters() -> list[str]:
    return sorted(IMAGE)

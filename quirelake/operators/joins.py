"""Index upkeep, resolution, probing and graph steps as DataFrame operations.

Everything is keyed by ``doc_id`` first, so one hash partitioning serves a whole plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far from its offset an object's header is still looked for.
NEAR = 512

#: Links of a chain of references, at most.
MAX_LINKS = 32


def apart(df: DataFrame) -> DataFrame:
    """The right side of a join, to be dealt by the join's keys and never sent whole to every
    executor through the driver. Spark takes a relation for as large as its share of the
    stored files, which are packed a hundredfold and more: what grows with the corpus looks
    small enough to broadcast."""
    return df.hint("merge")


def newest_rows(xref_entries: DataFrame) -> DataFrame:
    """One row per object: that of the newest section, the first in it. A refused row
    hides older ones."""
    by = Window.partitionBy("doc_id", "obj").orderBy("section", "row_ord")
    return xref_entries.withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")


def merged_trailer(trailers: DataFrame) -> DataFrame:
    """One row per key of a file's trailer: the newest section that gives it."""
    top = trailers.where("parent_path = '' and key not in ('Prev', 'XRefStm')")
    value = F.min_by(F.struct("section", "kind", "i", "d", "name", "ref_obj", "ref_gen"), "section").alias("v")
    return top.groupBy("doc_id", "key").agg(value).select("doc_id", "key", "v.*")


def extents(index: DataFrame) -> DataFrame:
    """In-use regular objects with the placed offsets before and after their own."""
    by = Window.partitionBy("doc_id").orderBy("offset")
    rows = index.where("kind = 'regular'")
    return rows.select("doc_id", "obj", "offset", F.lag("offset").over(by).alias("before"), F.lead("offset").over(by).alias("after"))


def stream_rows(data: DataFrame, w: tuple[int, int, int]) -> DataFrame:
    """(doc_id, row, kind, two, three) of the fixed-width rows of a decoded
    cross-reference stream ``decoded``, by expressions; a width of 0 in front means 1."""
    a, b, c = w
    size = a + b + c
    rows = data.select("doc_id", "decoded", F.posexplode(F.sequence(F.lit(0), F.expr(f"octet_length(decoded) div {size} - 1"))).alias("row", "k"))

    def number(at: int, n: int):
        return F.conv(F.hex(F.expr(f"substring(decoded, k * {size} + {at + 1}, {n})")), 16, 10).cast("long") if n else F.lit(0).cast("long")

    kind = number(0, a) if a else F.lit(1).cast("long")
    return rows.select("doc_id", "row", kind.alias("kind"), number(a, b).alias("two"), number(a + b, c).alias("three"))


def last_headers(headers: DataFrame) -> DataFrame:
    """One row per object: its last definition by place in the file."""
    last = F.max_by(F.struct("pos", "gen"), "pos").alias("last")
    return headers.where("clean").groupBy("doc_id", "obj").agg(last, (F.count("*") - 1).alias("redefined")).select("doc_id", "obj", "last.*", "redefined")


def placed(xref_entries: DataFrame, headers: DataFrame) -> DataFrame:
    """In-use regular rows of the newest index with where their object is: ``place`` is
    at-offset, nearby or not-found, ``vouched`` whether the file confirms it."""
    entries = newest_rows(xref_entries).where("kind = 'regular' and obj > 0 and not refused")
    h = headers.select("doc_id", "obj", "pos", F.col("gen").alias("written_gen"), "clean")
    at = entries.join(apart(h), ["doc_id", "obj"], "left")
    off = F.abs(F.col("pos") - F.col("offset"))
    near = at.withColumn("exact", F.coalesce(F.col("pos") == F.col("lands"), F.lit(False))).where(F.col("pos").isNull() | F.col("exact") | (off <= NEAR))
    kept = near.groupBy("doc_id", "obj").agg(
        F.max("exact").alias("exact"),
        F.count_if(F.col("clean") & ~F.col("exact")).alias("clean_near"),
        F.min(F.when(F.col("pos").isNotNull(), F.struct((~F.col("exact")).alias("a"), (~F.col("clean")).alias("b"), off.alias("c"), F.col("pos"), "written_gen", "clean"))).alias("best"),
    )
    out = entries.join(apart(kept), ["doc_id", "obj"], "left")
    place = F.when(F.col("exact"), "at-offset").when(F.col("best").isNotNull(), "nearby").otherwise("not-found")
    out = out.withColumn("place", place).withColumn("shift", F.col("best.pos") - F.col("offset"))
    by = Window.partitionBy("doc_id").orderBy("obj")
    alike = (F.lag("shift").over(by) == F.col("shift")) | (F.lead("shift").over(by) == F.col("shift"))
    vouched = F.col("exact") | (F.coalesce(F.col("best.clean"), F.lit(False)) & ((F.col("clean_near") == 1) | F.coalesce(alike, F.lit(False))))
    return out.withColumn("vouched", F.coalesce(vouched, F.lit(False))).select(
        "doc_id", "obj", "section", "offset", "lands", "gen", "place", "vouched", "shift", F.col("best.pos").alias("pos"), F.col("best.written_gen").alias("written_gen")
    )


def members_of(xref_entries: DataFrame, members: DataFrame, containers: DataFrame) -> DataFrame:
    """Compressed rows of the newest index with their object stream: ``state`` is listed,
    moved, unlisted or broken."""
    rows = newest_rows(xref_entries).where("kind = 'compressed' and not refused").select("doc_id", "obj", "objstm", "idx")
    m = members.select("doc_id", "objstm", "obj", F.col("idx").alias("listed_at")).groupBy("doc_id", "objstm", "obj").agg(F.collect_set("listed_at").alias("listed_at"))
    out = rows.join(apart(m), ["doc_id", "objstm", "obj"], "left").join(apart(containers), ["doc_id", "objstm"], "left")
    state = (
        F.when(F.col("listed_at").isNull() & (F.coalesce("fault", F.lit("missing")) != ""), "broken")
        .when(F.col("listed_at").isNull(), "unlisted")
        .when(F.array_contains("listed_at", F.col("idx").cast("int")), "listed")
        .otherwise("moved")
    )
    return out.withColumn("state", state)


def resolve(refs: DataFrame, objects: DataFrame, nodes: DataFrame, links: int = MAX_LINKS) -> DataFrame:
    """(doc_id, src, path, target, kind): where each reference ends. Objects that are a
    reference themselves are followed, ``links`` at most; nearly all end at once, and
    the loop stops when none is left."""
    hops = nodes.where("path = '' and kind = 'reference'").selectExpr("doc_id", "holder as target", "ref_obj as onward")
    at = refs.selectExpr("doc_id", "src", "path", "dst as target")
    if not hops.limit(1).count():
        links = 1
    for _ in range(links - 1):
        step = at.join(apart(hops), ["doc_id", "target"], "left")
        moved = step.withColumn("moved", F.col("onward").isNotNull())
        at = moved.select("doc_id", "src", "path", F.coalesce("onward", "target").alias("target"))
        if links > 2 and not moved.where("moved").limit(1).count():
            break
    kinds = objects.selectExpr("doc_id", "obj as target", "kind")
    return at.join(apart(kinds), ["doc_id", "target"], "left").withColumn("kind", F.coalesce("kind", F.lit("null")))


def dangling(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References to what no row of the index places."""
    there = index.where("kind <> 'free' and obj > 0").selectExpr("doc_id", "obj as dst")
    return refs.join(apart(there), ["doc_id", "dst"], "left_anti")


def _kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the session's checkpoint folder; without such a
    folder, kept by the executors and worked out again where one is lost."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def reachable(refs: DataFrame, index: DataFrame, rounds: int = 1000) -> DataFrame:
    """(doc_id, obj) that references lead to from the trailer (holder 0): frontiers, each
    joined with the edges and rid of what was seen; every round cuts its lineage."""
    there = index.where("kind <> 'free' and obj > 0").select("doc_id", "obj")
    edges = refs.select("doc_id", "src", F.col("dst").alias("obj")).distinct().join(apart(there), ["doc_id", "obj"], "left_semi")
    edges = _kept(edges)
    seen = frontier = _kept(edges.where("src = 0").select("doc_id", "obj").distinct())
    for _ in range(rounds):
        step = frontier.withColumnRenamed("obj", "src").join(apart(edges), ["doc_id", "src"]).select("doc_id", "obj").distinct()
        frontier = _kept(step.join(apart(seen), ["doc_id", "obj"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = _kept(seen.unionAll(frontier))
    raise RuntimeError(f"more than {rounds} rounds")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(doc_id, node, component) of the nodes of directed ``edges`` (doc_id, a, b) that
    lie on a circle; the component is its smallest node. A document's graph is as large
    as its object streams are many, and is one task's."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(d, n, c) for d, g in zip(rows["doc_id"], rows["edges"]) for n, c in _circles([(e["a"], e["b"]) for e in g])]
            yield pd.DataFrame(out, columns=["doc_id", "node", "component"])

    grouped = edges.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("edges"))
    return grouped.mapInPandas(kernel, "doc_id long, node long, component long")


def _circles(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Kosaraju's two passes, without recursion."""
    onward: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in onward:
        stack = [(start, iter(onward[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(onward.get(following, []))))
    out, taken = [], set()
    for start in reversed(order):
        if start in taken:
            continue
        group, stack = [], [start]
        taken.add(start)
        while stack:
            node = stack.pop()
            group.append(node)
            for n in back.get(node, []):
                if n not in taken:
                    taken.add(n)
                    stack.append(n)
        if len(group) > 1 or start in onward.get(start, []):
            out += [(n, min(group)) for n in group]
    return out

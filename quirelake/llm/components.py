"""Connected components of a link table, by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest neighbour, then does
the same for the smaller ones, until the links are stars around the smallest member.
Both steps are a partial minimum per node and a join back, so a node with very many
links is summed where its links lie; the join is left to adaptive execution, which
splits a hot node's links. Every round is a written table: nothing is recomputed when
an executor is lost, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v), u > v, rehung once."""
    if larger:
        near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = near.join(least, "u")
    if larger:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) that is not its root itself: the
    root is the smallest node reachable. Links to itself and repeats are allowed."""
    stars = written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links"
    )
    mark = _mark(stars)
    for _ in range(rounds):
        if not mark[0]:
            break
        stars = written(_star(_star(stars, True), False), "links")
        before, mark = mark, _mark(stars)
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Connected components by alternating star operations on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import hot_join, saved

#: Rounds after which something is wrong: the number needed grows with the logarithm of the input.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Connect each node's neighbours (the larger ones, or the smaller ones and
    itself) to the smallest node around. Hubs are aggregated before the shuffle and
    joined by broadcast; the join's other side has one row for each node."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")).withColumn("m", F.least("m", "u"))
    joined = hot_join(around, least, "u", 2 * rows)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u but the smallest of its component, which is v.

    ``edges`` has two columns u and v of one orderable type. Loops are ignored; no
    edge gives an empty table.
    """
    now = saved(edges.where("u <> v").distinct(), "edges")
    mark = None
    rows = now.count()
    for _ in range(MAX_ROUNDS):
        # Stars never have more edges than there are.
        now = saved(_star(_star(now, True, rows), False, rows), "stars")
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stats) == mark:
            return now
        mark, rows = tuple(stats), stats[0]
    raise RuntimeError("components did not settle")

"""Connected components over edge tables, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id and component (smallest id reachable) of every id in an edge; edges: columns u, v (bigint), in any direction.

    Loops and repeated edges don't matter.  An id without an edge to another isn't
    in the result.  Each round joins the edges with their ends' smallest neighbour;
    minima are combined in each task before the shuffle, and a node of very many
    edges is a skewed join key, which Spark splits.  Rounds: logarithmic.
    """
    both = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(now)
    for _ in range(most):
        if not before[0]:
            break
        # large star: every neighbour above u goes to u's smallest neighbour (or u)
        sides = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = written(sides.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        # small star: u and every neighbour below it go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = written(small, "cc")
        dropped(now, low, large, least)
        now, after = then, _state(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {most} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

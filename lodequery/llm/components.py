"""Connected components of a list of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodequery.storage import remove, written


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: every node of ``links (a, b)`` with the smallest node it is connected to.

    Each step writes its links into the shared folder, so a lost executor costs only the step it was lost in. Loops
    (a = b) and repeated links do no harm; links with a null end are left out; no links give no rows.
    """
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    loops = links.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(most_rounds):
        big = written(_large_star(now), "links")
        seen = Observation()  # taken while the links are written, so that it costs no job
        small = written(_small_star(big).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        remove(big)
        remove(now)
        now = small
        state = seen.get
        if state == before or not state["n"]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))

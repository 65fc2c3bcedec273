"""Connected components of a link table by alternating star rounds.

Each round hangs the larger neighbours of every node on its smallest one
(large star), then the smaller ones (small star). Rounds are joins and
pre-aggregated minima, each written to the work folder, so a lost executor costs
one round at most. The minima are written before the links are joined with them:
both sides of the join then are shuffles, and Spark can split a node on which
millions of links hang over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.work import work_dir, written


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """The smallest node each linked node can reach.

    Returns ``node`` and ``root``, one row per node that has a link to another;
    null ends and links to itself count as none; repeated links count once. An
    empty table gives an empty result.
    """
    where = work_dir(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a), F.col(b)).filter(F.col(a) != F.col(b)).select("u", "v").distinct()
    edges, seen = written(edges, where, "links"), None
    for k in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, where, f"least-{k}")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, where, f"large-{k}")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), where, f"lower-{k}")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, where, f"small-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components still change after {rounds} rounds")

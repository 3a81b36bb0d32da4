"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as X


def components(edges: DataFrame, staged: X.Staged, rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node reachable.

    Each round makes every node point to the smallest node it knows of; a node with many
    edges is only ever aggregated or looked up, never gathered.  Edges are written between rounds,
    and so is what a round reads several times: a plan that holds it over and over costs the
    driver more memory than the rows do.
    """
    # v is below u in all edges of all rounds
    now = staged.write(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), share=32)
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node are tied to the smallest node around it
        ends = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        near = staged.write(ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count("*").alias("held")), share=32)
        far = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = staged.write(X.looked_up(far, near, ["u"], 2 * now.count()).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct(), share=32)
        # small star: u and its neighbours below are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v")).where("u != v").distinct()
        after = staged.write(small, share=32)
        sign = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        staged.drop(now, near, large)
        now = after
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())

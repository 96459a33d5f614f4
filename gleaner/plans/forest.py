"""Parent-pointer trees resolved by pointer doubling (log2(depth) rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.scale import cut_lineage


def resolve_parents(parents: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """For every node: ``root``, ``depth`` and ``on_loop``.

    ``parents`` has one row per (keys, node); a null parent, or one that is no
    node itself, ends the chain. Each round doubles the distance covered, and
    only unfinished rows are joined again, so a root with very many descendants
    takes part in no further join. Rows that are unfinished after log2(n)
    rounds run into a cycle.
    """
    me = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    base = parents.select(*me, F.col(node).alias("node"), F.col(parent).alias("anc"))
    hops = base.withColumn("dist", F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long"))
    hops = hops.withColumn("open", F.col("anc").isNotNull())
    hops = cut_lineage(hops)
    limit = max(1, hops.count()).bit_length() + 1
    current = hops
    for _ in range(limit):
        nxt = current.select(
            *ks,
            F.col("node").alias("anc"),
            F.col("anc").alias("anc2"),
            F.col("dist").alias("dist2"),
            "open",
        ).withColumnRenamed("open", "open2")
        live = current.where("open")
        step = live.join(nxt, [*ks, "anc"], "left")
        moved = step.select(
            *ks,
            "node",
            F.coalesce("anc2", "anc").alias("anc"),
            (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
            F.coalesce("open2", F.lit(False)).alias("open"),
        )
        # finished rows are kept as the jump table for others
        current = cut_lineage(moved.unionByName(current.where(~F.col("open"))))
        if current.where("open").isEmpty():
            break
    return current.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("node").alias(node),
        F.when(F.col("open"), F.lit(None)).otherwise(F.coalesce("anc", "node")).alias("root"),
        F.when(F.col("open"), F.lit(None)).otherwise(F.col("dist")).alias("depth"),
        F.col("open").alias("on_loop"),
    )


def ancestor_rows(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """All (node, hop, place) pairs of loop-free chains, doubling the reach each round."""
    reach = cut_lineage(
        parents.where(F.col(parent).isNotNull()).select(
            F.col(node).alias("node"), F.col(parent).alias("place"), F.lit(1).cast("long").alias("hop")
        )
    )
    span = 1
    while True:
        ends = reach.where(F.col("hop") == span)
        step = reach.select(
            F.col("node").alias("place"), F.col("place").alias("further"), F.col("hop").alias("more")
        )
        longer = ends.join(step, "place").select(
            "node", F.col("further").alias("place"), (F.col("hop") + F.col("more")).alias("hop")
        )
        longer = cut_lineage(longer)
        if longer.isEmpty():
            return reach.withColumnRenamed("node", node)
        reach = cut_lineage(reach.unionByName(longer))
        span *= 2

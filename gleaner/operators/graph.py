"""Graphs as edge tables: joins and aggregations in rounds, lineage cut by checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.scale import cut_lineage, discard, placed, running_sum_within, sized_chunks, top_k_per_group, value_ranks


def _both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    fwd = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return fwd.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node id of its component for every node.

    Each round takes the smallest label around every node and then the label of
    that label, so long chains shrink by halves; a hub only adds to a partial
    minimum on the map side.
    """
    links = placed(_both_ways(edges, a, b), "dst")
    labels = links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    labels = cut_lineage(labels.select("node", F.least("node", "m").alias("label")))
    while True:
        seen = links.join(labels, links["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("m"))
        hooked = labels.join(seen, labels["node"] == seen["src"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hooked = cut_lineage(hooked)
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        nxt = cut_lineage(
            hooked.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        changed = not nxt.where(F.col("old") != F.col("label")).isEmpty()
        labels = nxt.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def shortest_paths(edges: DataFrame, a: str, b: str, start, cost: str | None = None,
                   limit: float | None = None) -> DataFrame:
    """Least cost (then fewest legs) from ``start`` to every node reachable within ``limit``.

    Costs must not be negative. Only nodes whose cost fell in the last round spread further. Ends when no cost falls.
    """
    step_cost = F.col(cost).cast("double") if cost else F.lit(1.0)
    links = cut_lineage(
        edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), step_cost.alias("w"))
        .groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = cut_lineage(
        links.select(F.col("src").alias("node")).where(F.col("node") == start).limit(1)
        .select("node", F.lit(0.0).alias("cost"), F.lit(0).alias("legs"), F.col("node").alias("via"),
                F.lit(True).alias("fresh")))
    while True:
        front = best.where("fresh").select(F.col("node").alias("src"), "cost", "legs")
        offers = front.join(links, "src").select(
            F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"),
            (F.col("legs") + 1).alias("legs"), F.col("src").alias("via"))
        if limit is not None:
            offers = offers.where(F.col("cost") <= limit)
        old = best.select("node", "cost", "legs", "via", F.lit(0).alias("new"))
        merged = old.unionByName(offers.withColumn("new", F.lit(1))).groupBy("node").agg(
            F.min(F.struct("cost", "legs", "new", "via")).alias("m"))
        best = cut_lineage(merged.select(
            "node", "m.cost", "m.legs", "m.via", (F.col("m.new") == 1).alias("fresh")))
        if best.where("fresh").isEmpty():
            return best.drop("fresh")


def trace_path(best: DataFrame, target) -> DataFrame:
    """Nodes on the least-cost path to ``target``, hop 0 being the target itself.

    ``best`` is what ``shortest_paths`` gives; one small join per hop walks back.
    """
    here = best.where(F.col("node") == target).select(F.col("node").alias("place"), "via")
    path, hop = [], 0
    while True:
        here = cut_lineage(here)
        if here.isEmpty():
            break
        path.append(here.select("place", F.lit(hop).alias("hop")))
        nxt = here.where(F.col("place") != F.col("via")).select(F.col("via").alias("node"))
        here = best.join(nxt, "node").select(F.col("node").alias("place"), "via")
        hop += 1
    return reduce(DataFrame.unionByName, path) if path else here.select("place", F.lit(0).alias("hop"))


def running_ledger(tx: DataFrame, account: str, order: list[str], amount: Column) -> DataFrame:
    """Ordered transactions with balance per account, summed month by month."""
    parts = sized_chunks(tx, [account], order, F.date_trunc("month", F.col(order[0])))
    return running_sum_within(parts, [account], order, amount, "balance", F.col("_part")).drop("_part")


def k_hop_neighbours(edges: DataFrame, a: str, b: str, node, k: int) -> DataFrame:
    """Nodes within ``k`` steps of a node with the number of steps."""
    return shortest_paths(edges, a, b, node, None, float(k)).select(
        "node", F.col("cost").cast("long").alias("steps"))


def ownership_chain(shares: DataFrame, child: str, owner: str, share: str, tolerance: float = 1e-9) -> DataFrame:
    """Indirect share of each ultimate owner in each company, along all paths.

    Rounds move the product of shares one owner up; paths that meet at the same
    owner are added up before the next round. Owners nobody owns are ultimate.
    Chains of any length are followed to their end. Shares that loop shrink with
    every turn and are dropped once they are at most ``tolerance``; a loop whose
    shares never shrink has no end and raises.
    """
    links = cut_lineage(
        shares.where(F.col(child) != F.col(owner))
        .groupBy(F.col(child).alias("c"), F.col(owner).alias("o")).agg(F.sum(share).alias("s")))
    owned = links.select(F.col("c").alias("holder")).distinct()
    live = links.select(F.col("c").alias("company"), F.col("o").alias("holder"), F.col("s").alias("part"))
    done = [live.limit(0)]
    nodes, rounds, before = owned.count() + 1, 0, None
    while True:
        live = cut_lineage(live.where(F.col("part") > tolerance))
        left = live.agg(F.sum("part")).first()[0]
        if left is None:
            break
        if rounds > nodes and before is not None and left >= before:
            raise ValueError("ownership loops without losing any share")
        before = left
        done.append(live.join(owned, "holder", "left_anti"))
        live = (
            live.join(links, live["holder"] == links["c"])
            .select("company", F.col("o").alias("holder"), (F.col("part") * F.col("s")).alias("part"))
            .groupBy("company", "holder").agg(F.sum("part").alias("part")))
        rounds += 1
    return reduce(DataFrame.unionByName, done).groupBy("company", "holder").agg(F.sum("part").alias("part"))


def degree_centrality(edges: DataFrame, a: str, b: str, weight: Column | None = None) -> DataFrame:
    """In, out and total degree and weighted total, in one aggregation of edge ends."""
    w = F.lit(1.0) if weight is None else weight
    out = edges.select(F.col(a).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), w.alias("w"))
    into = edges.select(F.col(b).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), w.alias("w"))
    return out.unionByName(into).groupBy("node").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
        F.count("*").alias("degree"), F.sum("w").alias("weight"))


def co_membership(members: DataFrame, group: str, member: str, min_shared: int) -> DataFrame:
    """Pairs of groups that share at least ``min_shared`` members, with the number shared.

    Members are ordered rarest first and each group is indexed by its rarest
    members only, leaving out the ``min_shared - 1`` most common: two groups that
    share enough must meet on one that is left. Common members, which would pair
    almost every group with every other, are thus never used to find pairs; they
    only count in the exact check, which looks at no more than twice
    ``min_shared - 1`` members of a pair.
    """
    pairs = cut_lineage(members.select(group, member).distinct())
    size = pairs.groupBy(member).agg(F.count("*").alias("_f"))
    ranked = pairs.join(size, member)
    # the most common members of each group are the ones left out of the index
    common = top_k_per_group(ranked, [group], [F.desc("_f"), F.desc(member)], min_shared - 1).select(group, member)
    common = cut_lineage(common)
    index = cut_lineage(ranked.join(common, [group, member], "left_anti").select(group, member))
    left = index.select(member, F.col(group).alias("a"))
    right = index.select(member, F.col(group).alias("b"))
    met = cut_lineage(left.join(right, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")))
    # what both index is counted where they meet; the rest is common to a or, if a indexes it, to b
    def of(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(F.col(group).alias(side), F.col(member).alias("m"))

    found = met.select("a", "b")
    rest = found.join(of(common, "a"), "a").join(of(pairs, "b"), ["b", "m"], "left_semi").unionByName(
        found.join(of(common, "b"), "b").join(of(index, "a"), ["a", "m"], "left_semi"))
    rest = rest.groupBy("a", "b").agg(F.count("*").alias("n"))
    shared = met.unionByName(rest).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    return shared.where(F.col("shared") >= min_shared)


def page_rank(edges: DataFrame, a: str, b: str, tolerance: float = 1e-6, damping: float = 0.85,
              rounds: int | None = None) -> DataFrame:
    """Importance by links; dead ends share their rank out evenly.

    Runs until no rank moves by more than ``tolerance`` of the mean rank, which a
    damping below one reaches in about log(tolerance) / log(damping) rounds. With
    ``rounds`` exactly that many are made.
    """
    links = placed(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct(), "src")
    degree = links.groupBy("src").agg(F.count("*").alias("deg"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = cut_lineage(nodes.join(degree, nodes["node"] == degree["src"], "left").select("node", "deg"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    done = 0
    while n and (rounds is None or done < rounds):
        lost = ranks.where("deg IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        flow = (
            ranks.where("deg IS NOT NULL").withColumnRenamed("node", "src").join(links, "src")
            .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("flow")))
        rank = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + lost / n)
        old = ranks.select("node", F.col("rank").alias("old"))
        moved = cut_lineage(
            nodes.join(flow, "node", "left").select("node", "deg", rank.alias("rank")).join(old, "node"))
        ranks = moved.drop("old")
        done += 1
        if rounds is None and moved.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] * n <= tolerance:
            break
    return ranks.select("node", "rank")


#: Neighbours of a node that stand in one row.
LIST_ROWS = 1 << 16


def _numbered(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """``edges`` as numbers (src, dst) and (node, id), the number of each name in order; null is -1."""
    named = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    names = value_ranks(named.select(F.col("a").alias("node")).union(named.select("b")), [], "node")
    ids = cut_lineage(names.select("node", F.col("distinct_before").alias("id")))
    kind = "int" if ids.count() < 1 << 31 else "bigint"
    number = F.coalesce("id", F.lit(-1)).cast(kind)
    half = named.join(ids.withColumnRenamed("node", "a"), "a", "left").select(number.alias("src"), "b")
    pairs = cut_lineage(half.join(ids.withColumnRenamed("node", "b"), "b", "left").select("src", number.alias("dst")))
    discard(named)
    return pairs, ids


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(dst, srcs): the nodes around every node, each once, in lists of about ``LIST_ROWS`` at most, placed by ``dst``."""
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("dst >= 0")
    degree = both.groupBy("dst").agg(F.count("*").alias("n"))
    hubs = cut_lineage(degree.where(F.col("n") > LIST_ROWS).select("dst", F.ceil(F.col("n") / LIST_ROWS).alias("lists")))
    dealt = both.join(hubs, "dst", "left").select(
        "dst", "src", F.coalesce(F.pmod(F.hash("src"), F.col("lists")), F.lit(0)).alias("list"))
    return placed(dealt, "dst", made=lambda rows: rows.groupBy("dst", "list").agg(F.collect_set("src").alias("srcs")).drop("list"))


def communities(edges: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """Groups by label propagation: most common label around, ties to the smallest.

    A node keeps its own label as one vote, which stops two-sided graphs from swapping
    for ever. Runs until no label changes, or until the number of changes has not
    reached a new low for ten rounds, as labels can circle; ``converged`` tells which.
    With ``rounds`` at most that many are made.
    """
    pairs, ids = _numbered(edges, a, b)
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    links = _neighbours(pairs)
    discard(pairs)
    done, least, stale, changed = 0, None, 0, None
    while rounds is None or done < rounds:
        votes = links.join(labels, links["dst"] == labels["node"]).select(F.explode("srcs").alias("node"), labels["label"])
        own = labels.select("node", "label", F.col("label").alias("old"))
        # a vote moves once, to its node
        cast = votes.unionByName(own, allowMissingColumns=True).repartition("node")
        counted = cast.groupBy("node", "label").agg(F.count("*").alias("n"), F.max("old").alias("old"))
        best = counted.groupBy("node").agg(
            F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.max("old").alias("old"))
        nxt = cut_lineage(best.select("node", "b.label", "old"))
        # a null node is never known to be settled
        changed = nxt.where("label <> old OR node < 0").count()
        discard(labels)
        labels = nxt
        done += 1
        stale = 0 if least is None or changed < least else stale + 1
        least = changed if least is None else min(least, changed)
        if not changed or (rounds is None and stale >= 10):
            break
    discard(links)
    named = labels.join(ids.select("node", F.col("id").alias("label")).withColumnRenamed("node", "community"), "label", "left")
    return named.withColumnRenamed("node", "id").join(ids, "id", "left").select(
        "node", "community", F.lit(changed == 0).alias("converged"))

"""Graph steps whose work grew faster than their input."""

import itertools
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import graph
from gleaner.plans import scale


def test_shared_members_are_counted_where_groups_meet(spark, monkeypatch):
    rnd, least, kept = random.Random(5), 4, []

    def keep(df, real=graph.cut_lineage):
        kept.append(real(df))
        return kept[-1]

    monkeypatch.setattr(graph, "cut_lineage", keep)
    rows = {(f"g{rnd.randrange(9)}", rnd.randrange(60)) for _ in range(400)}
    got = {(r.a, r.b): r.shared for r in graph.co_membership(
        spark.createDataFrame(sorted(rows), "g string, m long"), "g", "m", least).collect()}
    sets = {}
    for g, m in rows:
        sets.setdefault(g, set()).add(m)
    both = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    assert got == {p: n for p, n in both.items() if n >= least}
    met = {(r.a, r.b): r.n for r in kept[-1].collect()}  # no more than the common members of either are left to check
    assert all(0 <= both[p] - n <= 2 * (least - 1) for p, n in met.items())


def _settle(edges):
    """Label propagation as ``communities`` does it, on names in memory; null sorts first and is never settled."""
    both = {(x, y) for x, y in edges} | {(y, x) for x, y in edges}
    order = lambda v: (v is not None, v)
    label, least, stale = {x: x for x, _ in both}, None, 0
    while True:
        votes = {x: Counter([label[x]]) for x in label}
        for x, y in both:
            if y is not None:
                votes[x][label[y]] += 1
        new = {x: min(v, key=lambda one: (-v[one], order(one))) for x, v in votes.items()}
        changed = sum(x is None or new[x] != label[x] for x in new)
        label, stale = new, 0 if least is None or changed < least else stale + 1
        least = changed if least is None else min(least, changed)
        if not changed or stale >= 10:
            return {x: (c, not changed) for x, c in label.items()}


@pytest.mark.parametrize("nulls", [False, True])
def test_communities_do_not_depend_on_lists_of_neighbours(spark, monkeypatch, nulls):
    rnd = random.Random(3)
    edges = [(f"s{min(rnd.randrange(9), rnd.randrange(9))}", f"c{rnd.randrange(40)}") for _ in range(150)]
    edges += [("s1", "s1"), ("c3", "s2"), ("c3", "s2")] + ([(None, "c1"), ("s4", None), (None, None)] if nulls else [])
    df, want = spark.createDataFrame(edges, "a string, b string"), _settle(edges)
    for most in (1 << 16, 4):
        monkeypatch.setattr(graph, "LIST_ROWS", most, raising=False)
        got = [(r.node, (r.community, r.converged)) for r in graph.communities(df, "a", "b").collect()]
        assert len(got) == len(want) and dict(got) == want
    assert graph.communities(df.limit(0), "a", "b").count() == 0


def test_rounds_of_communities_leave_nothing_on_disk(spark):
    """One label table stays however many rounds were made, and no links."""
    def left(nodes):
        before = set(os.listdir(folder))
        rows = graph.communities(spark.range(nodes).select("id", (F.col("id") + 1).alias("next")), "id", "next", rounds).collect()
        assert len(rows) == nodes + 1
        return len(set(os.listdir(folder)) - before)

    cut = scale.cut_lineage(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert cut.count() == 1
    rounds = 2
    few = left(60)
    rounds = 9
    assert left(60) == few <= 5


def test_shuffle_files_go_when_a_checkpoint_is_there(spark):
    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {str(found.apply(i)) for i in range(found.size()) if str(found.apply(i)).startswith("shuffle_")}

    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = scale.cut_lineage(df)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == df.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    scale.discard(kept, df, None)
    with pytest.raises(Exception, match="(?i)checkpoint|not exist|no such"):
        kept.collect()

"""Profiles, summaries, alerts and loops over links: what moves per row."""

import pandas as pd
from pyspark.sql import functions as F

from gleaner.operators import text
from gleaner.plans import scale
from gleaner.sources import profile
from gleaner.streaming.operators import EdgeTrigger


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_placed_table_is_not_moved_again_by_joins_on_its_key(spark):
    left = spark.range(500).select((F.col("id") % 7).alias("src"), "id")
    right = spark.range(7).select(F.col("id").alias("src"), (F.col("id") * 2).alias("twice"))
    links = scale.placed(left, "src")
    joined = links.hint("merge").join(right, "src")
    assert _plan(joined).count("Exchange") == 1
    assert joined.agg(F.sum("twice")).first()[0] == sum(i % 7 * 2 for i in range(500))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_profile_values_travel_short_and_stay_apart(spark):
    long = ["x" * 40 + str(i) for i in range(3)]
    rows = [(i % 3, None if i % 4 == 0 else ("" if i % 4 == 1 else long[i % 3]), float(i % 2)) for i in range(24)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    got = profile.table_profile({"t": df}, exact=True)
    assert "xxhash64" not in _plan(got)
    assert {r.column: (r.type, r.rows, r.null_share, r.distinct_values) for r in got.collect()} == {
        "a": ("bigint", 24, 0.0, 3), "b": ("string", 24, 0.25, 4), "c": ("double", 24, 0.0, 2)}


def test_common_words_are_weighed_where_they_are_read(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"the the cat. the dog{i} sat. the the the the") for i in range(12)], "id long, t string")
    rows = []
    for most in (1, 3, 4096):
        monkeypatch.setattr(text, "COMMON_WORDS", most, raising=False)
        got = text.summarise_extractive(docs, "id", "t", 2)
        assert "BroadcastHashJoin" in _plan(got) and "LeftAnti" in _plan(got)
        rows.append(sorted((r.id, r.position, r.at, round(r.score, 9), r.sentence) for r in got.collect()))
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 24


def test_one_state_serves_all_keys_of_a_bucket():
    class State:
        value, writes = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

    trigger = EdgeTrigger("k", 10.0)
    trigger.state = State()

    def run(*rows):
        (out,) = trigger.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["k", "window_start", "total"])]), None)
        return sorted(out.itertuples(index=False, name=None), key=str)

    assert run(("a", 1, 12.0), ("b", 1, 3.0), ("b", 2, 11.0), (None, 1, 20.0)) == [("a", 1, 12.0), ("b", 2, 11.0), (None, 1, 20.0)]
    assert run(("a", 3, 15.0), ("b", 3, 1.0), (None, 4, 30.0)) == [] and run(("b", 4, 10.0)) == [("b", 4, 10.0)]
    assert trigger.state.writes == 3


def test_clustering_splits_texts_once(spark, monkeypatch):
    kept = []

    def keep(df, real=text.cut_lineage):
        kept.append(df.columns)
        return real(df)

    monkeypatch.setattr(text, "cut_lineage", keep)
    docs = spark.createDataFrame([(i, f"red blue {i}" if i % 2 else f"cold warm {i}") for i in range(20)], "id long, t string")
    got = {r.id: r.cluster for r in text.cluster_texts(docs, "id", "t", 2).collect()}
    assert len(got) == 20 and kept == [["id", "tf"]]

"""Plan building blocks against plain windows, with hot keys, ties and nulls."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.plans import scale as P
from gleaner.plans.forest import ancestor_rows, resolve_parents


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows sit on one key; one key is null."""
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        rows.append((key, i, rnd.randint(0, 40), rnd.choice([None, 1.0, 2.0, 5.0])))
    return spark.createDataFrame(rows, "k string, i int, at int, v double").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_lag_equals_plain_window(hot):
    w = Window.partitionBy("k").orderBy("at", "i")
    got = P.lag_within(hot, ["k"], ["at", "i"], ["v", "i"], F.floor(F.col("at") / 7))
    same(got.select("k", "i", "prev_v", "prev_i"),
         hot.select("k", "i", F.lag("v").over(w).alias("prev_v"), F.lag("i").over(w).alias("prev_i")))


def test_running_sum_equals_plain_window(hot):
    w = Window.partitionBy("k").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0)
    got = P.running_sum_within(hot, ["k"], ["at", "i"], F.col("i"), "s", F.floor(F.col("at") / 7))
    same(got.select("k", "i", "s"), hot.select("k", "i", F.sum("i").over(w).alias("s")))


def test_carry_forward_equals_plain_window(hot):
    w = Window.partitionBy("k").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0)
    got = P.carry_forward_within(hot, ["k"], ["at", "i"], "v", "c", F.floor(F.col("at") / 7))
    same(got.select("k", "i", "c"), hot.select("k", "i", F.last("v", True).over(w).alias("c")))


def test_session_numbers_equal_plain_window(hot):
    w = Window.partitionBy("k").orderBy("at", "i")
    begins = F.when(F.lag("at").over(w).isNull() | (F.col("at") - F.lag("at").over(w) > 1), 1).otherwise(0)
    want = hot.withColumn("b", begins).withColumn(
        "n", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = P.session_numbers(hot, ["k"], ["at", "i"], lambda x, y: y - x > 1, F.floor(F.col("at") / 7))
    same(got.select("k", "i", F.col("session_no").alias("n")), want.select("k", "i", "n"))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_value_ranks(hot, keys):
    w = Window.partitionBy(*keys).orderBy("at")
    want = hot.select(*keys, "at", (F.rank().over(w) - 1).cast("long").alias("before"),
                      (F.dense_rank().over(w) - 1).cast("long").alias("d")).distinct()
    got = P.value_ranks(hot, keys, "at").select(*keys, "at", "before", F.col("distinct_before").cast("long").alias("d"))
    same(got, want)


def test_quantiles_equal_percentile(hot):
    want = hot.groupBy("k").agg(F.percentile("at", 0.25).alias("q1"), F.percentile("at", 0.9).alias("q9"))
    got = P.exact_quantiles(hot, ["k"], "at", {"q1": 0.25, "q9": 0.9})
    rows = {r["k"]: r for r in got.collect()}
    for r in want.collect():
        assert rows[r["k"]]["q1"] == pytest.approx(r["q1"])
        assert rows[r["k"]]["q9"] == pytest.approx(r["q9"])


def test_as_of_join_takes_latest_at_or_before(spark):
    left = spark.sql("SELECT * FROM VALUES ('a', date'2024-03-05', 1), ('a', date'2024-01-01', 2), ('b', date'2024-05-01', 3) t(k, d, id)")
    right = spark.sql("SELECT * FROM VALUES ('a', date'2024-01-20', 'x'), ('a', date'2024-03-05', 'y'), ('a', date'2024-04-01', 'z') t(k, s, v)")
    got = {r["id"]: r["v"] for r in P.as_of_join(left, right, ["k"], "d", "s", ["v"], "month").collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_parents_with_loop_chain_and_stranger(spark):
    edges = [(1, 0), (2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (13, 12), (20, None), (21, 99)]
    df = spark.createDataFrame(edges, "n long, p long")
    got = {r["n"]: (r["root"], r["depth"], r["on_loop"]) for r in resolve_parents(df, [], "n", "p").collect()}
    assert got[3] == (0, 3, False) and got[20] == (20, 0, False) and got[21] == (99, 1, False)
    assert all(got[i][2] for i in (10, 11, 12, 13))
    rows = ancestor_rows(df.where("n < 5"), "n", "p").collect()
    assert sorted((r["n"], r["hop"], r["place"]) for r in rows) == [
        (1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (3, 3, 0)]


def test_long_chain_takes_few_rounds(spark):
    df = spark.range(1, 300).select(F.col("id").alias("n"), (F.col("id") - 1).alias("p"))
    got = resolve_parents(df, [], "n", "p").agg(F.max("depth"), F.max("root")).first()
    assert tuple(got) == (299, 0)


def test_lineage_is_cut_into_the_named_folder(spark):
    df = P.cut_lineage(spark.range(10))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert df.count() == 10


@pytest.fixture(scope="module")
def one_day(spark):
    """A third of all rows belong to one key on one day, many of them at one moment."""
    rnd = random.Random(4)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), i, 5 if i % 3 == 0 else rnd.randint(0, 9),
             rnd.choice([None, 1, 2])) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, i int, day int, v int").repartition(5)


def test_a_key_busy_within_one_chunk_is_cut_by_size(one_day):
    most = 200
    parts = P.sized_chunks(one_day, ["k"], ["day", "i"], F.col("day"), most)
    largest = parts.groupBy("k", "_part").count().agg(F.max("count")).first()[0]
    assert largest <= most and parts.count() == one_day.count()
    w = Window.partitionBy("k").orderBy("day", "i")
    got = P.lag_within(parts, ["k"], ["day", "i"], ["v"], F.col("_part"))
    same(got.select("k", "i", "prev_v"), one_day.select("k", "i", F.lag("v").over(w).alias("prev_v")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = P.running_sum_within(parts, ["k"], ["day", "i"], F.col("v"), "s", F.col("_part"))
    same(got.select("k", "i", "s"), one_day.select("k", "i", F.sum("v").over(upto).alias("s")))
    got = P.running_within(parts, ["k"], ["day", "i"], {"x": F.col("i")}, F.col("_part"), F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    same(got.select("k", "i", "x"), one_day.select("k", "i", F.bit_xor("i").over(upto).alias("x")))


def test_rows_at_one_moment_are_cut_too_and_quiet_keys_are_left(one_day):
    parts = P.sized_chunks(one_day, ["k"], ["day"], F.col("day"), 200)
    assert parts.where("k = 'hot'").groupBy("_part").count().agg(F.max("count")).first()[0] <= 200
    assert P.sized_chunks(one_day, ["k"], ["day"], F.col("day")).where("_part != day").count() == 0
    assert P.sized_chunks(one_day.limit(0), ["k"], ["day"], F.col("day")).count() == 0


@pytest.mark.parametrize("most", [100, 1 << 20])
def test_operators_give_the_same_whatever_the_size_of_parts(spark, monkeypatch, most):
    from gleaner.operators import geo, graph, stats, web

    monkeypatch.setattr(P, "CHUNK_ROWS", most)
    df = spark.range(1500).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 17) AS ts", "id % 4 AS v",
        "cast(id % 50 AS double) AS lat", "cast(id % 80 AS double) AS lon")
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same(graph.running_ledger(df, "k", ["ts", "id"], F.col("v")).select("id", "balance"),
         df.select("id", F.sum("v").over(upto).alias("balance")))
    same(web.traffic_log_timeline(df, "k", ["ts", "id"]).select("id", "seq"), df.select("id", F.row_number().over(w).alias("seq")))
    legs = geo.trajectory_segments(df, "k", ["ts", "id"])
    same(legs.select("id", "prev_lat"), df.select("id", F.lag("lat").over(w).alias("prev_lat")).where("prev_lat IS NOT NULL"))
    runs = df.withColumn("c", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1)).withColumn("r", F.sum("c").over(upto))
    same(web.dns_history(df, "k", ["ts", "id"], "v").select("k", "v", "sightings"),
         runs.groupBy("k", "r", "v").agg(F.count("*").alias("sightings")).select("k", "v", "sightings"))
    s = stats.sessionise(df, ["k"], ["ts", "id"], 60)
    gap = F.coalesce((F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) > 60).cast("int"), F.lit(1))
    same(s.select("id", F.col("session_no").cast("long").alias("n")), df.withColumn("g", gap).select("id", F.sum("g").over(upto).alias("n")))
    left = df.where("id % 5 = 0").selectExpr("k", "ts AS asked", "id")
    got = P.as_of_join(left, df.where("id % 2 = 1").selectExpr("k", "ts AS on", "v"), ["k"], "asked", "on", ["v"])
    assert got.count() == left.count()

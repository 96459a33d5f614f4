"""Versions compare by all their parts."""

from pyspark.sql import functions as F

from gleaner.functions.webcols import version_number


def test_all_parts_count(spark):
    pairs = [("1.2.1500", "1.3.500", -1), ("1.2.3.4", "1.2.3.5", -1), ("1.2", "1.2.0", 0), ("2.10", "2.9.9", 1),
             ("1.0.0.1", "1", 1), ("1.2000", "3.0", -1), ("0.0", None, 0), ("x", "0", 0), ("9", "10", -1), ("1.3.0-beta", "1.3.0", -1), ("1.3.0-beta", "1.2.9", 1), ("1.3-alpha", "1.3.0-beta", -1),
             ("1.3.0-beta.2", "1.3.0-beta.11", -1), ("1.3.0-2", "1.3.0-beta", -1), ("v1.4", "1.4.0", 0), ("1.4+x-y", "1.4", 0), ("1.3-rc", "1.3.0.5", -1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    a, b = version_number(F.col("a")), version_number(F.col("b"))
    got = df.select("want", F.when(a > b, 1).when(a < b, -1).otherwise(0).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]

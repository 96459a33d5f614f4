"""Searchable list of tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Times as JSON keep all their digits, so that values a microsecond apart count as two.
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def table_profile(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    """Type, row count, null share and distinct count of every column, one pass per table.

    Distinct counts are sketches unless ``exact``; then values are counted per column first. There a value
    travels as its JSON if that has fewer than 16 bytes, else as the 16 bytes of its digest.
    """
    out = []
    for name, df in tables.items():
        types = dict(df.dtypes)
        if exact:
            # a value without its frame {"v":, or nothing
            cells = df.select(F.inline(F.array(*[
                F.struct(F.lit(i).alias("at"), F.when(F.col(c).isNotNull(), F.substr(
                    F.to_json(F.struct(F.col(c).alias("v")), MICROSECONDS), F.lit(6))).otherwise("").alias("v"))
                for i, c in enumerate(df.columns)])))
            short = F.when(F.octet_length("v") < 16, F.col("v").cast("binary")).otherwise(F.unhex(F.md5("v")))
            per_value = cells.groupBy("at", short.alias("d")).agg(F.count("*").alias("n"))
            gone = F.octet_length("d") == 0
            rows = per_value.groupBy("at").agg(
                F.sum("n").alias("rows"), (F.sum(F.when(gone, F.col("n")).otherwise(0)) / F.sum("n")).alias("null_share"),
                F.count_if(~gone).alias("distinct_values"))
            rows = rows.withColumn("column", F.array(*[F.lit(c) for c in df.columns])[F.col("at")])
        else:
            wide = df.agg(
                F.count("*").alias("_rows"),
                *[F.count(c).alias(f"n_{c}") for c in df.columns],
                *[F.approx_count_distinct(c).alias(f"d_{c}") for c in df.columns])
            rows = wide.select(F.inline(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"),
                         F.when(F.col("_rows") > 0, 1 - F.col(f"n_{c}") / F.col("_rows")).otherwise(0.0).alias("null_share"),
                         F.col(f"d_{c}").alias("distinct_values")) for c in df.columns])))
        kind = reduce(lambda acc, kv: acc.when(F.col("column") == kv[0], kv[1]), types.items(),
                      F.when(F.lit(False), ""))
        out.append(rows.select(F.lit(name).alias("table"), "column", kind.alias("type"), "rows", "null_share", "distinct_values"))
    return reduce(DataFrame.unionByName, out)

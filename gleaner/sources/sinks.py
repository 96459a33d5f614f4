"""Writers: flat exports, graph tables, routed folders, snapshots."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.sources.files import escape_breaks

def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = "/tmp/gleaner-checkpoints"
    return os.path.join(base, f"gleaner-{uuid.uuid4().hex}")


def flatten(df: DataFrame) -> DataFrame:
    """Arrays joined with ``|`` and nested fields lifted, so that any row fits a flat file."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat_ws("|", F.transform(F.col(f.name), lambda x: x.cast("string"))).alias(f.name))
        elif isinstance(f.dataType, T.StructType):
            cols += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Flat export with header; line breaks are marked so that every row stays on one line."""
    flat = flatten(df)
    lines = flat.select(*[escape_breaks(F.col(n)).alias(n) if kind == "string" else F.col(n) for n, kind in flat.dtypes])
    lines.write.csv(path, header=True, sep=sep, escape='"', mode="overwrite",
                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.json(path, mode="overwrite")


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    """Rows as XML items."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).mode("overwrite").save(path)


def write_graph_tables(edges: DataFrame, a: str, b: str, path: str) -> None:
    """Node table (key, degree) and weighted edge table for graph tools."""
    weighted = edges.groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(F.count("*").alias("weight"))
    ends = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    ends.groupBy("node").agg(F.count("*").alias("degree")).write.mode("overwrite").parquet(f"{path}/nodes")
    weighted.write.mode("overwrite").parquet(f"{path}/edges")


def write_routed(df: DataFrame, path: str, key: str) -> None:
    """Rows routed into one folder per value of ``key``."""
    df.write.partitionBy(key).mode("overwrite").parquet(path)


def append_snapshot(df: DataFrame, content: str, captured_on: str, path: str) -> None:
    """Add only content not captured before, one folder per capture day.

    Content is compared by digest, null content by a mark of its own; within the new rows the first of
    equal content is kept.
    """
    spark = df.sparkSession
    fresh = df.withColumn("digest", F.coalesce(F.sha2(content, 256), F.lit("null")))
    others = [c for c in df.columns]
    fresh = fresh.groupBy("digest").agg(
        F.min_by(F.struct(*others), F.struct(captured_on, *[c for c in others if c not in (captured_on, content)])).alias("_r")
    ).select("_r.*", "digest")
    try:
        seen = spark.read.parquet(path).select("digest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        seen = None  # first capture, no folder yet
    if seen is not None:
        fresh = fresh.join(seen, "digest", "left_anti")
    fresh.write.partitionBy(captured_on).mode("append").parquet(path)


def export_issue_table(df: DataFrame, fields: dict[str, str], items: str | None, path: str) -> None:
    """Nested records as a portable table: paths picked out, one row per entry of ``items``."""
    rows = df if items is None else df.withColumn("item", F.explode_outer(items))
    write_csv(rows.select(*[F.expr(e).alias(n) for n, e in fields.items()]), path)

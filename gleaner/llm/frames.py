"""Small frame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def cols(df: DataFrame, but: tuple = ()) -> list[Column]:
    """All columns of ``df`` but those named, quoted so that any name works."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


def once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` and new columns, each computed once per row whatever later steps do with it.

    A plain projection is merged into its readers and may then run several times.
    """
    (box,) = fresh(df, "_box")
    packed = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))
    out = df.select("*", packed.alias(box))
    return out.select(*cols(df), *[F.col(f"{box}.{n}").alias(n) for n in made])


def text_of(column: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def same_key(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of the named columns, so that rows with null ids find their own."""
    cond = None
    for a, b in pairs.items():
        term = left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
        cond = term if cond is None else cond & term
    return cond


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``: smaller there than a checkpoint."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "/tmp/gleaner-checkpoints"
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

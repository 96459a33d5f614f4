"""Registry of checked queries: a Spark callable and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.plans.derive import VIEWS
from gleaner.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def four_places(c: Column) -> Column:
    """A double at four places. From 2**53 ten-thousandths on neighbouring doubles lie further apart
    than that, and the number stays as it is; ``floor`` would squeeze it into a bigint."""
    scaled = c * 10000 + 0.500001
    return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled) / 10000).otherwise(c)


def portable(df: DataFrame) -> DataFrame:
    """Plain result types: text dates, numbers with fractions as doubles at four places, joined arrays."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DayTimeIntervalType):
            c = c.cast("string")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = four_places(c.cast("double"))
        elif isinstance(t, T.ArrayType):
            c = F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))
        elif isinstance(t, (T.ShortType, T.ByteType, T.IntegerType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _expand(text: str) -> str:
    """R4(x) in check SQL stands for x at four places, as ``portable`` rounds it."""
    while (at := text.find("R4(")) >= 0:
        depth, i = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        inner = text[at + 3 : i - 1]
        text = f"{text[:at]}(floor(cast({inner} as double)*10000+0.500001)/10000){text[i:]}"
    return text


def check_sql(text: str) -> str:
    """Put the definitions of the derived views that ``text`` uses in front of it."""
    used = [f"{v} AS ({sql})" for v, sql in VIEWS.items() if v in text]
    text = _expand(text.strip())
    if not used:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(used) + "," + text[len("WITH RECURSIVE") :]
    if text.upper().startswith("WITH"):
        return "WITH " + ", ".join(used) + "," + text[len("WITH") :]
    return "WITH " + ", ".join(used) + " " + text


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with optional check SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return portable(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            ORACLES[name] = check_sql(check)
        return fn

    return register

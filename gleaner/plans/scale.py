"""Plan building blocks that keep one hot key from landing in one task.

Windows are cut into chunks (a day, a range of turns, or by size where one such
chunk is too large) and stitched through a small chunk summary; ranks and quantiles
are taken over range partitions with per-partition offsets. No helper collects a group.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _tidy(df: DataFrame):
    """Shuffle files of plans made inside are removed as soon as they have run, not when the driver collects garbage."""
    return _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder named in ``spark.checkpoint.dir``.

    What its plan shuffled is removed from disk when the checkpoint is there.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = os.path.join("/tmp", "gleaner-checkpoints")
        sc.setCheckpointDir(folder)
    with _tidy(df):
        return df.select("*").checkpoint()  # a plan of its own: others may run that of df again


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of checkpoints that nothing will read again; loops call it for the rounds gone by."""
    for df in filter(None, tables):
        plan = df._jdf.queryExecution().analyzed()
        file = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def placed(df: DataFrame, *keys: str, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Checkpoint ``df`` partitioned and sorted by ``keys``, for loops that join it on them again and again.

    ``made`` may group the rows further where they lie, by ``keys`` and others.

    The joins then move and sort the other side only. Spark keeps the partitioning of a checkpoint unless the
    plan was adaptive, so it is made by a fixed one; ``df`` should be cheap to plan without sizes at run time.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with _set(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return cut_lineage(made(df.repartition(parts, *keys)).sortWithinPartitions(*keys))


def spread(df: DataFrame) -> DataFrame:
    """A scan or checkpoint with fewer partitions than cores, spread over all cores.

    For row-local work that is heavy per byte (text, page source). Inputs that
    already fill the cores, as large ones do, pass through without a shuffle.
    Do not call it on a plan that shuffles: counting partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows of one key and chunk that one task may order.
CHUNK_ROWS = 1 << 20


def sized_chunks(df: DataFrame, keys: list[str], order: list[str], chunk: Column, most: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the chunk to hand to the helpers below: never more than about ``most`` rows of a key.

    That is ``chunk`` as given, unless some key has more than ``most`` rows (CHUNK_ROWS unless given) in
    one chunk. Then the rows are range-partitioned on key and order into parts of half that size, rows
    that tie included, and the number of the part is the chunk. Part bounds are sampled, so the table is
    written once; every later step then sees the same parts. Runs a job that counts rows per key and
    chunk while the plan is built.
    """
    most = CHUNK_ROWS if most is None else most
    sizes = df.select(*keys, chunk.alias("_part")).groupBy(*keys, "_part").agg(F.count("*").alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= most:
        return df.withColumn("_part", chunk)
    ranged = df.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(
        2 * total // most + 1, *[F.col(c) for c in [*keys, *order]], F.col("_nth"))
    return cut_lineage(ranged.drop("_nth").withColumn("_part", F.spark_partition_id()))


def _chunk_keys(keys: list[str]) -> list[str]:
    return [*keys, "_chunk"]


def _ordering(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _stitch(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join a chunk summary on null-safe keys."""
    renamed = summary.select(
        *[F.col(c).alias(f"_s_{c}") for c in _chunk_keys(keys)], "_carry"
    )
    cond = None
    for c in _chunk_keys(keys):
        term = rows[c].eqNullSafe(renamed[f"_s_{c}"])
        cond = term if cond is None else cond & term
    return rows.join(renamed, cond, "left").drop(*[f"_s_{c}" for c in _chunk_keys(keys)])


def lag_within(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], chunk: Column
) -> DataFrame:
    """Add ``prev_<col>``: the value on the row before, per key in ``order``.

    ``chunk`` must not decrease along ``order`` (for example the day of the
    timestamp). Each window holds one key and chunk; the first row of a chunk
    takes the tail of the chunk before from a summary of one row per chunk.
    """
    work = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*_chunk_keys(keys)).orderBy(*order)
    tails = work.groupBy(*_chunk_keys(keys)).agg(
        F.max_by(F.struct(*cols), _ordering(order)).alias("_tail")
    )
    carries = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk"))
    )
    local = work.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        local = local.withColumn(f"prev_{c}", F.lag(c).over(w))
    out = _stitch(local, carries, keys)
    for c in cols:
        out = out.withColumn(
            f"prev_{c}",
            F.when(F.col("_rn") == 1, F.col(f"_carry.{c}")).otherwise(F.col(f"prev_{c}")),
        )
    return out.drop("_chunk", "_rn", "_carry")


def running_within(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], chunk: Column,
    fold: Callable[[Column], Column], join: Callable[[Column, Column], Column],
) -> DataFrame:
    """Add each of ``values`` folded from the first row of its key to this one in ``order``, chunk by chunk.

    ``fold`` is an aggregate (sum, bit_xor) and ``join`` puts two folded stretches together.
    """
    work = df.withColumn("_chunk", chunk).withColumn("_v", F.struct(*[v.alias(n) for n, v in values.items()]))
    w = (
        Window.partitionBy(*_chunk_keys(keys))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = work.groupBy(*_chunk_keys(keys)).agg(*[fold(F.col(f"_v.{n}")).alias(f"_t_{n}") for n in values])
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = totals.withColumn("_carry", F.struct(*[fold(F.col(f"_t_{n}")).over(before).alias(n) for n in values]))
    local = work.select("*", *[fold(F.col(f"_v.{n}")).over(w).alias(f"_l_{n}") for n in values])
    rows = _stitch(local, carries, keys)
    for n in values:
        carried = F.col(f"_carry.{n}")
        rows = rows.withColumn(n, F.coalesce(join(carried, F.col(f"_l_{n}")), carried, F.col(f"_l_{n}")))
    return rows.drop("_chunk", "_v", "_carry", *[f"_l_{n}" for n in values])


def running_sum_within(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: Column
) -> DataFrame:
    """Add ``out``: the running sum of ``value`` per key in ``order``, chunk by chunk."""
    return running_within(df, keys, order, {out: value}, chunk, F.sum, lambda a, b: a + b)


def session_numbers(
    df: DataFrame, keys: list[str], order: list[str], apart: Callable[[Column, Column], Column],
    chunk: Column,
) -> DataFrame:
    """Add ``session_no`` per key: a row starts a session when ``apart(previous, this)`` holds.

    Rows are numbered inside their chunk; one summary row per chunk tells how many
    sessions began before it and whether its first row carries one on.
    """
    ts = order[0]
    work = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*_chunk_keys(keys)).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(apart(F.lag(ts).over(w), F.col(ts)).cast("int"), F.lit(0))
    local = work.withColumn("_begins", begins).withColumn("_local", F.sum("_begins").over(upto))
    chunks = local.groupBy(*_chunk_keys(keys)).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_begins").alias("_inner")
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    opens = F.coalesce(apart(F.lag("_last").over(by_chunk), F.col("_first")).cast("int"), F.lit(1))
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_opens", opens)
    carry = F.coalesce(F.sum(F.col("_opens") + F.col("_inner")).over(earlier), F.lit(0))
    chunks = chunks.withColumn("_carry", carry + F.col("_opens"))
    rows = _stitch(local, chunks, keys)
    return rows.withColumn("session_no", F.col("_carry") + F.col("_local")).drop(
        "_chunk", "_begins", "_local", "_carry"
    )


def carry_forward_within(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, chunk: Column
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row, chunk by chunk."""
    work = df.withColumn("_chunk", chunk)
    w = (
        Window.partitionBy(*_chunk_keys(keys))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = F.when(F.col(value).isNotNull(), _ordering(order))
    tails = work.groupBy(*_chunk_keys(keys)).agg(F.max_by(F.col(value), seen).alias("_tail"))
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
    rows = _stitch(
        work.withColumn("_local", F.last(value, ignorenulls=True).over(w)), carries, keys
    )
    return rows.withColumn(out, F.coalesce("_local", "_carry")).drop("_chunk", "_local", "_carry")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    cols: list[str],
    grain: str = "day",
) -> DataFrame:
    """Give each left row the ``cols`` of the latest right row at or before its time.

    The two sides are stacked and the right payload is carried forward, so the
    cost is one shuffle on (key, chunk) and never a key's rows times a key's rows.
    ``grain`` is the chunk; a key busier than that is cut by size.
    """
    payload = F.struct(F.col(right_time).alias("as_of_time"), *[F.col(c) for c in cols])
    left_row = F.struct(*[F.col(c) for c in left.columns])
    r = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
        payload.alias("_payload"),
    )
    l = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), left_row.alias("_row")
    )
    stacked = r.unionByName(l, allowMissingColumns=True)
    parts = sized_chunks(stacked, keys, ["_t", "_side"], F.date_trunc(grain, F.col("_t")))
    filled = carry_forward_within(parts, keys, ["_t", "_side"], "_payload", "_last", F.col("_part"))
    return filled.where(F.col("_side") == 1).select("_row.*", "_last.*")


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, value): ``n`` rows hold it, ``before`` are smaller,
    ``distinct_before`` smaller values exist, and the key has ``total`` rows.

    Equal values are counted before anything moves, (keys, value) is range-partitioned,
    so that a value all keys share is spread as well, and only one total per
    (key, partition) is added up across partitions. Runs a job while the plan is built.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    )
    # Sampled range bounds may differ between runs, so the partition id is fixed
    # by writing it out once.
    placed = cut_lineage(
        counts.repartitionByRange(*[F.col(c) for c in [*keys, value]]).withColumn("_part", F.spark_partition_id())
    )
    per_part = placed.groupBy(*keys, "_part").agg(
        F.sum("n").alias("_n"), F.count("*").alias("_d")
    )
    if keys:
        whole = Window.partitionBy(*keys)
    else:  # one row per range partition
        whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        F.col("_part").alias("_s_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        F.sum("_n").over(whole).alias("total"),
    )
    cond = placed["_part"] == offsets["_s_part"]
    for k in keys:
        cond = cond & placed[k].eqNullSafe(offsets[f"_s_{k}"])
    inner = Window.partitionBy(*keys, "_part").orderBy(value)
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_nb", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn(
        "_db", F.row_number().over(inner) - 1
    )
    return ranked.join(offsets, cond).select(
        *keys,
        value,
        "n",
        (F.col("_n0") + F.col("_nb")).alias("before"),
        (F.col("_d0") + F.col("_db")).alias("distinct_before"),
        "total",
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key; ``probs`` maps output column to probability."""
    ranks = value_ranks(df, keys, value)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{side}"))
    base = ranks.groupBy(*keys).agg(F.max("total").alias("_total"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return base.select(*keys, *cols)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key with ``position``; Spark limits each map task to k per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)

"""Shards of near equal bytes by sampled splitters (DataFrame functions only).

Records are ordered by (CRC-32 of the text, id), so equal texts stand together. A
size-weighted sample of that key gives splitters at quantiles; records are put into
the ranges between them, and ranges that turn out overfull, as one hot text can make
them, are divided again by a sample of their own. Ranges bound the work of a task;
the running byte count inside them, added to the exact totals of the ranges before,
decides the shard, so the result does not depend on the sample.

Defined cases: a null text counts as empty, a record's size is its UTF-8 bytes plus
one; a null id sorts first; rows that repeat are placed each. Records of one text
whose bytes are at most ``together`` of a shard stay in one shard, larger groups are
cut at the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.frames import text_of
from gleaner.plans.scale import cut_lineage

LEAST = -(1 << 63)


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, crc) of every row; the texts themselves do not travel."""
    t = text_of(text)
    return docs.select(
        F.col(f"`{key}`").alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"))


def _draw(rows: DataFrame, rate: Column) -> list:
    """Keys drawn with probability size times ``rate``, by a hash, so that reruns draw alike."""
    u = F.pmod(F.xxhash64("crc", "id", F.lit("draw")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return rows.where(u < F.col("size") * rate).select("crc", "at_id").collect()


def _range_of(splitters: list) -> Column:
    """Number of splitters at or below the row's key, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    arr = F.array(*[F.struct(F.lit(a).alias("crc"), F.lit(b).alias("at_id")) for a, b in splitters])
    steps, step = [], 1
    while step * 2 <= len(splitters):
        step *= 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    mine = F.struct("crc", "at_id")
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when(
        (at + s <= len(splitters)) & (F.get(arr, at + s - 1) <= mine), at + s).otherwise(at))


def _quantiles(drawn: list, pieces: int) -> list:
    """``pieces`` - 1 keys at even places of a sorted sample."""
    keys = sorted((r["crc"], r["at_id"]) for r in drawn)
    return [keys[len(keys) * i // pieces] for i in range(1, pieces)] if keys else []


def split_ranges(rows: DataFrame, total: int, pieces: int, sample: int):
    """Splitters and the exact (bytes, count) of each range; no range holds over four even shares
    unless it is one key. ``rows`` is read a few times and should be written already.

    What reaches the driver is the sample, about ``sample`` keys in all per round, and the range totals.
    """
    drawn = _draw(rows, F.lit(sample / total))
    splitters = sorted({(crc, LEAST) for crc, _ in _quantiles(drawn, pieces)})
    while True:
        placed = rows.withColumn("r", _range_of(splitters))
        totals = {r["r"]: r for r in placed.groupBy("r").agg(
            F.sum("size").alias("b"), F.count("*").alias("n"),
            F.min(F.struct("crc", "at_id")).alias("lo"), F.max(F.struct("crc", "at_id")).alias("hi")).collect()}
        full = {r: t for r, t in totals.items() if t["b"] * pieces > 4 * total and t["lo"] != t["hi"]}
        if not full:
            return splitters, [(totals[r]["b"], totals[r]["n"]) if r in totals else (0, 0) for r in range(len(splitters) + 1)]
        weight = sum(t["b"] for t in full.values())
        again = placed.where(F.col("r").isin(list(full)))
        by_range: dict[int, list] = {}
        for r in again.where(F.pmod(F.xxhash64("crc", "id", F.lit(len(splitters))), F.lit(1 << 30)).cast("double")
                             < F.col("size") * (sample / weight * (1 << 30))).select("r", "crc", "at_id").collect():
            by_range.setdefault(r["r"], []).append(r)
        new = set(splitters)
        for r, t in full.items():
            parts = -(-t["b"] * pieces // total)
            new |= set(_quantiles(by_range.get(r, []), parts)) | {(t["hi"]["crc"], t["hi"]["at_id"])}
        splitters = sorted(new)


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text",
                   sample: int = 4096, rows_per_range: int = 1_000_000, together: float = 0.01) -> DataFrame:
    """(id, size, crc, shard, slot): shard 0 to ``shards`` - 1 with near equal bytes, slots gapless from 0.

    A boundary is off by half a record at most, or by half a small group of equal texts.
    """
    rows = cut_lineage(records(docs, key, text).withColumn("at_id", F.coalesce(F.col("id"), F.lit(LEAST))))
    sums = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, count = sums["b"] or 0, sums["n"]
    if not count:
        return rows.select("id", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    pieces = min(max(4 * shards, -(-count // rows_per_range)), sample)
    splitters, totals = split_ranges(rows, total, pieces, sample)
    before_b, before_n, b, n = [], [], 0, 0
    for size, rows_in in totals:
        before_b.append(F.lit(b).cast("long"))
        before_n.append(F.lit(n).cast("long"))
        b, n = b + size, n + rows_in
    placed = rows.withColumn("r", _range_of(splitters))
    order = Window.partitionBy("r").orderBy("crc", "at_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select(
        "id", "size", "crc", "r", "at_id", F.sum("size").over(order).alias("upto"), F.row_number().over(order).alias("rn"))
    group = Window.partitionBy("r", "crc")
    mid = F.col("upto") * 2 - F.col("size")
    first, whole = F.min(F.col("upto") - F.col("size")).over(group), F.sum("size").over(group)
    limit = int(total * together / shards)
    mids = run.withColumn("_mid", F.when(whole <= limit, first * 2 + whole).otherwise(mid))
    exact = lambda parts: F.get(F.array(*parts), F.col("r"))
    at = F.col("_mid").cast("decimal(38,0)") + exact(before_b) * 2
    shard = F.least(F.lit(shards - 1), F.floor(at * shards / (2 * total)).cast("int"))
    done = cut_lineage(mids.select(
        "id", "size", "crc", shard.alias("shard"), (exact(before_n) + F.col("rn") - 1).alias("place")))
    starts = done.groupBy("shard").agg(F.min("place").alias("start"))  # one row per shard
    return done.join(F.broadcast(starts), "shard").select(
        "id", "size", "crc", "shard", (F.col("place") - F.col("start")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` into one folder per shard, in slot order inside each file, and return the placing.

    Records are joined to their place by id, so ids must be unique here.
    """
    place = cut_lineage(shard_by_bytes(docs, shards, key, text))
    slim = place.select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    (docs.join(slim, docs[f"`{key}`"].eqNullSafe(slim["_id"])).drop("_id")
     .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .write.partitionBy("_shard").mode("overwrite").parquet(path))
    return place

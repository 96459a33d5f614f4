"""Streaming operators: each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.functions.rows import each
from gleaner.functions.textcols import tokens
from gleaner.functions.webcols import host_suffixes


def stream_tumbling_counts(stream: DataFrame, ts: str, kind: str, width: str, delay: str) -> DataFrame:
    """Counts per fixed window and type."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), kind)
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n"))


def stream_sliding_trend(stream: DataFrame, ts: str, item: str, value: str, width: str, slide: str, delay: str) -> DataFrame:
    """Counts and totals per item over overlapping windows."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), item)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), item, "n", "total"))


def stream_sessions(stream: DataFrame, ts: str, visitor: str, gap: str, delay: str) -> DataFrame:
    """Visit sessions as they close."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), visitor)
        .agg(F.count("*").alias("hits")).select(visitor, F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "hits"))


class EdgeTrigger(StatefulProcessor):
    """Remembers for a bucket of keys (as text) those whose last window total was over the limit."""

    def __init__(self, key: str, limit: float):
        self.key, self.limit = key, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "over array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key has one row per closed window in a batch
        windows = pd.concat(list(rows)).sort_values("window_start")
        before = set(self.state.get()[0]) if self.state.exists() else set()
        over, crossed = set(before), []
        for k, start, total in zip(windows[self.key], windows["window_start"], windows["total"]):
            if not total >= self.limit:
                over.discard(k)
            elif k not in over:
                crossed.append((k, start, float(total)))
                over.add(k)
        if over != before:
            self.state.update((list(over),))
        yield pd.DataFrame(crossed, columns=[self.key, "window_start", "total"])

    def close(self) -> None:
        pass


#: Buckets that keys are dealt into; one call and one state row for each, not for each key.
BUCKETS = 256


def stream_threshold_alert(stream: DataFrame, key: str, ts: str, value: str, limit: float, width: str, delay: str) -> DataFrame:
    """One alert each time a key's window total rises over the limit.

    Rows are added up per window first, so only one row per key and window
    reaches the Python worker, however busy the key is. State is kept for buckets of
    keys, as a call of the worker and a look at its state cost far more than a row.
    """
    totals = (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.sum(value).alias("total"))
        .select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), F.col(key).cast("string").alias(key),
                F.col("window.start").alias("window_start"), "total"))
    alerts = totals.groupBy("_bucket").transformWithStateInPandas(
        EdgeTrigger(key, limit), f"{key} string, window_start timestamp, total double", "Append", "None")
    return alerts.withColumn(key, F.col(key).cast(dict(stream.dtypes)[key]))


def stream_keyword_alert(stream: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """New texts holding watched terms, by a join with the static term table."""
    words = each(stream, [key], F.array_distinct(tokens(F.col(text))), term)
    return words.join(terms.select(term), term)


def stream_blocklist_join(stream: DataFrame, key: str, host: str, feed: DataFrame, entry: str) -> DataFrame:
    """Arriving rows whose host or a parent domain is on the feed."""
    tails = each(stream, [key, host], host_suffixes(F.col(host)), entry)
    return tails.join(feed.select(entry), entry)


def stream_latest_state(stream: DataFrame, mover: str, order: list[str], cols: list[str]) -> DataFrame:
    """Last state per mover, for update mode."""
    return stream.groupBy(mover).agg(F.max_by(F.struct(*order, *cols), F.struct(*order)).alias("_r")).select(mover, "_r.*")


def stream_dedupe(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Rows without repeats inside the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_interval_join(planned: DataFrame, actual: DataFrame, key: str, planned_at: str, actual_at: str,
                         most: str, delay: str) -> DataFrame:
    """Planned rows with the actual ones that follow within ``most``."""
    p = planned.withWatermark(planned_at, delay)
    a = actual.withWatermark(actual_at, delay).withColumnRenamed(key, "_key")
    return p.join(a, (F.col(key) == F.col("_key")) & (F.col(actual_at) >= F.col(planned_at))
                  & (F.col(actual_at) <= F.col(planned_at) + F.expr(f"interval {most}"))).drop("_key")


class DueTimer(StatefulProcessor):
    """One event-time timer per key, fired when the watermark passes the due time that was seen last."""

    def __init__(self, key: str, seen: str):
        self.key, self.seen = key, seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", "due_ms bigint, seen_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the row seen last counts, of several the latest due time
        seen, due = max((int(s), int(d)) for batch in rows for s, d in zip(batch["seen_ms"], batch["due_ms"]))
        if self.state.exists():
            old, before = self.state.get()
            if (before, old) >= (seen, due):
                return iter([])
            self.handle.deleteTimer(old)
        self.state.update((due, seen))
        self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "reminded_at": [pd.Timestamp(due, unit="ms")]})

    def close(self) -> None:
        pass


def stream_expiry_reminder(stream: DataFrame, key: str, seen: str, due: str, days_before: int, delay: str) -> DataFrame:
    """A reminder ``days_before`` the due time of each key, once the stream's time has come to it.

    A key seen again with another due time is renewed: the reminder moves with it.
    """
    kind = dict(stream.dtypes)[key]
    ms = (F.unix_millis(F.col(due).cast("timestamp")) - days_before * 86400000).alias("due_ms")
    rows = stream.where(F.col(seen).isNotNull() & F.col(due).isNotNull()).select(
        key, seen, ms, F.unix_millis(F.col(seen).cast("timestamp")).alias("seen_ms")).withWatermark(seen, delay)
    return rows.groupBy(key).transformWithStateInPandas(
        DueTimer(key, seen), f"{key} {kind}, reminded_at timestamp", "Append", "EventTime")


def stream_running_balance(stream: DataFrame, account: str, amount: str, incoming) -> DataFrame:
    """Totals in and out per account, for update mode."""
    money = F.col(amount).cast("decimal(18,2)")
    return stream.groupBy(account).agg(
        F.coalesce(F.sum(F.when(incoming, money)), F.lit(0)).alias("money_in"),
        F.coalesce(F.sum(F.when(~incoming, money)), F.lit(0)).alias("money_out"),
        F.count("*").alias("moves"))

"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows of ten words, a window a set of three-word
shingles. To hold a window a text must hold all its shingles, so it is enough to
join on one of them, the rarest in the corpus: the window's prefix. Around it the
length and position bounds say where the window must lie, and there its words are
compared.

Texts are scanned once. A bit filter of fixed size over the benchmark's shingles
keeps only stretches of words whose consecutive shingles all pass and that are long
enough for the shortest window; what is shuffled is these stretches, never a text.
Frequencies, prefixes, bounds and comparison are joins and aggregates over them.

Defined cases: words are runs of ASCII digits, ASCII letters (lower-cased) and all
characters beyond ASCII; an item of fewer than ten words is one window, one without
words has none; null has no words; rows that repeat are judged each, also under one
id; items that repeat under one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.frames import cols, fresh, text_of, written
from gleaner.llm.wordhash import Alphabet, blocks, buffers, shingles
from gleaner.plans.scale import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE, SHINGLE = 10, 3
STRETCH = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("words", T.StringType())]))


def alphabet() -> Alphabet:
    return Alphabet(lambda b: chr(b).isdigit() or chr(b).isalpha() if b < 0x80 else True, lower=True)


def words_of(text: str) -> Column:
    """The words of a text column as an array."""
    return F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(item, ws): the windows of every item."""
    rows = items.select(F.col(f"`{key}`").alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, size))).alias("ws"))


def _filter_bits(windows: DataFrame, n_bits: int) -> np.ndarray:
    """Bits set for every shingle of the windows; ``n_bits`` bounds what reaches the driver."""
    texts = windows.select(F.array_join("ws", " ").alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = alphabet()
        for b in batches:
            raw, at = buffers(b.column(0))
            begin, end, owner = letters.words(raw, at)
            h = letters.hashes(raw, begin, end)
            n = np.bincount(owner, minlength=len(at) - 1)
            places = []
            for k in range(1, SHINGLE + 1):
                g = shingles(h, k)
                use = (owner[: len(g)] == owner[k - 1 :]) & (np.minimum(n, SHINGLE)[owner[: len(g)]] == k)
                places += [_place(g[use], n_bits, i) for i in (0, 1)]
            p = np.unique(np.concatenate(places))
            yield pa.RecordBatch.from_arrays([pa.array(p >> 5), pa.array(1 << (p & 31))], ["word", "bits"])

    rows = texts.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(n_bits // 32, np.uint32)
    for r in rows.collect():
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _place(g: np.ndarray, n_bits: int, i: int) -> np.ndarray:
    return ((g >> np.uint64(32 * i)) & np.uint64(n_bits - 1)).astype(np.int64)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of True."""
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def stretches(docs: DataFrame, key: str, text: str, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """(id, n_words, found): the stretches of each text that may hold windows of these lengths."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), text_of(text).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("found", STRETCH)])
    n_bits = len(bits)
    packed = slim.sparkSession.sparkContext.broadcast(np.packbits(bits))  # a filter of fixed size
    least = {k: min((x for x in lengths if min(x, SHINGLE) == k), default=0) for k in range(1, SHINGLE + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = alphabet(), np.unpackbits(packed.value).astype(bool)
        for whole in batches:
            for b in blocks(whole, 1):
                yield one(b, letters, table)

    def one(b: pa.RecordBatch, letters: Alphabet, table: np.ndarray) -> pa.RecordBatch:
        raw, at = buffers(b.column(1))
        begin, end, owner = letters.words(raw, at)
        h = letters.hashes(raw, begin, end)
        mask = np.zeros(len(h) + 1, np.int64)  # +1 where candidates begin, -1 where they end
        for k, length in least.items():
            if not length or len(h) < k:
                continue
            g = shingles(h, k)
            hit = (owner[: len(g)] == owner[k - 1 :]) & table[_place(g, n_bits, 0)] & table[_place(g, n_bits, 1)]
            # no run may cross texts: a shingle that would is no hit
            x, y = _runs(hit)
            long = y - x >= length - k + 1
            np.add.at(mask, x[long], 1)
            np.add.at(mask, y[long] + k - 1, -1)
        open_ = np.cumsum(mask[:-1]) > 0
        x, y = _runs(open_)
        first = np.searchsorted(owner, np.arange(len(at) - 1))
        found: list[list] = [[] for _ in range(len(at) - 1)]
        for i, j in zip(x.tolist(), y.tolist()):
            while i < j:  # stretches of neighbouring texts may touch
                d = int(owner[i])
                stop = min(j, int(np.searchsorted(owner, d, "right")))
                ws = [letters.low[raw[begin[m] : end[m]]].tobytes() for m in range(i, stop)]
                found[d].append({"at": i - int(first[d]), "words": b" ".join(ws).decode("utf-8", "replace")})
                i = stop
        n = np.bincount(owner, minlength=len(at) - 1)
        kind = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n.astype(np.int64)), pa.array(found, kind)], ["id", "n_words", "found"])

    return slim.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", n_bits: int = 1 << 23) -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids) of every row; ``item_ids`` are sorted strings."""
    wins = cut_lineage(windows_of(items, item_key, item_text).distinct())
    lengths = [r["n"] for r in wins.select(F.size("ws").alias("n")).distinct().collect()]  # ten at most
    bits = _filter_bits(wins, n_bits)
    texts = cut_lineage(
        stretches(docs, key, text, bits, lengths).withColumn("row", F.monotonically_increasing_id()))
    spans = texts.select("row", F.explode("found").alias("f")).select("row", "f.at", F.split("f.words", " ").alias("ws"))

    sizes = sorted({min(n, SHINGLE) for n in lengths})
    runs = lambda ws, k: F.transform(
        F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(F.lit(k), F.array_join(F.slice(ws, i + 1, k), " ")))
    pieces = F.flatten(F.array(*[F.when(F.size("ws") >= k, F.transform(runs(F.col("ws"), k), lambda s, i: F.struct(
        s.alias("sh"), i.alias("p")))).otherwise(F.array().cast("array<struct<sh:bigint,p:int>>")) for k in sizes])) \
        if sizes else F.array().cast("array<struct<sh:bigint,p:int>>")
    around = F.transform(pieces, lambda x: F.struct(
        x["sh"].alias("sh"), x["p"].alias("p"),
        F.least(x["p"], F.lit(SIZE)).alias("lead"),
        F.slice(F.col("ws"), F.greatest(x["p"] - SIZE, F.lit(0)) + 1, 2 * SIZE).alias("near")))
    tokens = spans.select("row", "at", F.explode(around).alias("t")).select("row", "at", "t.*")
    rarity = tokens.groupBy("sh").agg(F.count("*").alias("n"))

    # the prefix of a window: its rarest shingle, if all its shingles occur
    distinct = wins.select("ws").distinct()
    own = distinct.select("ws", F.posexplode(F.coalesce(*[
        F.when(F.least(F.size("ws"), F.lit(SHINGLE)) == k, runs(F.col("ws"), k)) for k in sizes]
        or [F.array().cast("array<bigint>")])).alias("off", "sh"))
    prefix = own.join(rarity, "sh", "left").groupBy("ws").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.min_by(F.struct("off", "sh"), F.struct("n", "off")).alias("rarest"),
    ).where("least > 0").select("ws", "rarest.off", "rarest.sh")

    # window place by position bound, its fit by length bound, then its words
    met = tokens.join(prefix, "sh").where(
        (F.col("off") <= F.col("lead")) & (F.slice("near", F.col("lead") - F.col("off") + 1, F.size("ws")) == F.col("ws")))
    hits = cut_lineage(met.select(
        "row", (F.col("at") + F.col("p") - F.col("off")).alias("x"), F.size("ws").alias("len"), "ws").distinct())

    order = Window.partitionBy("row").orderBy("x", "len")
    past = F.max(F.col("x") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.col("x") + F.col("len")
    new = F.greatest(F.lit(0), upto - F.greatest(F.col("x"), F.coalesce(past, F.lit(0))))
    covered = hits.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", "ws").distinct().join(wins, "ws").groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    return texts.select("id", "n_words", "row").join(covered, "row", "left").join(named, "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, each judged apart, whatever its ``key``."""
    row, bad_row = fresh(docs, "_row", "_bad")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    bad = contamination(keyed, items, row, text).where("n_hit > 0").select(F.col("id").alias(bad_row))
    return keyed.join(bad, F.col(row) == F.col(bad_row), "left_anti").select(*cols(docs))

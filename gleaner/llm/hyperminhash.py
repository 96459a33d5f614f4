"""Near-duplicate detection with HyperMinHash sketches.

A set of n-grams is dealt ROUNDS times into BUCKETS buckets by the first bits of a hash
of each n-gram; a bucket keeps the least rest of a hash in 16 bits: the number of its
leading zeros and the MANTISSA bits after them, or EMPTY. Bands of ROWS registers are
hashed to keys; two sets whose similarity reaches the threshold of 0.85 miss each other
in all of the 32 bands with a probability below 1e-10. Bands of empty buckets show no key.

Sets that share a band meet its lead. Matching registers among those that are not empty
on both sides estimate the similarity, corrected for registers that agree by chance;
pairs whose estimate lies five deviations below what is asked for go, the rest are
verified on their full sets (``setpairs.connect``). In bands whose sets are then not all
connected, the others meet where their differences from the lead, their n-grams that no
other set has, and one bit of each register say that they may be alike; they are
estimated and verified in the same way. Verified links are connected.

Defined cases: null, empty and blank texts have no n-grams and link with nothing; texts
with fewer words than an n-gram are one n-gram as a whole; rows that repeat get the same
component; a null id is not chosen as component while another id is there; an empty table
gives no rows. Columns other than the two named are not looked at. A very long text is
hashed whole, with some 40 bytes of memory per byte. N-grams are 64-bit hashes, sets are
told apart by 64-bit handles. Sets of one band that all lie just under the threshold and
link with nothing still meet in pairs, in the condition of a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.frames import text_of, written
from gleaner.llm.setpairs import alone, alphabet, bit_filter, connect, handles, packed_texts, sets_of, smallest_ids
from gleaner.llm.wordhash import BASE, blocks, buffers, mix
from gleaner.plans.scale import cut_lineage

ROUNDS, BUCKET_BITS, MANTISSA, ROWS = 8, 4, 10, 4
BUCKETS = 1 << BUCKET_BITS
REGISTERS = ROUNDS * BUCKETS
EMPTY = np.uint16(0xFFFF)
#: Fixed value: expected share of chance agreements of registers, times 2^MANTISSA, for sets of equal size.
CHANCE = 0.169919487159739
SLACK = 5.0  # deviations
ONE = np.uint64(1)


def registers(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(sets, REGISTERS) registers of sets given as n-gram hashes, one set after the other."""
    n_sets = len(count)
    out = np.full((n_sets, REGISTERS), EMPTY, np.uint16)
    owner = np.repeat(np.arange(n_sets), count) * BUCKETS
    for r in range(ROUNDS):
        h = mix(value + BASE * np.uint64(r + 1))
        least = np.full(n_sets * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, owner + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), h << np.uint64(BUCKET_BITS))
        full = least != np.iinfo(np.uint64).max
        out[:, r * BUCKETS : (r + 1) * BUCKETS] = np.where(full, compressed(least), EMPTY).reshape(n_sets, BUCKETS)
    return out


def compressed(rest: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 62) and the MANTISSA bits after the first one, in 16 bits."""
    zeros = np.zeros(len(rest), np.uint64)
    x = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < ONE << np.uint64(64 - step)
        zeros += np.where(low, np.uint64(step), np.uint64(0))
        x = np.where(low, x << np.uint64(step), x)
    mantissa = (x << ONE) >> np.uint64(64 - MANTISSA)
    return ((np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def bands(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of every band with a register that is not empty."""
    parts = sketch.reshape(len(sketch), REGISTERS // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * BASE + parts[:, :, i] + ONE)
    shown = (parts != np.uint64(EMPTY)).any(2)
    return np.nonzero(shown)[0], key[shown]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of sketches, corrected for chance agreements, and the number of registers it rests on."""
    some = (a != EMPTY) | (b != EMPTY)
    full = some.sum(1)
    met = ((a == b) & some).sum(1) / np.maximum(full, 1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = CHANCE * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return (met - chance) / (1 - chance), full


def _rows(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, h, sketch, bands): set size and handle; sketch and band keys once per set and task."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), text_of(text).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("n", T.LongType()), T.StructField("h", T.LongType()),
                           T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen = alphabet(), set()
        for whole in batches:
            for b in blocks(whole, 1):
                raw, at = buffers(b.column(1))
                value, count = sets_of(raw, at, letters, words)
                h = handles(value, count).view(np.int64)
                new = np.zeros(len(h), bool)
                for i, x in enumerate(h.tolist()):
                    if count[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                sketch = registers(value[np.repeat(new, count)], count[new])
                owner, keys = bands(sketch)
                made: list[bytes | None] = [None] * len(h)
                lists: list[np.ndarray | None] = [None] * len(h)
                cuts = np.searchsorted(owner, np.arange(len(sketch) + 1))
                for k, i in enumerate(np.flatnonzero(new).tolist()):
                    made[i] = sketch[k].tobytes()
                    lists[i] = keys[cuts[k] : cuts[k + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(count.astype(np.int64)), pa.array(h), pa.array(made, pa.binary()),
                     pa.array(lists, pa.list_(pa.int64()))], ["id", "n", "h", "sketch", "bands"])

    return slim.mapInArrow(run, schema)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int, below: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow a similarity of ``below`` under the threshold."""
    side = lambda x: sets.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    least = percent / 100 - below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in b.columns[4:])
                alike, full = estimate(left, right, b.column(2).to_numpy(), b.column(3).to_numpy())
                use = alike >= least - SLACK * np.sqrt(least * (1 - least) / np.maximum(full, 1))
                yield b.select(["a", "b"]).filter(pa.array(use))

    return rows.mapInArrow(run, "a long, b long")


def _bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of every register as two whole numbers per set."""
    low = mix(sketch.astype(np.uint64) + BASE) & ONE
    return (low.reshape(len(sketch), 2, 64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def _with_bits(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = _bits(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(two[:, 0]), pa.array(two[:, 1])], ["h", "n", "x", "y"])

    return sets.select("h", "n", "sketch").mapInArrow(run, "h long, n long, x long, y long")


def _far(percent: int) -> int:
    """Bits in which two sketches of the threshold's similarity differ at most, with six deviations."""
    p = (1 - percent / 100) / 2
    return math.ceil(REGISTERS * p + 6 * math.sqrt(REGISTERS * p * (1 - p)))


def _links(docs: DataFrame, sets: DataFrame, text: str, words: int, percent: int, n_bits: int) -> DataFrame:
    """(a, b): verified links between set handles that connect all that the threshold connects."""
    shown = sets.select("h", "n", F.explode("bands").alias("key"))
    shared = shown.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    met = written(shown.join(cut_lineage(shared), "key"))
    texts = cut_lineage(packed_texts(docs, text, words, bit_filter(met.select("h").distinct(), n_bits)))
    own = met.join(cut_lineage(alone(texts, words)), "h", "left").select("key", "h", "n", F.coalesce("e", F.lit(0)).alias("e"))
    slim = sets.select("h", "n", "sketch")
    own = own.withColumn("u", F.col("n") - F.col("e"))
    return connect(own, texts, words, percent, lambda pairs, below: _likely(pairs, slim, percent, below),
                   cut_lineage(_with_bits(slim)), _far(percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                    n_bits: int = 1 << 22) -> DataFrame:
    """(id, n_shingles, component, kept) of every row: sets link at 100 * intersection >= percent * union.

    ``component`` is the smallest id that links reach, and the row of that id is kept. ``n_bits`` bounds
    the filter that keeps texts that share no band from travelling; a full one only lets more travel.
    """
    rows = written(_rows(docs, key, text, words))
    once = rows.where(F.col("sketch").isNotNull()).groupBy("h").agg(
        F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands"))
    sets = written(once)
    out = smallest_ids(rows, _links(docs, sets, text, words, percent, n_bits))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))

"""N-gram sets of texts and the exact overlap of pairs of them; shared by the set joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.frames import text_of, written
from gleaner.llm.wordhash import BASE, Alphabet, blocks, buffers, mix, shingles
from gleaner.operators.graph import connected_components
from gleaner.plans.scale import cut_lineage

BLANKS = frozenset((0x20, *range(0x09, 0x0E)))
BLOCK_BITS = 2  # blocks of columns


def alphabet() -> Alphabet:
    return Alphabet(lambda b: b not in BLANKS, lower=True)


def sets_of(raw: np.ndarray, at: np.ndarray, letters: Alphabet, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of every text, ascending, and how many each text has."""
    n_texts = len(at) - 1
    begin, end, owner = letters.words(raw, at)
    h = letters.hashes(raw, begin, end)
    n_words = np.bincount(owner, minlength=n_texts)
    g = shingles(h, k)
    inside = owner[: len(g)] == owner[k - 1 :]
    values, owners = [g[inside]], [owner[: len(g)][inside]]
    first = np.cumsum(n_words) - n_words
    for few in range(1, k):
        short = np.flatnonzero(n_words == few)
        if len(short):
            values.append(shingles(h, few)[first[short]])
            owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    if len(values) > 1:
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=n_texts))
    for i, j in zip((np.append(0, ends[:-1])).tolist(), ends.tolist()):
        value[i:j].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=n_texts)


def handles(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash per set, the same in any order of its elements."""
    total = np.append(np.uint64(0), np.cumsum(mix(value + BASE)))
    ends = np.cumsum(count)
    return mix(mix(total[ends] - total[ends - count]) + count.astype(np.uint64))


def bit_filter(rows: DataFrame, n_bits: int) -> np.ndarray:
    """Two bits per handle ``h`` in a filter of fixed size; ``n_bits`` bounds what reaches the driver."""
    at = F.explode(F.array(
        F.col("h").bitwiseAND(n_bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(n_bits - 1))).alias("p")
    words = rows.select(at).groupBy(F.shiftright("p", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    out = np.zeros(n_bits // 32, np.uint32)
    for b in words.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    return out


def packed_texts(docs: DataFrame, text: str, words: int, bits: np.ndarray) -> DataFrame:
    """(h, z): packed text of one document per set whose handle passes the filter."""
    slim = docs.select(text_of(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of fixed size
    n_bits = len(bits) * 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen, table = alphabet(), set(), np.unpackbits(shared.value.view(np.uint8), bitorder="little")
        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for b in blocks(whole, 0):
                raw, at = buffers(b.column(0))
                h = handles(*sets_of(raw, at, letters, words))
                low, high = h & np.uint64(n_bits - 1), (h >> np.uint64(32)) & np.uint64(n_bits - 1)
                out, made = [], []
                for i in np.flatnonzero(table[low.astype(np.intp)] & table[high.astype(np.intp)]).tolist():
                    x = int(h[i].view(np.int64))
                    if x not in seen:
                        seen.add(x)
                        out.append(x)
                        made.append(pack(raw[at[i] : at[i + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(made, pa.binary())], ["h", "z"])

    rows = slim.mapInArrow(run, "h long, z binary")
    return rows.groupBy("h").agg(F.min("z").alias("z"))


def overlaps(owner_a: np.ndarray, a: np.ndarray, owner_b: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Overlap of each pair, added up over blocks of columns by hash; -1 where it cannot reach ``need``.

    ``a`` and ``b`` are the columns of the first and second set of pair ``owner``. After each block a pair
    goes whose overlap so far and the columns that it has left cannot reach what it needs.
    """
    got, n = np.zeros(len(need), np.int64), len(need)
    block_a, block_b = (x >> np.uint64(64 - BLOCK_BITS) for x in (a, b))
    left_a, left_b = np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n)
    alive = np.minimum(left_a, left_b) >= need
    for block in range(1 << BLOCK_BITS):
        in_a, in_b = block_a == block, block_b == block
        left_a, left_b = left_a - np.bincount(owner_a[in_a], minlength=n), left_b - np.bincount(owner_b[in_b], minlength=n)
        in_a &= alive[owner_a]
        in_b &= alive[owner_b]
        owner, column = np.append(owner_a[in_a], owner_b[in_b]), np.append(a[in_a], b[in_b])
        order = np.lexsort((column, owner))
        owner, column = owner[order], column[order]
        both = (owner[1:] == owner[:-1]) & (column[1:] == column[:-1])
        got += np.bincount(owner[1:][both], minlength=n)
        alive &= got + np.minimum(left_a, left_b) >= need
    return np.where(alive, got, -1)


def products(pairs: DataFrame, texts: DataFrame, words: int, percent: int, below: float = 0.0) -> DataFrame:
    """(a, b, d, m, linked) of pairs of handles: in how many n-grams their sets differ, and a bitmap of these.

    d and m are null of pairs that lie more than ``below`` under the threshold, whose product is not formed to its end.
    """
    rows = pairs.join(texts.withColumnsRenamed({"h": "a", "z": "za"}), "a").join(
        texts.withColumnsRenamed({"h": "b", "z": "zb"}), "b").select("a", "b", "za", "zb")
    least = percent / 100 - below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, unpack = alphabet(), zstandard.ZstdDecompressor().decompress

        def some(b: pa.RecordBatch) -> pa.RecordBatch:
            sides = []
            for z in b.columns[2:]:
                raws = list(map(unpack, z.to_pylist()))
                at = np.append(0, np.cumsum([len(r) for r in raws])).astype(np.int64)
                value, count = sets_of(np.frombuffer(b"".join(raws), np.uint8), at, letters, words)
                sides.append((np.repeat(np.arange(b.num_rows), count), value, count))
            (owner_a, x, n_a), (owner_b, y, n_b) = sides
            need = np.ceil(least * (n_a + n_b) / (1 + least) - 1e-9).astype(np.int64)
            common = overlaps(owner_a, x, owner_b, y, need)
            linked = (common >= 0) & (100 * common >= percent * (n_a + n_b - common))
            bits, known = np.zeros(b.num_rows, np.uint64), common >= 0
            owner, column = np.append(owner_a, owner_b), np.append(x, y)
            use = known[owner]
            order = np.lexsort((column[use], owner[use]))
            owner, column = owner[use][order], column[use][order]
            same = np.append(False, (owner[1:] == owner[:-1]) & (column[1:] == column[:-1]))[: len(owner)]
            single = ~(same | np.append(same[1:], False)[: len(owner)])
            np.bitwise_or.at(bits, owner[single], np.uint64(1) << (column[single] >> np.uint64(58)))
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_a + n_b - 2 * common, pa.int64(), mask=~known),
                 pa.array(bits.view(np.int64), mask=~known), pa.array(linked)], ["a", "b", "d", "m", "linked"])

        for whole in batches:
            at = 0
            size = np.cumsum(pc.add(pc.binary_length(whole.column(2)), pc.binary_length(whole.column(3))).to_numpy(zero_copy_only=False))
            while at < whole.num_rows:  # about a megabyte of packed texts at once
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right")))
                yield some(whole.slice(at, stop - at))
                at = stop

    return rows.mapInArrow(run, "a long, b long, d long, m long, linked boolean")


def alone(texts: DataFrame, words: int) -> DataFrame:
    """(h, e): how many n-grams of a set no other of these sets has, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, unpack = alphabet(), zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                raws = [unpack(z) for z in b.column(1).to_pylist()]
                off = np.append(0, np.cumsum([len(r) for r in raws])).astype(np.int64)
                value, count = sets_of(np.frombuffer(b"".join(raws), np.uint8), off, letters, words)
                ends = np.append(0, np.cumsum(count)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["h", "g"])

    grams = texts.mapInArrow(run, "h long, g array<long>").select("h", F.explode("g").alias("g"))
    owners = grams.groupBy("g").agg(F.count("*").alias("k"), F.min("h").alias("h"))
    return owners.where("k = 1").groupBy("h").agg(F.count("*").alias("e"))


def connect(met: DataFrame, texts: DataFrame, words: int, percent: int, likely: Callable[[DataFrame, float], DataFrame] | None = None,
            bits: DataFrame | None = None, far: int = 0) -> DataFrame:
    """(a, b): links between set handles that connect all that the threshold connects.

    ``met`` are (key, h, n, e, u): sets of n n-grams, e of which occur in no other set, under the keys that
    linked sets share; any two linked sets share one key at least under which neither has fewer than their
    overlap as u. ``texts`` (h, z) are their packed texts. Under a key all sets meet its lead, the one
    with the fewest n-grams of its own. Then sets go whose u is too small for any size in the key, and only
    where those left are not connected, they meet, if bounds allow: the overlap is at most u on either side;
    and if both differ from the lead by d n-grams, they have at most the least d - e of these in common,
    and no more than the common bits of 64-bit maps allow, so that their own difference is known from
    below. ``bits`` (h, x, y) are 128 bits
    in which linked sets differ in ``far`` places at most. ``likely`` may drop pairs before they are counted
    out; it is given how far below the threshold they must lie.
    """
    live = written(met.where((F.col("n") - F.col("e")) * 100 >= F.col("n") * percent))
    leads = live.groupBy("key").agg(
        F.min(F.struct("e", "h")).alias("l"), F.min("n").alias("least"), F.count("*").alias("k"))
    led = written(live.join(cut_lineage(leads.where("k > 1").select("key", F.col("l.h").alias("lead"), "least")), "key"))
    first = led.where("h != lead").select(F.col("h").alias("a"), F.col("lead").alias("b")).distinct()
    tried = cut_lineage(products(likely(first, 0.3) if likely else first, texts, words, percent, 0.3))
    found = tried.where("linked").select("a", "b")

    label = connected_components(found, "a", "b").withColumnsRenamed({"node": "h", "component": "c"})
    size = F.greatest((F.col("n") + F.col("least")) * 100, F.col("n") * (100 + percent))  # of both, at the least, times 100
    may = led.where(F.col("u") * (100 + percent) * 100 >= size * percent).drop("least")
    known = cut_lineage(may.join(label, "h", "left").withColumn("c", F.coalesce("c", "h")))
    open_ = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    apart = tried.select(F.col("a").alias("h"), F.col("b").alias("lead"), "d", "m")
    none = F.lit(0).cast("long")
    is_lead = F.col("h") == F.col("lead")
    rest = known.join(cut_lineage(open_), "key").join(apart, ["h", "lead"], "left").select(
        "key", "h", "n", "c", "e", "u",
        F.when(is_lead, none).otherwise(F.col("d")).alias("d"), F.when(is_lead, none).otherwise(F.col("m")).alias("m"))
    rest = rest.withColumn("s", F.col("d") - F.least("d", "e")).withColumn("x", F.col("d") - F.bit_count("m"))
    names = "hncudmsx"
    if bits is not None:
        rest = rest.join(bits.select("h", F.col("x").alias("p"), F.col("y").alias("q")), "h")
        names += "pq"
    rest = cut_lineage(rest)
    left, right = (rest.select("key", *[F.col(x).alias(f"{x}{side}") for x in names]) for side in "ab")
    both = F.col("na") + F.col("nb")
    alike = F.least("sa", "sb", F.bit_count(F.col("ma").bitwiseAND(F.col("mb"))) + F.least("xa", "xb"))
    differ = F.coalesce(F.col("da") + F.col("db") - 2 * alike, F.lit(0))  # nothing known of a set that never met the lead
    cond = (
        (F.col("ha") < F.col("hb")) & (F.col("ca") != F.col("cb"))
        & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        & (F.least("ua", "ub") * (100 + percent) >= both * percent)
        & (differ * (100 + percent) <= both * (100 - percent)))
    if bits is not None:
        cond &= F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb"))) <= far
    pairs = left.join(right, "key").where(cond).select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.join(done, ["a", "b"], "left_anti")
    more = cut_lineage(products(likely(pairs, 0.0) if likely else pairs, texts, words, percent))
    return found.unionByName(more.where("linked").select("a", "b"))


def smallest_ids(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n_shingles, component) of ``rows`` (id, n, h) from links between handles; a set of none stands alone."""
    label = connected_components(cut_lineage(links), "a", "b").withColumnsRenamed({"node": "h", "component": "c"})
    placed = cut_lineage(rows.select("id", "n", "h").join(label, "h", "left").select("id", "n", F.coalesce("c", "h").alias("c")))
    smallest = cut_lineage(placed.where("n > 0").groupBy("c").agg(F.min("id").alias("component")))
    return placed.join(smallest, "c", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))

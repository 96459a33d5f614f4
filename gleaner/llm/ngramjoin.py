"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and n-grams columns of a sparse 0/1 matrix; the overlap of two
documents is an entry of its product with its transpose. Only columns that can tell are
multiplied: columns of one document go, and of the others a document shows its prefix,
the n - ceil(percent * n / 100) + 1 rarest of its n columns, of which linked documents
share one at least. Rarity is the class of the number of documents that have a column,
counted over the whole corpus, then the column's hash.

Equal sets are one row of the matrix, dealt into groups by a hash of the set. A group
asks for the rarity of its columns, blocked by the column's hash; a block adds up what
all groups ask and answers each. So one shuffle moves texts and one moves columns, both
once and packed, and no n-gram is a row of its own. A document that has too many columns
of its own to reach the threshold leaves before any product is formed.

Products are formed block by block of shared columns: all documents of a column meet its
lead, the one with the fewest columns of its own; their overlaps are added up over blocks
of columns by hash, and a pair is dropped as soon as what is left cannot lift it over the
bound that its sizes set. Documents that are connected already need no further products
(``setpairs.connect``), and others only under the first column that they share: a column's
place in the order says how many columns can still be shared from there on. All links between different sets are thus found or implied by
components.

Defined cases: null, empty and blank texts have no n-grams and link with nothing; texts
with fewer words than an n-gram are one n-gram as a whole; rows that repeat get the same
component; a null id is not chosen as component while another id is there; an empty table
gives no rows. Columns other than the two named are not looked at. A very long text is
hashed whole, with some 40 bytes of memory per byte. N-grams and sets are held as 64-bit
hashes; rarity is counted on 40 of these bits, which can only make a column look commoner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.frames import cols, fresh, text_of, written
from gleaner.llm.setpairs import alphabet, connect, handles, sets_of, smallest_ids
from gleaner.llm.wordhash import blocks, buffers

KEY_BITS = 40
GROUP_MB, PART_MB = 8, 32


def rarity_class(n: np.ndarray) -> np.ndarray:
    """1 for a column of one document, then one more for every doubling."""
    return (np.minimum(np.log2(n).astype(np.int64), 61) + 1 + (n > 1)).astype(np.uint8)


def prefixes(value: np.ndarray, count: np.ndarray, rare: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, column) of the prefix of every set that may link with another, without columns of one
    document; and how many of these each set has."""
    of = np.repeat(np.arange(len(count)), count)
    own = np.bincount(of[rare == 1], minlength=len(count))
    need = -(-count * percent // 100)
    order = np.lexsort((value, rare, of))
    place = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
    use = (place >= own[of]) & (place <= (count - need)[of]) & ((count - own >= need) & (count > 0))[of]
    return of[use], value[order][use], own


def _sets(docs: DataFrame, key: str, text: str, words: int, texts: bool) -> DataFrame:
    """(id, n, h): size and handle of every set; or (h, text) of the first row of every set in a task."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), text_of(text).alias("text"))
    fields = [T.StructField("h", T.LongType()), T.StructField("text", T.StringType())] if texts else [
        slim.schema["id"], T.StructField("n", T.LongType()), T.StructField("h", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen = alphabet(), set()
        for whole in batches:
            for b in blocks(whole, 1):
                value, count = sets_of(*buffers(b.column(1)), letters, words)
                h = handles(value, count).view(np.int64)
                if not texts:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype(np.int64)), pa.array(h)], ["id", "n", "h"])
                    continue
                new = []
                for i, x in enumerate(h.tolist()):
                    if count[i] and x not in seen:
                        seen.add(x)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), b.column(1).take(pa.array(new, pa.int64()))], ["h", "text"])

    return slim.mapInArrow(run, T.StructType(fields))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _values(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).ravel()


def _group(table: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Column hashes, sizes, handles and texts of the sets of a group, each once."""
    h, texts = table.column("h").to_numpy(), table.column("text").combine_chunks()
    first = np.unique(h, return_index=True)[1]
    texts = texts.take(pa.array(first))
    value, count = sets_of(*buffers(texts if isinstance(texts, pa.Array) else texts.chunk(0)), alphabet(), words)
    return value, count, h[first], texts.to_pylist()


def prefix_columns(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(h, n, e, keys, z) of every set that may link with another: its size, its columns of no other set,
    its prefix after these, rarest first, and its packed text."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("b")).first()["b"] or 0
    n_groups, n_parts = total // (GROUP_MB << 20) + 1, total // (PART_MB << 20) + 1
    dealt = _sets(docs, key, text, words, True).withColumn("g", F.pmod("h", F.lit(n_groups)))
    part_of = lambda k: (k * np.uint64(n_parts)) >> np.uint64(KEY_BITS)

    def ask(table: pa.Table) -> pa.Table:
        value, _, _, _ = _group(table, words)
        keys, n = np.unique(value >> np.uint64(64 - KEY_BITS), return_counts=True)
        cuts = np.searchsorted(part_of(keys), np.arange(n_parts + 1, dtype=np.uint64))
        rows = [(p, _planes(np.diff(keys[i:j], prepend=np.uint64(0)), 5), _planes(n[i:j], 4))
                for p, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if j > i]
        g = table.column("g")[0].as_py()
        return pa.table([pa.array(c, t) for c, t in zip([*zip(*[(p, g, k, n) for p, k, n in rows])] or [[]] * 4, (
            pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["p", "g", "columns", "n"])

    def tell(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_values(k, 5)) for k in table.column("columns").to_pylist()]
        some, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([_values(x, 4) for x in table.column("n").to_pylist()]), minlength=len(some))
        rare, ends = rarity_class(n)[at], np.cumsum([len(k) for k in keys]).tolist()
        said = [zstandard.ZstdCompressor(level=1).compress(rare[i:j].tobytes()) for i, j in zip([0, *ends], ends)]
        return pa.table({"g": table.column("g"), "p": table.column("p"), "said": pa.array(said, pa.binary())})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        value, count, h, texts = _group(left, words)
        at = np.unique(value >> np.uint64(64 - KEY_BITS), return_inverse=True)[1]
        unpack = zstandard.ZstdDecompressor().decompress
        said = sorted(zip(right.column("p").to_pylist(), right.column("said").to_pylist()))
        rare = np.frombuffer(b"".join(unpack(s) for _, s in said), np.uint8)[at]
        of, shown, own = prefixes(value, count, rare, percent)
        live = np.unique(of)
        ends = np.searchsorted(of, np.append(live, len(count))).astype(np.int32)
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.table({
            "h": pa.array(h[live]), "n": pa.array(count[live].astype(np.int64)), "e": pa.array(own[live].astype(np.int64)),
            "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(shown.view(np.int64))),
            "z": pa.array([pack(texts[i].encode()) for i in live.tolist()], pa.binary())})

    asked = dealt.groupBy("g").applyInArrow(ask, "p long, g long, columns binary, n binary")
    told = asked.groupBy("p").applyInArrow(tell, "g long, p long, said binary")
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(mark, "h long, n long, e long, keys array<long>, z binary")


def components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component) of every row: sets link at 100 * intersection >= percent * union.

    ``component`` is the smallest id that links reach.
    """
    sets = written(prefix_columns(docs, key, text, words, percent))
    met = sets.select("h", "n", "e", F.posexplode("keys").alias("place", "key"))
    met = met.select("key", "h", "n", "e", (F.col("n") - F.col("e") - F.col("place")).alias("u"))
    links = connect(met, sets.select("h", "z"), words, percent)
    return smallest_ids(_sets(docs, key, text, words, False), links)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id, where a null id comes last.

    Rows are told apart by a key of their own, so that neither a shared nor a null id keeps copies.
    Rows without n-grams are components of one row.
    """
    place, row = fresh(docs, "_place", "_row")
    id_ = F.col(f"`{key}`")
    keyed = written(docs.withColumn(place, F.struct(
        id_.isNull().alias("none"), id_.alias("id"), F.monotonically_increasing_id().alias("row"))))
    kept = components(keyed, words, percent, place, text).where(
        F.col("id").eqNullSafe(F.col("component"))).select(F.col("id.row").alias(row))
    return keyed.join(kept, F.col(f"{place}.row") == F.col(row), "left_semi").select(*cols(docs))

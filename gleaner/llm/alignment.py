"""Alignment of two tokenizers over the same texts.

A text is cut into words where neither library lets a token reach across, and a word met
first is encoded by the library itself: A gives character offsets, B the spans of its
proto. These spans are the coarse cuts. Where tokens share a character (bytes of one
character in A, byte fallback in B, whose spans are empty or overlap) they are refined
by the lengths of the tokens' decoded bytes, and a word whose decoded tokens do not
give its bytes back has no alignment. Byte ends of both sides then give everything by
sorted merging: common ends cut groups, and between two ends of either side lies just
one pair of overlapping tokens, a link.

Counts over the corpus: a block of texts adds up its links by pair of ids, the blocks'
sums are added by one aggregate, and every block gets the totals of its own pairs back,
dealt by pair and a bounded number of blocks. A block keeps its links as indexes into
its pairs meanwhile, so that no text is encoded twice and no table of pairs is
broadcast.

Defined cases: null and empty texts, and texts that either side does not give back byte
by byte (U+2581 for one, which B decodes as a blank), have no tokens, links or groups;
special strings inside texts are plain text; repeated rows count each; an empty table
gives no rows. Columns other than the two named are not looked at. A text is never cut:
its tokens, some 60 bytes of memory per byte of text, must fit in a worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import pieces, tokencount
from gleaner.llm.frames import written
from gleaner.plans.scale import cut_lineage

STEP, BLOCK, BLOCK_ROWS = 1 << 21, 1 << 23, 1 << 16  # characters aligned at once, and bytes and rows of a block
PARTS, BLOCKS_PER_CALL = 256, 128
WORDS = 400_000
#: Words that a line end keeps apart like nothing else would: no line end or blank but one in front.
PLAIN = re.compile(r" ?\S(?:.*\S)?").fullmatch
ID_BITS = 16  # ids of A, and of B
PLACES = attrgetter("id", "begin", "end")


def refined(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse byte spans and decoded sizes.

    A span that is empty or reaches into the next one ends inside a character: there the
    decoded sizes say where.
    """
    inner = starts >= ends
    inner[:-1] |= starts[1:] < ends[:-1]
    return np.where(inner, np.cumsum(sizes), ends)


def _joined(table: pa.Array, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entries of a binary column one behind the other, and where each begins (one more than entries)."""
    got = table.take(pa.array(at))
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(at) + 1] if len(at) else np.zeros(1, np.int64)
    data = got.buffers()[2]
    return (data[int(ends[0]) : int(ends[-1])].to_pybytes() if data is not None else b""), ends - ends[0]


def _strings(data: bytes, begin: np.ndarray) -> pa.Array:
    """Strings one behind the other in ``data``, from the places where each begins and its end."""
    return pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data))


class Words:
    """Ids of the tokens of words as bytes, learned from a library many at a time; two bounded generations.

    A word that its tokens do not give back has none here.
    """

    def __init__(self, spans: Callable[[str], tuple[np.ndarray, ...]], says: dict[int, bytes], most: int, blank: str = " "):
        self.spans, self.says, self.most, self.blank = spans, says, most, blank
        self.sizes = np.array([len(says.get(i, b"")) for i in range(max(says) + 1)], np.int32)
        self.kind = np.uint16 if len(self.sizes) <= 1 << 16 else np.int32
        self.said = pa.array([says.get(i, b"") for i in range(len(self.sizes))], pa.large_binary())
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        new[""] = b""
        got = list(map(new.get, words))
        missing = [i for i, ids in enumerate(got) if ids is None]
        some, texts, unknown = [], [], []
        for i in missing:
            w = words[i]
            if (ids := old.get(w)) is not None:
                got[i] = new[w] = ids
                continue
            unknown.append(i)
            text = w if self.blank == " " else w.replace(self.blank, " ")
            if not PLAIN(text):
                self._learn([w], [text])
                continue
            some.append(w)
            texts.append(text)
            if len(some) == 4096:
                self._learn(some, texts)
                some, texts = [], []
        if some:
            self._learn(some, texts)
        for i in unknown:
            got[i] = new[words[i]]
        return got

    def _learn(self, words: list[str], texts: list[str]) -> None:
        joined = "\n".join(texts)
        whole = joined.encode()
        ids, starts, ends = self.spans(joined)
        sizes = self.sizes[ids]
        said = np.cumsum(sizes)
        stops = np.array([len(whole)])
        if len(texts) > 1:  # then none holds a line end
            stops = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 0x0A), stops)
        cuts = np.searchsorted(said, stops, "right")  # tokens up to the end of each word, line ends included
        good = len(said) > 0 and _joined(self.said, ids)[0] == whole and bool(
            (refined(starts, ends, sizes) == said).all() and (said[cuts - 1] == stops).all()
            and (said[cuts[:-1]] == stops[:-1] + 1).all())
        if not good and len(words) > 1:
            for w, t in zip(words, texts):
                self._learn([w], [t])
            return
        raw, at = ids.astype(self.kind).tobytes() if good else b"", 0
        width = self.kind().itemsize
        for w, stop in zip(words, (width * cuts).tolist()):
            self.new[w] = raw[at:stop]
            at = stop + width


def _sizes(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


class Aligner:
    """Both tokenizers with their words so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        if max(vocab.values()) >> ID_BITS:
            raise ValueError(f"ids of the first tokenizer must be below {1 << ID_BITS}")
        raw = {s: b for b, s in tokencount.byte_symbols().items()}
        with open(b_path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # words bring their blank themselves
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.cutter = pieces.pieces(b_path)
        self.words_a = Words(self._spans_a, {i: bytes(raw.get(c, 0) for c in s) for s, i in vocab.items()}, WORDS)
        self.words_b = Words(self._spans_b, dict(enumerate(self.cutter.surface)), WORDS, pieces.BLANK)
        marks = (b",", b"|", b";")
        self.digits = pa.array([b"%d" % i + m for i in range(1 << ID_BITS) for m in marks], pa.large_binary())

    def _spans_a(self, text: str) -> tuple[np.ndarray, ...]:
        got = self.a.encode(text, add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(got)).reshape(-1, 2)
        if not text.isascii():  # places of characters as places of bytes
            spans = np.append(0, np.cumsum(_sizes(np.frombuffer(text.encode("utf-32-le"), np.uint32))))[spans]
        return np.array(got.ids, np.int64), spans[:, 0], spans[:, 1]

    def _spans_b(self, text: str) -> tuple[np.ndarray, ...]:
        got = self.b.encode(text, return_type="proto").pieces  # named immutable_proto before; places are of bytes
        flat = np.fromiter(chain.from_iterable(map(PLACES, got)), np.int64, 3 * len(got))
        return tuple(np.ascontiguousarray(flat.reshape(-1, 3).T))

    def _words_a(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of A of all texts, and the index of each text's first; words lie behind each other in the texts."""
        _, points, begin, _, first = tokencount.word_places(texts)
        data, owner = "".join(texts).encode(), np.repeat(np.arange(len(texts)), np.diff(first))
        if len(data) + len(texts) > len(points):  # places of characters as places of bytes
            begin = np.append(0, np.cumsum(_sizes(points)))[begin]
        return _strings(data, np.append(begin - owner, len(data))), first

    def _words_b(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of B of all texts, some of them empty, and the index of each text's first."""
        cut = list(map(self.cutter.marked, texts))
        for i, marked in enumerate(cut):
            if marked is None and "\x1f" not in texts[i]:
                cut[i] = "\x1f".join(self.cutter._words(texts[i]))
        if None in cut:
            lists = list(map(self.cutter._words, texts))
            return pa.array(chain.from_iterable(lists), pa.large_string()), np.append(0, np.cumsum(list(map(len, lists))))
        whole = "\x1f".join(cut).encode()
        at = np.flatnonzero(np.frombuffer(whole, np.uint8) == 0x1F)
        begin = np.concatenate([[0], at - np.arange(len(at)), [len(whole) - len(at)]])
        return _strings(whole.replace(b"\x1f", b""), begin), np.append(0, np.cumsum([x.count("\x1f") + 1 for x in cut]))

    @staticmethod
    def _tokens(words: pa.Array, first: np.ndarray, known: Words) -> tuple[np.ndarray, ...]:
        """(ids, byte lengths, tokens per text, whole) of texts given as words and the index of each text's first."""
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        got = pa.array(known(coded.dictionary.to_pylist()), pa.large_binary())
        raw, begin = _joined(got, at)
        ids = np.frombuffer(raw, known.kind)
        whole = np.ones(len(first) - 1, bool)
        none = pc.and_(pc.equal(pc.binary_length(got), 0), pc.greater(pc.binary_length(coded.dictionary), 0))
        if pc.any(none).as_py():
            whole = np.diff(np.append(0, np.cumsum(none.to_numpy(zero_copy_only=False)[at]))[first]) == 0
        return ids, known.sizes[ids], np.diff(begin[first] // ids.itemsize), whole

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links by text; digests; text, pair and number of its links, each pair once).

        Texts are not empty; those that do not come back have zeros and an empty digest.
        """
        ids_a, len_a, n_a, whole_a = self._tokens(*self._words_a([" " + t for t in texts]), self.words_a)
        ids_b, len_b, n_b, whole_b = self._tokens(*self._words_b(texts), self.words_b)
        # the sign that stands for a blank comes back as a blank
        good = whole_a & whole_b & ~np.array([pieces.BLANK in t for t in texts])
        if not good.all():
            use_a, use_b = np.repeat(good, n_a), np.repeat(good, n_b)
            ids_a, len_a, ids_b, len_b = ids_a[use_a], len_a[use_a], ids_b[use_b], len_b[use_b]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        in_a, in_b = (np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool) for _ in range(2))
        in_a[end_a], in_b[end_b] = True, True  # byte ends of both sides, merged by marking them
        upto_a, upto_b, upto_cut, upto_any = (np.cumsum(x) for x in (in_a, in_b, in_a & in_b, in_a | in_b))
        every = np.flatnonzero(in_a | in_b)
        stops = np.append(0, end_a)[np.append(0, np.cumsum(n_a))]  # where texts end
        counts = np.stack([n_a, n_b, np.diff(upto_cut[stops]), np.diff(upto_any[stops])])
        digests = self._digests(ids_a, ids_b, upto_cut[end_a - 1], upto_cut[end_b - 1], n_a + n_b)
        link = (np.repeat(np.arange(len(texts)), counts[3]) << 2 * ID_BITS) | (
            ids_b[upto_b[every - 1]] << ID_BITS) | ids_a[upto_a[every - 1]]
        link.sort()
        new = np.flatnonzero(np.append(True, link[1:] != link[:-1])[: len(link)])
        return counts, digests, link[new] >> 2 * ID_BITS, link[new] & ((1 << 2 * ID_BITS) - 1), np.diff(np.append(new, len(link)))

    def _digests(self, ids_a, ids_b, group_a, group_b, sizes) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each text with ``sizes`` tokens of both sides."""
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        place_a = np.arange(len(ids_a)) + before_b[group_a]
        place_b = np.arange(len(ids_b)) + upto_a[group_b]
        at = np.empty(len(ids_a) + len(ids_b), np.int64)
        at[place_a], at[place_b] = 3 * ids_a, 3 * ids_b
        at[place_a[upto_a - 1]] += 1
        at[place_b[np.cumsum(in_b) - 1]] += 2
        text, begin = _joined(self.digits, at)
        stops = begin[np.append(0, np.cumsum(sizes))].tolist()
        return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(stops, stops[1:])]


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One pair of tokenizers per worker."""
    return Aligner(a_path, b_path)


def part_of(key: np.ndarray) -> np.ndarray:
    return ((key & ((1 << ID_BITS) - 1)) * 31 + (key >> ID_BITS)) % PARTS


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, k: int) -> list[np.ndarray]:
    """The ``k`` arrays of a packed blob."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(k, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel().astype(np.int64) for p in planes]


class _Block:
    """Rows of one block while it is filled."""

    def __init__(self):
        self.ids, self.counts, self.digests, self.links, self.bytes, self.rows = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: list[str | None], both: Aligner) -> None:
        counts, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
        real = [i for i, t in enumerate(texts) if t]
        if real:
            some, made, text, key, n = both.align([texts[i] for i in real])
            counts[:, real] = some
            for i, d in zip(real, made):
                digests[i] = d
            self.links.append((np.array(real)[text] + self.rows, key, n))
        self.ids.append(ids)
        self.counts.append(counts)
        self.digests += digests
        self.rows += len(texts)
        self.bytes += sum(len(texts[i]) for i in real)

    def done(self, number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """One row with the block's texts, and one for each part of its pairs."""
        text, key, n = (np.concatenate(x) for x in zip(*self.links)) if self.links else [np.empty(0, np.int64)] * 3
        pairs, at = np.unique(key, return_inverse=True)
        order = np.lexsort((pairs, part_of(pairs)))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        total = np.bincount(at, weights=n, minlength=len(pairs)).astype(np.int64)[order]
        at, pairs = rank[at], pairs[order]
        by = np.lexsort((at, text))
        text, at, n = text[by], at[by], n[by]
        step = np.diff(at, prepend=0)
        heads = np.append(True, text[1:] != text[:-1])[: len(text)]
        step[heads] = at[heads]
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, self.rows], pa.int32()), pa.array(values, kind))
        ids = pa.concat_arrays(self.ids)
        lists = [pa.ListArray.from_arrays(pa.array([0, self.rows], pa.int32()), ids)]
        lists += [one(c, pa.int64()) for c in np.concatenate(self.counts, 1)]
        lists += [one(self.digests, pa.string()), one(np.bincount(text, minlength=self.rows), pa.int64())]
        none = lambda kind: pa.nulls(1, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), *lists, pa.array([_packed(step, n)], pa.binary()), none(pa.int32()), *[none(pa.list_(pa.int64()))] * 2], names)
        edge = np.flatnonzero(np.diff(part_of(pairs), prepend=-1))
        if len(edge):
            off = pa.array(np.append(edge, len(pairs)).astype(np.int32))
            k = len(edge)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, number)), *[pa.nulls(k, x.type) for x in lists], pa.nulls(k, pa.binary()),
                 pa.array(part_of(pairs)[edge].astype(np.int32)), *[pa.ListArray.from_arrays(off, pa.array(x)) for x in (pairs, total)]], names)


def _blocks(docs: DataFrame, key: str, text: str, paths: tuple[str, str] | None) -> DataFrame:
    """Blocks with their texts' figures (one row each, ``part`` null) and their pairs of ids by part."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    many = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(slim.schema["id"].dataType)),
        *[T.StructField(n, many) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("digests", T.ArrayType(T.StringType())),
        T.StructField("n_pairs", many), T.StructField("links", T.BinaryType()), T.StructField("part", T.IntegerType()),
        T.StructField("pairs", many), T.StructField("counts", many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*(paths or (tokencount.default_path(), pieces.default_path())))
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in batches:
            texts, i = b.column(1).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= STEP):
                    size += len(texts[j] or "")
                    j += 1
                block.add(b.column(0).slice(i, j - i), texts[i:j], both)
                i = j
                if block.bytes >= BLOCK or block.rows >= BLOCK_ROWS:
                    yield from block.done(number, schema.names)
                    number, block = number + 1, _Block()
        if block.rows:
            yield from block.done(number, schema.names)

    return slim.mapInArrow(run, schema)


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every row.

    ``paths`` are the files of A and B, there on every worker; without them each worker asks for its own.
    """
    blocks = written(_blocks(docs, key, text, paths))
    asks = blocks.where(F.col("part").isNotNull()).select("block", "part", "pairs", "counts")
    n_blocks = blocks.where(F.col("part").isNull()).count()
    totals = asks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.counts").alias("n"))
    totals = cut_lineage(totals.withColumn("b", F.shiftright("pair", ID_BITS)))
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    part = (F.col("pair").bitwiseAND((1 << ID_BITS) - 1) * 31 + F.col("b")) % PARTS
    known = totals.join(most, "b").groupBy(part.cast("int").alias("part")).agg(  # at most the pairs of two vocabularies over PARTS
        F.collect_list("pair").alias("pairs"), F.collect_list("n").alias("n"), F.collect_list(F.col("n") == F.col("most")).alias("best"))

    # a call answers the asks of one part from a bounded number of blocks
    calls = n_blocks // BLOCKS_PER_CALL + 1
    sent = known.select("part", F.explode(F.sequence(F.lit(0), F.lit(calls - 1))).alias("call"), "pairs", "n", "best")
    asked = asks.select("block", "part", F.pmod(F.xxhash64("block"), F.lit(calls)).cast("int").alias("call"), "pairs")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = [right.column(c).combine_chunks() for c in ("pairs", "n", "best")]
        pairs, n, best = (np.asarray(x.flatten().to_numpy(zero_copy_only=False)) for x in flat)
        order = np.argsort(pairs)
        pairs, n, best = pairs[order], n[order], best[order]
        said = []
        for row in left.column("pairs").combine_chunks():
            at = np.searchsorted(pairs, row.values.to_numpy(zero_copy_only=False))
            said.append(_packed(n[at], best[at]))
        return pa.table({"block": left.column("block"), "part": left.column("part"), "said": pa.array(said, pa.binary())})

    told = asked.groupBy("part", "call").cogroup(sent.groupBy("part", "call")).applyInArrow(tell, "block long, part int, said binary")
    names = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([
        T.StructField("id", blocks.schema["ids"].dataType.elementType), *[T.StructField(n, T.LongType()) for n in names],
        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("digest", T.StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        col = lambda n: left.column(n).combine_chunks().flatten()
        parts = sorted(zip(right.column("part").to_pylist(), right.column("said").to_pylist()))
        n, best = (np.concatenate(x) for x in zip(*[_unpacked(s, 2) for _, s in parts])) if parts else [np.empty(0, np.int64)] * 2
        step, times = _unpacked(left.column("links")[0].as_py(), 2)
        sizes = col("n_pairs").to_numpy()
        ends = np.cumsum(sizes)
        sums = np.cumsum(step)
        at = sums - np.repeat(np.append(0, sums)[ends - sizes], sizes)
        add = lambda x: pa.array(np.diff(np.append(0, np.append(0, np.cumsum(x))[ends])))
        return pa.table({"id": col("ids"), **{x: col(x) for x in names}, "n_best": add(times * best[at]),
                         "count_sum": add(times * n[at]), "digest": col("digests")})

    figures = blocks.where(F.col("part").isNull()).drop("part", "pairs", "counts")
    return figures.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)

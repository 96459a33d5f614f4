"""SentencePiece encoding and decoding as weighted finite-state transducers.

The model file is compiled to three transducers: the normaliser (a space in front,
blanks as U+2581), the pieces, and the fallback that writes a character without a
piece as its bytes. Composed with a text they span a lattice; the encoding is its
shortest path in the tropical semiring (min, +). For merge (BPE) models an arc that
merging would not leave beside the arc before it weighs infinity, which leaves one
path (``automata``). Decoding runs the same arcs backwards.

Words that no piece can reach across are composed once and looked up afterwards.

Defined cases: null gives null and an empty text no pieces; U+2581 in a text comes
back as a blank, all else exactly; ids outside the model fail. Files with a character
map in their normaliser, or of another model type, are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.automata import Memo, MergeTransducer
from gleaner.llm.frames import cols, fresh

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the file format
BPE = 2


class Pieces:
    """A compiled model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a merge model with the identity normaliser is needed")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.ids, scores, self.bytes_of, self.surface = {}, {}, {}, []
        self.unknown = model.trainer_spec.unk_id
        for i, p in enumerate(model.pieces):
            if p.type in (USER, UNUSED):
                raise ValueError("user-defined and unused pieces are not handled")
            if p.type == NORMAL:
                self.ids[p.piece], scores[p.piece] = i, p.score
            if p.type == BYTE:
                self.bytes_of[int(p.piece[3:5], 16)] = i
            raw = {NORMAL: p.piece.replace(BLANK, " ").encode(), CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
            self.surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else raw[p.type])

        self.costs = {p: -score for p, score in scores.items()}
        self._cuts()
        self.memo = Memo(self._encode_word, 240_000)

    @cached_property
    def machine(self) -> MergeTransducer:
        """The piece transducer, made when the first word is encoded."""
        costs = self.costs
        return MergeTransducer(self.ids, lambda pair: costs.get(pair[0] + pair[1]), 200_000, 240_000)

    def _cuts(self) -> None:
        """Where words end: a cut is safe where no piece holds the characters on both sides of it.

        ``words`` finds them in any text. Texts in which single blanks, line ends and signs
        after letters make all the cuts are cut by replacing instead, which is faster.
        """
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        self.signs = "".join(c for c in ",.;:!?" if not any(b == c and a.isalpha() for a, b in inside))
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        plain = f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" + (f"|{alone}" if alone else "")
        before = f"{BLANK}*[^\\W\\d_]+(?=[{self.signs}])|" if self.signs else ""
        whole = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.words = re.compile("(?s).+" if whole else before + plain)
        self.plain = alone and self.signs and not whole
        self.unusual = re.compile(rf"[{self.signs}](?<![^\W\d_][{self.signs}])" if self.signs else "(?!)")  # the sign first: found faster

    def marked(self, text: str) -> str | None:
        """The words with \\x1f between them, some empty; None of an unusual text."""
        if not self.plain or text.startswith(" ") or "  " in text or BLANK in text or "\x1f" in text or self.unusual.search(text):
            return None
        text = text.replace(" ", "\x1f" + BLANK).replace("\n", "\x1f\n\x1f")
        for c in self.signs:
            text = text.replace(c, "\x1f" + c)
        return self.prefix + text

    def _words(self, text: str) -> list[str]:
        if (marked := self.marked(text)) is not None:
            return marked.split("\x1f")
        return self.words.findall((self.prefix + text).replace(" ", BLANK))

    def _encode_word(self, word: str) -> bytes:
        """The ids of a word, four bytes each."""
        out = []
        for token in self.machine.path(word):
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in token.encode()]
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        if not text:
            return b""
        self.memo.trim()
        return b"".join(map(self.memo.__getitem__, self._words(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out

    def encode_column(self, texts: pa.Array) -> pa.Array:
        made = [self.packed(t) for t in texts.to_pylist()]
        ends = np.append(0, np.cumsum([len(m) // 4 for m in made])).astype(np.int32)
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(made))])
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pc.is_null(texts) if texts.null_count else None)

    def decode_column(self, lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        made = [self.decode(flat[i:j]) for i, j in zip((ends - sizes).tolist(), ends.tolist())]
        out = pa.array(made, pa.string())
        return pc.if_else(pc.is_valid(lists), out, pa.scalar(None, pa.string())) if lists.null_count else out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One compiled model per worker and file."""
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapped(df: DataFrame, source: str, out: str, kind: T.DataType, make: str, path: str | None) -> DataFrame:
    """``df`` and a column ``out`` made from ``source`` by the named method, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    place = df.columns.index(source)
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = getattr(pieces(path or default_path()), make)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns, work(b.column(place))], names)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", ids: str = "pieces", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs``, the ids of each whole text and the text that these ids give back, in one worker stage."""
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())])
    place, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path or default_path())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                lists = model.encode_column(b.column(place))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, model.decode_column(lists)], names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", out: str = "pieces", path: str | None = None) -> DataFrame:
    """``docs`` and the ids of each whole text. Narrow work; ``path`` must be there on every worker."""
    return _mapped(docs, text, out, T.ArrayType(T.IntegerType()), "encode_column", path)


def decode(rows: DataFrame, ids: str = "pieces", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` and the text of each array of ids."""
    return _mapped(rows, ids, out, T.StringType(), "decode_column", path)


def encoded_documents(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` and (under free names) ``pieces`` and ``n_pieces``."""
    ids, n = fresh(docs, "pieces", "n_pieces")
    rows = encode(docs, text, ids, path)
    return rows.select(*cols(docs), F.col(ids), F.coalesce(F.size(ids), F.lit(0)).cast("long").alias(n))

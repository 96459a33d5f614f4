"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is two transducers. The first cuts text into words: eight
states over nine character classes, where the classes hold what the pattern looks
ahead for. A batch of texts is cut into chunks of equal length; each chunk's map from
entry state to exit state is computed for all chunks at once, the maps are composed
by a parallel prefix scan, and a second pass with known entry states marks the cuts.
The second transducer (``automata``) reads the bytes of a word and adds up the token
counts on its transitions. Words met before are looked up.

Defined cases: null and empty texts have no tokens; the special strings of the file
count one token each, wherever they stand; rows that repeat are counted each. Very
long texts are scanned in blocks that end where the first transducer forgets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.automata import Memo, MergeTransducer

# Classes of the first transducer
LETTER, DIGIT, OTHER, LAST_SPACE, LAST_BLANK, BLANK, SHORT, LONG, END = range(9)
# States: fresh, in a run of letters, digits, others or blanks, after a space that the
# next run takes, and with one or two letters of a contraction to come
FRESH, LETTERS, DIGITS, OTHERS, BLANKS, SPACE, ONE_MORE, TWO_MORE = range(8)
N_STATES, N_CLASSES = 8, 9
# White space of the pattern, and its contractions
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
CHUNK, BLOCK = 256, 1 << 20
FORGETS = re.compile(r"[\t\n\r](?=[^\s\x1c-\x1f\x85])")


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next states (as offsets) and cuts (1: a word begins here) by state * N_CLASSES + class."""
    go = np.zeros((N_STATES, N_CLASSES), np.uint8)
    cut = np.ones((N_STATES, N_CLASSES), np.uint8)
    runs = {LETTER: LETTERS, DIGIT: DIGITS, OTHER: OTHERS, BLANK: BLANKS}
    for c, run in runs.items():
        go[:, c] = run
        cut[run, c] = 0
    for c in (LETTER, DIGIT, OTHER):
        cut[SPACE, c] = 0
    go[:, LAST_SPACE], go[:, LAST_BLANK], go[:, END] = SPACE, FRESH, FRESH
    for c, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        go[:, c] = state
        for s in (OTHERS, SPACE):  # inside other signs an apostrophe is one of them
            go[s, c], cut[s, c] = OTHERS, 0
    go[ONE_MORE, LETTER], cut[ONE_MORE, LETTER] = FRESH, 0
    go[TWO_MORE, LETTER], cut[TWO_MORE, LETTER] = ONE_MORE, 0
    return go.ravel().astype(np.intp) * N_CLASSES, cut.ravel()


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = DIGIT
    kinds[list(WHITE)] = BLANK
    return kinds, *_compile()


def scan(classes: np.ndarray, go: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Marks of the places where a word begins, found chunk by chunk in parallel.

    States are kept as offsets into the tables, state * N_CLASSES.
    """
    n = len(classes)
    rows = -(-n // CHUNK)
    table = np.full(rows * CHUNK, END, np.intp)
    table[:n] = classes
    table = np.ascontiguousarray(table.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.intp)[:, None] * N_CLASSES, rows, 1)
    for c in table:
        maps += c
        maps = go[maps]
    maps = np.ascontiguousarray(maps.T)
    shift = 1
    while shift < rows:  # maps[i] becomes the map of chunks 0 to i
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift] // N_CLASSES, 1)
        shift *= 2
    state = np.append(0, maps[:-1, FRESH])
    marks = np.empty((CHUNK, rows), np.uint8)
    for k, c in enumerate(table):
        at = state + c
        marks[k], state = cut[at], go[at]
    return np.ascontiguousarray(marks.T).ravel()[:n]


def word_places(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, each with a mark behind it; its code points; begin and end of every word there; and
    the index of each text's first word (one entry more than texts)."""
    kinds, go, cut = _tables()
    joined = "\0".join(texts) + "\0"
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = kinds[points]
    classes[ends] = END
    blank = classes == BLANK
    after = np.append(classes[1:], np.uint8(END))
    last = blank & (after != BLANK) & (after != END)
    classes[last] = LAST_BLANK
    classes[last & (points == 0x20)] = LAST_SPACE
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
        for tail in CONTRACTIONS:
            hit = one == ord(tail[0])
            if len(tail) == 2:
                hit &= two == ord(tail[1])
            classes[quotes[hit]] = SHORT if len(tail) == 1 else LONG
    starts = np.flatnonzero(scan(classes, go, cut))
    stops = np.append(starts[1:], len(points))
    real = classes[starts] != END
    starts, stops = starts[real], stops[real]
    return joined, points, starts, stops, np.append(0, np.searchsorted(starts, ends))


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts in order, and the index of each text's first word (one entry more than texts)."""
    joined, _, starts, stops, first = word_places(texts)
    return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())], first


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    spare = iter(range(0x100, 0x200))
    return {b: table.get(b) or chr(next(spare)) for b in range(256)}


class Tokenizer:
    """A byte-level BPE file compiled for counting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE file without normaliser is needed")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks = {p: i for i, p in enumerate(pairs)}
        raw = {s: chr(b) for b, s in byte_symbols().items()}
        plain = str.maketrans(raw)  # vocabulary symbols as the characters of equal byte value
        ranks = {(a.translate(plain), b.translate(plain)): i for (a, b), i in ranks.items()}
        self.machine = MergeTransducer((t.translate(plain) for t in model["vocab"]), ranks.get)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.memo = Memo(self._count)

    def _count(self, word: str) -> int:
        return self.machine.count(word if word.isascii() else word.encode().decode("latin-1"))

    def _parts(self, text: str) -> tuple[list[str], int]:
        """Pieces to scan, and how many special strings stood between them."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            begin = 0
            while len(part) - begin > BLOCK:
                m = FORGETS.search(part, begin + BLOCK)
                if m is None:
                    break
                out.append(part[begin : m.end()])
                begin = m.end()
            out.append(part[begin:])
        return out, len(parts) - 1

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        pieces, owners, size = [], [], 0
        for i, text in enumerate([*texts, None]):
            if text is None or size > BLOCK:
                self._add(pieces, owners, total)
                pieces, owners, size = [], [], 0
            if text:
                parts, n = self._parts(text)
                total[i] += n
                pieces += parts
                owners += [i] * len(parts)
                size += len(text)
        return total

    def _add(self, pieces: list[str], owners: list[int], total: np.ndarray) -> None:
        begin = 0
        while begin < len(pieces):
            end, size = begin, 0
            while end < len(pieces) and (size == 0 or size + len(pieces[end]) <= 2 * BLOCK):
                size += len(pieces[end])
                end += 1
            words, at = words_of(pieces[begin:end])
            sums = np.append(0, np.cumsum(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))))
            np.add.at(total, owners[begin:end], np.diff(sums[at]))
            self.memo.trim()
            begin = end


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One compiled tokenizer per worker and file."""
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. ``path`` must name the tokenizer file on every worker.

    Narrow work: no shuffle, and memory for one block of text and bounded tables.
    """
    path = path or default_path()
    slim = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(f"`{text}`").alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = tokenizer(path)
        for b in batches:
            n = machine.counts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema)

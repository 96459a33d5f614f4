"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter run binds the vectors
of its letters, each permuted (rotated) by its place, into one vector by
multiplication; a text is the sum (bundle) of its runs, a language prototype the sum
over the texts that carry its label, and a text gets the language of the largest
cosine. Bundling is linear, so tasks add up their own part and only one vector per
task and language is shuffled.

Defined cases: letters are Unicode letters, lower-cased; everything else is one gap.
A null text and one without letters is ``und`` with score 0, and so is every text if
nothing was learned. Rows without label or text teach nothing. Equal cosines go to
the label that sorts first. The model is one vector per label value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.frames import text_of
from gleaner.llm.wordhash import mix

DIMENSIONS, SEED, GAP = 1024, 20_240_607, 0
UNKNOWN = "und"


def letter_vectors(points: np.ndarray, d: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Rows of +1 and -1 by code point, from a counter hash: alike on every worker."""
    words = np.arange(d // 64, dtype=np.uint64)
    h = mix(mix(points.astype(np.uint64)[:, None] + np.uint64(seed)) + words[None, :] * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(h.view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def bound(a: np.ndarray, b: np.ndarray, c: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors of three-letter runs, given rows of ``vectors``."""
    return np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[c]


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per three-letter run: text number and dense run number; then the runs' code points by run number."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(low).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(low)), np.array([len(t) + 1 for t in low]))[: len(points)]
    points = np.where(_letters()[points], points, GAP)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != GAP) | (points[:-1] != GAP) | (owner[1:] != owner[:-1])
    points, owner = np.append(GAP, points[keep]), np.append(0, owner[keep])
    points, owner = np.append(points, GAP), np.append(owner, len(low) - 1)
    known, dense = _dense(points)
    n = len(known)
    a, b, c = dense[:-2], dense[1:-1], dense[2:]
    use = points[1:-1] != GAP
    kinds, number = _dense((a[use] * n + b[use]) * n + c[use])
    return owner[1:-1][use], number, known[np.stack([kinds // (n * n), kinds // n % n, kinds % n], 1)]


def _dense(codes: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the place of each code among them; by counting where the range is small."""
    if len(codes) and codes.max() >= most:
        return np.unique(codes, return_inverse=True)
    seen = np.bincount(codes) > 0
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]


def bundles(texts: list[str], groups: np.ndarray | None = None, n_groups: int = 0, block: int = 16384) -> np.ndarray:
    """Sum of run vectors by text, or by group of texts; at most ``block`` run vectors are held at once."""
    owner, number, kinds = runs_of(texts)
    if groups is not None:
        owner = groups[owner]
    n = n_groups if groups is not None else len(texts)
    out = np.zeros((n, DIMENSIONS), np.float32 if groups is None else np.float64)
    points, place = _dense(kinds.ravel())
    vectors, place = letter_vectors(points), place.reshape(-1, 3)
    for at in range(0, len(kinds), block):
        mine = slice(None) if len(kinds) <= block else (number >= at) & (number < at + block)
        p, rows, runs = place[at : at + block], owner[mine], number[mine] - at
        v = bound(p[:, 0], p[:, 1], p[:, 2], vectors).astype(out.dtype)
        step = max(1, (1 << 22) // len(p))
        for i in range(0, n, step):
            k = min(step, n - i)
            some = slice(None) if step >= n else (rows >= i) & (rows < i + k)
            counts = np.bincount((rows[some] - i) * len(p) + runs[some], minlength=k * len(p))
            out[i : i + k] += counts.reshape(k, len(p)).astype(out.dtype) @ v
    return out


def _parts(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` characters, 512 texts at most."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and end - begin < 512 and (size == 0 or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield begin, end
        begin = end


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype vector per label. What reaches the driver is one vector per label value."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _parts(texts):
                names = sorted(set(langs[i:j]))
                group = np.array([names.index(x) for x in langs[i:j]])
                for name, v in zip(names, bundles(texts[i:j], group, len(names))):
                    sums[name] = sums[name] + v if name in sums else v
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v.astype(np.int64))],
                ["lang", "d", "v"])

    found = rows.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in found:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = float(r["v"])
    return {k: v for k, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is looked at."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), text_of(text).alias("text"))
    schema = T.StructType([
        slim.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = list(model)
    axes = np.array([model[k] / np.linalg.norm(model[k]) for k in names], np.float32).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            best, score = [], []
            for i, j in _parts(texts):
                v = bundles(texts[i:j])
                size = np.linalg.norm(v, axis=1)
                if not names:
                    best += [UNKNOWN] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                cos = (v @ axes.T) / np.maximum(size, 1e-30)[:, None]
                top = cos.argmax(1)
                best += [names[t] if s > 0 else UNKNOWN for t, s in zip(top, size)]
                score += [float(min(max(cos[k, t], 0.0), 1.0)) if size[k] > 0 else 0.0 for k, t in enumerate(top)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                             ["id", "lang_pred", "score"])

    return slim.mapInArrow(run, schema)

"""HyperMinHash near-duplicates against all pairs of full sets, and its sketches against known similarities."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from gleaner.llm import hyperminhash as H  # noqa: E402
from gleaner.llm.queries import QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, h string, id string, n string"


def _sentence(rng, n):
    return " ".join(f"{rng.choice('alpha beta gamma delta epsilon'.split())}{rng.randint(0, 40)}" for _ in range(n))


def _pair(rng, n, shared):
    """Two sets of n hashes each that have ``shared`` in common."""
    v = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64) * np.uint64(2)
    return np.concatenate([v[:n], v[n - shared :]]), np.array([n, n])


def test_registers_hold_zeros_and_mantissa():
    x = np.array([1 << 63, (1 << 63) + (1 << 62), 1 << 62, (1 << 61) + (1 << 60), 1, 0], np.uint64)
    assert H.compressed(x).tolist() == [0, 512, 1 << 10, (2 << 10) + 512, 62 << 10, 62 << 10]


def test_estimate_and_bands():
    rng = np.random.default_rng(5)
    for n, shared in ((400, 380), (400, 200), (60, 57), (60, 0)):
        truth, got, met = shared / (2 * n - shared), [], 0
        for _ in range(60):
            s = H.registers(*_pair(rng, n, shared))
            alike, full = H.estimate(s[:1], s[1:], np.array([n]), np.array([n]))
            got.append(alike[0])
            owner, key = H.bands(s)
            met += bool(set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()))
            assert 0 < full[0] <= H.REGISTERS
        assert abs(np.mean(got) - truth) < 0.03
        assert met == 60 if truth > 0.8 else True
        if shared == 0:
            assert met == 0


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_on_odd_rows(spark, words, percent):
    rng = random.Random(5)
    base = _sentence(rng, 150).split()
    texts = [" ".join(base), " ".join(base).upper(), None, "", " \n\t", "one", "ONE", "one two", "a " * 50, "日本 語 テキスト " * 9, "w " * 20_000]
    for k in range(60):  # near copies on both sides of the threshold
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"new{k}x{rng.randint(0, 5)}"
        texts.append(" ".join(w))
    for n in (4, 5, 7, 9, 12):
        short = _sentence(rng, n)
        texts += [short, short + " more", "less " + short]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], SCHEMA).repartition(4)
    got = {r.id: (r.n_shingles, r.component) for r in H.near_duplicates(df, words, percent).collect()}
    assert got == brute.components(rows, words, percent)
    extra = df.unionByName(df.limit(3)).unionByName(spark.createDataFrame([(None, texts[0], None, None, None), (None, None, None, None, None)], SCHEMA))
    out = H.near_duplicates(extra, words, percent)
    assert out.count() == extra.count() and out.where("id IS NULL AND component IS NULL").count() == 1
    assert H.near_duplicates(df.limit(0), words, percent).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_hyperminhash"](spark, folder).collect()}
    assert got == brute.components(rows, 3, 85)

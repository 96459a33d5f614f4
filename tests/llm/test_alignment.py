"""Tokenizer alignment against whole encodings and all pairs of tokens."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from gleaner.llm import alignment, pieces, tokencount  # noqa: E402
from gleaner.llm.queries import QUERIES  # noqa: E402

NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"]


def _want(rows):
    return sorted(map(str, brute.alignment(rows, tokencount.default_path(), pieces.default_path())))


def _got(df, names=NAMES):
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def _odd():
    rng = random.Random(2)
    texts = [None, "", " ", "a", "It's  two\n\n words ", "héllo 日本語 😀😀 ñ", "▁ blank sign", "a ▁q", "<|endoftext|> <s></s><0x41>", "\0 nul \x1f",
             "tab\tand\r\nline", "x" * 3000, "word " * 4000, "the the the"]
    signs = " '\n\tabsdtmrevl12.!é日😀　\xa0\x1cRE,;"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return list(enumerate(texts)) + [(None, "no id"), (4, "It's  two\n\n words "), (4, "It's  two\n\n words ")]


@pytest.mark.parametrize("step,block", [(1 << 20, 1 << 23), (200, 500)])
def test_odd_texts(spark, monkeypatch, step, block):
    monkeypatch.setattr(alignment, "STEP", step)
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "BLOCKS_PER_CALL", 4)
    rows = _odd()
    df = spark.createDataFrame([(i, t, "x", 5, None) for i, t in rows], "doc_id long, text string, id string, block long, part string").repartition(3)
    assert _got(alignment.align(df)) == _want(rows)


def test_no_rows_and_no_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert _got(alignment.align(df)) == _want([(1, None), (2, "")])
    assert alignment.align(df.limit(0)).count() == 0


def test_spans_are_refined_by_decoded_bytes():
    import numpy as np

    for starts, ends, sizes, want in (([0, 1, 1], [1, 4, 4], [1, 2, 1], [1, 3, 4]), ([0, 0, 0], [0, 0, 3], [1, 1, 1], [1, 2, 3])):
        assert alignment.refined(np.array(starts), np.array(ends), np.array(sizes)).tolist() == want


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    names = ["doc_id", *NAMES[1:-1], "groups_sha256"]
    assert _got(QUERIES["op13_tokenizer_alignment"](spark, folder), names) == _want(rows)


def test_words_and_links_are_read_without_a_look_at_each():
    """Words lie in one buffer, as the library's own words cut from each text; links of many texts are sorted as one number."""
    import numpy as np

    both = alignment.Aligner(tokencount.default_path(), pieces.default_path())
    texts = [t for _, t in _odd() if t]
    for some in (texts, [t for t in texts if "\x1f" not in t], [t for t in texts if both.cutter.marked(t) is not None], ["plain, words.\nof two lines"]):
        words, first = both._words_a([" " + t for t in some])
        want, at = tokencount.words_of([" " + t for t in some])
        assert words.to_pylist() == want and first.tolist() == at.tolist()
        words, first = both._words_b(some)
        got = words.to_pylist()
        assert [list(filter(None, got[i:j])) for i, j in zip(first, first[1:])] == [list(filter(None, both.cutter._words(t))) for t in some]
        _, _, text, key, n = both.align(some)
        assert (np.diff((text << 32) | key) > 0).all() and (n > 0).all()

"""The conversation trie against sequences held whole, and its parentheses against plain search."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from gleaner.llm import trie  # noqa: E402
from gleaner.llm.queries import QUERIES  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, c string, len string, depth string"


def _made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA).repartition(3)


def _nodes(df, **kw):
    turns, convs = trie.rebuilt(trie.ordered_turns(df))
    rows = trie.prefix_trie(turns, convs, **kw).collect()
    out = {(r.conv, r.depth): (r.parent_conv, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends) for r in rows}
    assert len(out) == len(rows)
    return out


def test_findclose_and_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 300, 3000):
        for deep in (True, False):
            depth = np.zeros(n, np.int64)
            for i in range(1, n):
                depth[i] = depth[i - 1] + 1 if deep and rng.random() < 0.9 else rng.integers(1, depth[i - 1] + 2)
            tree = trie.Parentheses(depth)
            closes = tree.findclose(tree.opens)
            for i in range(0, n, max(1, n // 200)):
                j = next((k for k in range(i + 1, n) if depth[k] <= depth[i]), n)
                below = depth[i:j]
                assert (closes[i] - tree.opens[i] + 1) // 2 == j - i
                n_leaves = sum(k + 1 == len(below) or below[k + 1] <= below[k] for k in range(len(below)))
                assert tree.leaves(tree.opens[i : i + 1], closes[i : i + 1])[0] == n_leaves


@pytest.mark.parametrize("shard_rows", [1 << 19, 5])
def test_trie_against_whole_sequences(spark, shard_rows):
    rng = random.Random(3)
    rows = []
    for c in range(90):
        n = rng.choice([0, 1, 2, 3, 6, 14])
        rows += [(c, t if t else None, rng.choice(["user", None]), rng.choice(["", "a b", "c", None, "long " * 400]) if t > 2 else f"start {c % 3}")
                 for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(5)]  # one conversation, many times
    rows += [(1000 + c, t, "user", f"deep {t}" if t < 60 else f"end {c}") for c in range(2) for t in range(61 + c)]
    rows += [rows[0], rows[0], (None, 1, "user", "no id"), (40_000, 5, "user", "alone"), (21, None, None, None)]
    assert _nodes(_made(spark, rows), shard_rows=shard_rows) == brute.prefix_trie(rows)


def test_empty_tables_and_one_conversation(spark):
    assert _nodes(_made(spark, []).where("conv_id > 0")) == {}
    for rows in ([(5, None, None, None)], [(20, 1, "a", "b c")], [(7, 1, "a", "b"), (7, 1, "a", "b"), (7, 2, "a", "")]):
        assert _nodes(_made(spark, rows)) == brute.prefix_trie(rows)


def test_a_conversation_with_a_third_of_all_rows_is_cut(spark, monkeypatch):
    from gleaner.plans import scale

    monkeypatch.setattr(scale, "CHUNK_ROWS", 50)
    rows = [(c, t, "user", f"{t}") for c in (40, 41) for t in range(150)] + [(c, 0, "user", "0") for c in range(42, 90)]
    assert _nodes(_made(spark, rows)) == brute.prefix_trie(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in QUERIES["op12_prefix_trie"](spark, folder).collect()}
    assert got == brute.prefix_trie(rows)

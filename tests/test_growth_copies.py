"""Near copies: what lies on disk and moves at one time."""

import random

import numpy as np
import pandas as pd

from gleaner.operators import text, vectors
from gleaner.plans import leaders, scale


def _rows_kept(monkeypatch, *modules):
    """Rows of every checkpoint the modules make from here on."""
    kept = []
    for module in modules:
        def keep(df, real=module.cut_lineage):
            made = real(df)
            kept.append((made.columns, made.count()))
            return made

        monkeypatch.setattr(module, "cut_lineage", keep)
    return kept


def test_a_few_bands_of_vectors_meet_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v + rng.standard_normal(16) * 0.05).tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, base[0].tolist()) for i in range(9)] + [(300, [0.0] * 16), (301, [-0.0] + [0.0] * 15), (302, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<float>")

    def run():
        return sorted((r.id, r.leader, round(r.cosine, 9)) for r in vectors.near_duplicate_vectors(df, "id", "v", 16, 0.95).collect())

    whole = run()
    monkeypatch.setattr(vectors, "BAND_ROWS", 0, raising=False)
    kept = _rows_kept(monkeypatch, leaders)
    assert run() == whole
    assert {i: leader for i, leader, _ in whole} == {
        **{100 + i: i for i in range(40)}, **{200 + i: 0 for i in range(9)}, 301: 300, 302: 300}
    most = max(n for _, n in kept)
    assert most <= 6 * 81


def test_sketches_never_rule_out_a_close_pair():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 12)) * 10.0 ** rng.integers(-6, 6, (400, 1))
    y = x * rng.uniform(0.1, 9, (400, 1)) + rng.standard_normal((400, 12)) * np.abs(x).max(1, keepdims=True) * rng.uniform(0, 2, (400, 1))
    x[0], x[1], x[2], x[3], x[4] = 0, np.nan, np.inf, 1e200, 1e-160
    sketch = vectors.sketch_of(12).func
    a, b = (sketch(pd.Series(list(v))) for v in (x, y))
    with np.errstate(all="ignore"):
        exact = (x * y).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((y * y).sum(1))
    for threshold in (-0.5, 0.3, 0.9, 0.999):
        close = vectors.may_be_close(threshold).func(a, b).to_numpy()
        assert close[1:5].all() and close[(exact >= threshold)].all()
        assert not close[5:][exact[5:] < threshold - 0.1].any()


def test_vectors_with_gaps_are_equal_only_gap_by_gap(spark):
    rows = [(1, [None, 1.0, 2.0]), (2, [1.0, None, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [None, 1.0, 2.0]), (4, [None, 1.0, 2.0])]
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 3, 0.99)
    assert sorted(map(tuple, got.collect())) == [(4, 1, 1.0), (4, 1, 1.0)]


def test_sets_of_texts_are_stored_once_and_counted_in_parts(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(400)}"
    rows, common = [], [word() for _ in range(30)]
    for i in range(40):
        body = [word() for _ in range(60)]
        rows.append((4 * i, " ".join(common + body)))
        rows.append((4 * i + 1, " ".join(common + body[:55] + [word() for _ in range(5)])))
        rows.append((4 * i + 2, " ".join([word() for _ in range(90)])))
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "id long, t string")

    def run():
        return sorted((r.id, r.leader, round(r.jaccard, 9)) for r in text.near_duplicates(df, "id", "t", 0.7).collect())

    whole = run()
    assert {(4 * i + 1, 4 * i) for i in range(40)} | {(1000, 0)} == {x[:2] for x in whole}
    assert len(whole) == 42
    monkeypatch.setattr(text, "ENTRY_ROWS", 1000, raising=False)
    kept = _rows_kept(monkeypatch, text, scale)
    assert run() == whole
    assert sum("s" in columns for columns, _ in kept) == 1
    parts = [n for columns, n in kept if columns == ["h", "df"]]
    entries = [n for columns, n in kept if columns == ["id", "n", "df", "h"]]
    assert len(parts) == len(entries) == 8 and max(parts) < sum(parts) / 4
    # unlike texts do not send what they share with others
    assert sum(entries) < 80 * 90

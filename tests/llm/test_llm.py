"""The training-data operators against plain versions, libraries and round trips, and on odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from compare import duck  # noqa: E402

from gleaner.llm import (  # noqa: E402
    decontam, language, lines, ngramjoin, pieces, quality, quoting, repeats, sharding, tokencount,
)
from gleaner.llm.queries import CHECKS, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# extra columns carry names that operators use inside
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, id string, _th string, kept string"


def _sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 40)) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    base = _sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    block = "\n".join(_sentence(rng, 9) for _ in range(6))
    texts = [base, base, near, "first\n" + block, block + "\nlast", "", "   \n\t ", None, "one", "ONE", "a\n" * 12,
             "ünï çødé " * 30, "x" * 400, "日本語テキスト" * 40, " ".join(words * 40), "\u0000 ▁ tail", "> quoted\nown"]
    rows = [(i, t, "en" if i % 2 else None, None, None, "h", "i", "t", "k") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base, None, None, None, None, None, None, None), (None, None, "fr", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(CHECKS))
def test_check_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = duck(FOLDER).execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_token_counts_match_the_library(spark, odd, none, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokencount.default_path())
    rng = random.Random(1)
    signs = " '\n\tabsdtmrevl12.!é日😀　\xa0\x1cRE"
    noise = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    noise += ["a<|endoftext|>b<|endoftext|>", "don''t we'll 'S 's", "\r\n\r\nx", "word " * 3000 + "\n" + "tail" * 9]
    made = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    for frame in (made, odd, docs):
        text = {(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()}
        want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in text)
        got = sorted({(str(r.id), r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(frame).collect()})
        assert got == sorted(set(want))
    assert tokencount.count_tokens(none).count() == 0


def test_long_text_in_blocks(monkeypatch):
    from tokenizers import Tokenizer

    text = "It's  a \n\n line\n of   some 12 words.\t\n" * 400
    monkeypatch.setattr(tokencount, "BLOCK", 1000)
    want = len(Tokenizer.from_file(tokencount.default_path()).encode(text, add_special_tokens=False).ids)
    assert tokencount.Tokenizer(tokencount.default_path()).counts([text, "", text]).tolist() == [want, 0, want]


def test_pieces_match_the_library_and_come_back(odd, none, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for frame in (odd, docs):
        both = pieces.round_trip(frame.select("text"))
        apart = pieces.decode(pieces.encode(frame.select("text")))
        assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
        for r in both.collect():
            if r.text is None:
                assert r.pieces is None and r.decoded is None
            else:
                assert r.pieces == lib.encode(r.text)
                assert r.decoded == r.text.replace("▁", " ")
    assert pieces.encoded_documents(none).count() == 0


def test_decontamination(spark, odd, none, docs, texts):
    items = spark.createDataFrame(
        [(1, odd_rows()[0][1]), (2, "one"), (3, None), (4, "..."), (5, "AB gamma1"), (2, "one"), (6, odd_rows()[3][1])],
        "item_id long, text string")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    for frame in (odd.where("doc_id IS NOT NULL"), docs):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        want = brute.contamination(rows, pairs)
        got = {r.id: (r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in decontam.contamination(frame, items).collect()}
        assert got == want
    assert decontam.contamination(odd, items).count() == odd.count()
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.clean_documents(odd, items).columns == odd.columns


def test_languages_are_told_apart(docs, odd, none):
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.learn(docs.where(~held))
    got = {r.id: r.lang_pred for r in language.identify(docs.where(held), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where(held).collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 0.93 * len(truth)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.id in (5, 6, 7)} == {"und"}
    assert language.learn(none) == {}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Where is it?\nI looked everywhere."),
        (1, 1, "assistant", "> Where is it?\nOn the table."),
        (1, 2, "user", ">> where  is it?\n> On the table.\nThanks"),
        (1, 3, "user", "> not said before\nHm"),
        (1, 3, "user", "> not said before\nHm"),
        (1, 4, "user", None), (2, 0, "user", ">"), (2, None, "user", "> On the table."), (None, 1, None, ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv, r.turn, r.position): r for r in quoting.link_quotes(df).collect()}
    assert len(got) == len(rows)
    first = got[(1, 1, 1)]
    assert (first.n_linked, first.reply_to, first.clean) == (1, 0, "On the table.")
    second = got[(1, 2, 2)]
    assert (second.max_level, second.n_passages, second.n_linked, second.reply_to) == (2, 2, 2, 1)
    assert [got[(1, 3, p)].reply_to for p in (3, 4)] == [2, 2]
    assert got[(2, None, 0)].reply_to is None and got[(1, 0, 0)].reply_to is None
    assert quoting.link_quotes(df.limit(0)).count() == 0


@pytest.mark.parametrize("group,bucket", [(8, 16), (1, 1)])
def test_repeats(docs, texts, odd, none, group, bucket):
    for frame in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
               for r in repeats.remove_repeats(frame, group_mb=group, bucket_mb=bucket).collect()}
        assert got == brute.repeats(rows)
    assert repeats.remove_repeats(odd).count() == odd.count()
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_in_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 500)
    rng = random.Random(2)
    a = _sentence(rng, 400)
    rows = [(1, a), (2, a[37:3000] + "!" + a[100:900]), (3, "ab" * 900), (4, "ab" * 500 + a[:49])]
    blobs = {}
    import numpy as np

    raw, at = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.cumsum([0] + [len(t) for _, t in rows])
    ids = np.array([i for i, _ in rows])
    e, _ = repeats.entries(repeats.segments(raw, at), ids, 1)
    blobs = [repeats.pack(raw, e, 0, len(e["n"]))]
    assert len(repeats.answer(blobs)) == 1
    assert int(repeats.segments(raw, at)["n"].sum()) == sum(len(t) - 49 for _, t in rows)


def test_rules_and_ablations(odd, none):
    rows = quality.ledger(odd).collect()
    assert len(rows) == odd.count()
    kept = [(r.doc_id, r.text) for r in quality.kept_documents(odd).collect()]
    want = [(r.doc_id, r.text) for r in rows if brute.kept_by_rules(r.text or "")]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    bits = quality.ledger(odd)
    table = {r.rule: r for r in quality.ablations(bits, bits["ledger.failed"], quality.POLICIES["v1"]).collect()}
    assert set(table) == {"few_words", "repeated_words", "symbols", "duplicate_lines"}
    few = sum(r.ledger.failed & 15 in (0, 1) for r in rows)
    assert table["few_words"].n_kept_without == few
    assert quality.kept_documents(none).count() == 0 and quality.kept_documents(odd).columns == odd.columns


def test_repeated_lines_are_judged_by_their_words(spark):
    rng = random.Random(9)
    opening, middle = _sentence(rng, 12), _sentence(rng, 70)
    chorus = [_sentence(rng, 15) for _ in range(6)]
    rows = [(1, f"{opening}\n{middle}\n{opening}"), (2, "\n".join([*chorus, *chorus])), (3, "\n".join([*chorus, "", chorus[0]]))]
    got = {r.doc_id: r.ledger for r in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (v.n_dup_lines, v.n_dup_words) for k, v in got.items()} == {1: (1, 12), 2: (6, 90), 3: (1, 15)}
    lines_bit = quality.BITS["duplicate_lines"]
    assert {k for k, v in got.items() if v.failed & lines_bit} == {2} and got[1].failed == 0


@pytest.mark.parametrize("sample,per_range", [(4096, 1_000_000), (64, 2)])
def test_shards(docs, odd, none, sample, per_range):
    for frame in (docs, odd):
        rows = sharding.shard_by_bytes(frame, 16, sample=sample, rows_per_range=per_range).collect()
        total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        assert len(rows) == frame.count()
        for s in range(16):
            mine = [r for r in rows if r["shard"] == s]
            assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
            assert abs(sum(r["size"] for r in mine) - total / 16) <= most + total * 0.01 / 16
    assert sharding.shard_by_bytes(none, 16).count() == 0


def test_one_text_with_a_third_of_all_rows(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id) END AS text")
    rows = sharding.shard_by_bytes(df, 16, sample=64, rows_per_range=50).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 40


def test_line_windows(docs, texts, odd, none):
    for frame in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = {r.doc_id: r.lines.kept for r in lines.dedup_lines(frame).collect()}
        assert got == brute.line_dedup(rows)
    out = lines.deduplicated(odd)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert lines.deduplicated(none).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components(docs, texts, odd, none, words, percent):
    for frame in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = {r.id: (r.n_shingles, r.component) for r in ngramjoin.components(frame, words, percent).collect()}
        assert got == brute.components(rows, words, percent)
    assert ngramjoin.components(odd, words, percent).count() == odd.count()
    assert ngramjoin.components(none, words, percent).count() == 0
    assert ngramjoin.one_of_each(odd).columns == odd.columns


def test_rows_are_judged_apart_from_their_ids(spark):
    rng = random.Random(7)
    one, two, three, four = (_sentence(rng, 80) for _ in range(4))
    rows = [(None, one), (None, one), (None, two), (1, two), (2, three), (2, three), (2, four), (3, four), (4, ""), (4, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngramjoin.one_of_each(df).collect()), key=str)
    assert got == sorted([(None, one), (1, two), (2, three), (2, four), (4, ""), (4, ""), (None, None)], key=str)
    items = spark.createDataFrame([(1, one), (2, three)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontam.clean_documents(df, items).collect()), key=str)
    assert got == sorted([r for r in rows if r[1] not in (one, three)], key=str)


def test_every_close_pair_shares_a_prefix_column_and_overlaps_add_up():
    import numpy as np

    from gleaner.llm import setpairs

    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            cut = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, cut + 2))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            total = len(a) + len(b) - common
            values = np.concatenate([a, b])
            names, at, seen = np.unique(values, return_inverse=True, return_counts=True)
            rare = ngramjoin.rarity_class(seen + (names % np.uint64(7)).astype(np.int64) * (seen > 1))[at]  # others have some too
            text, column, own = ngramjoin.prefixes(values, np.array([len(a), len(b)]), rare, percent)
            assert own.tolist() == [len(a) - common, len(b) - common]
            if 100 * common >= percent * total:
                assert set(column[text == 0].tolist()) & set(column[text == 1].tolist())
            need = np.array([0, common, common + 1])
            sides = [(np.repeat(np.arange(3), len(x)), np.tile(x, 3)) for x in (a, b)]
            assert setpairs.overlaps(*sides[0], *sides[1], need).tolist() == [common, common, -1]


def test_copies_of_one_text_that_are_not_alike_form_few_products(spark, monkeypatch):
    from gleaner.llm import setpairs

    rng, formed, products = random.Random(11), [], setpairs.products

    def counted(pairs, *args):
        formed.append(pairs.count())
        return products(pairs, *args)

    monkeypatch.setattr(setpairs, "products", counted)
    base = _sentence(rng, 150).split()
    rows = []
    for k in range(240):  # words that some copies have in common stand at the same places
        w = list(base)
        for at in rng.sample(range(0, 150, 6), 5):
            w[at] = f"other{at}x{rng.randint(0, 11)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: (r.n_shingles, r.component) for r in ngramjoin.components(df, 5, 80).collect()}
    assert got == brute.components(rows, 5, 80)
    assert len(formed) == 2 and formed[1] < 8 * len(rows)  # of 28,680 pairs


def test_pipeline_against_a_plain_version(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet").collect()
    rows = [(r.doc_id, r.text) for r in read("documents") if brute.kept_by_rules(r.text or "")]
    cut = brute.line_dedup(rows)
    rows = [(i, cut[i]) for i, t in rows if cut[i] == t or cut[i] != ""]
    top = brute.components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if top[i][1] == i]
    bad = brute.contamination(rows, [(r.item_id, r.text) for r in read("benchmark")])
    want = {i: t for i, t in rows if not bad[i][1]}
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None

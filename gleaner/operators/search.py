"""Predicates, search and ranking over own tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rows import each, each_at, pin
from gleaner.functions.textcols import tokens
from gleaner.plans.scale import top_k_per_group, value_ranks


def boolean_search(
    df: DataFrame,
    text: str,
    must: list[str] = [],
    any_of: list[str] = [],
    must_not: list[str] = [],
    fields: list[Column] = [],
) -> DataFrame:
    """Rows holding all of ``must``, one of ``any_of``, none of ``must_not``.

    ``fields`` are plain column tests; they come first so that they reach the scan.
    """
    for test in fields:
        df = df.where(test)
    rows = pin(df, df.columns, _w=tokens(F.col(text)))
    for term in must:
        rows = rows.where(_holds(term))
    if any_of:
        rows = rows.where(reduce(lambda x, y: x | y, [_holds(x) for x in any_of]))
    for term in must_not:
        rows = rows.where(~_holds(term))
    return rows.drop("_w")


def asked(term: str) -> list[str]:
    """The words of an asked term, folded and cut as ``tokens`` does with texts."""
    return re.findall(r"[^\W_]+", term.lower())


def _holds(term: str) -> Column:
    """Whether the words in ``_w`` hold those of ``term`` in a row; a term without words is held by none."""
    words = asked(term)
    if len(words) < 2:
        return F.array_contains("_w", words[0] if words else "")
    return F.contains(F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))


def _is(term: str):
    return lambda w: w == term


def ranked_search(
    df: DataFrame, key: str, text: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """BM25 top ``k`` by the words of ``terms``. They are counted within each row, so no token leaves its row."""
    terms = [w for term in terms for w in asked(term)]
    tf ={f"tf{i}": F.size(F.filter("_w", _is(q))) for i, q in enumerate(terms)}
    counted = pin(pin(df, [key], _w=tokens(F.col(text))), [key], dl=F.size("_w"), **tf)
    stat = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("dl").alias("avgdl"),
            *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
        )
    ).scalar()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"tf{i}"), stat[f"df{i}"]
        idf = F.log(1 + (stat["n"] - d + 0.5) / (d + 0.5))
        norm = tf + k1 * (1 - b + b * F.col("dl") / stat["avgdl"])
        score = score + idf * tf * (k1 + 1) / norm
    hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(False))
    scored = counted.where(hit).select(key, score.alias("score"))
    return scored.orderBy(F.desc(F.round("score", 6)), F.asc(key)).limit(k)


def phrase_search(df: DataFrame, keys: list[str], text: str, phrase: str) -> DataFrame:
    """Every place (token number from 1) at which the exact phrase starts."""
    want = asked(phrase) or [""]  # a phrase without words is found nowhere
    target = F.array(*[F.lit(w) for w in want])
    found = pin(df, keys, _w=tokens(F.col(text))).where(
        F.array_contains("_w", want[0]) & (F.size("_w") >= len(want))
    )
    starts = F.filter(
        F.sequence(F.lit(1), F.size("_w") - len(want) + 1),
        lambda i: F.slice("_w", i, len(want)) == target,
    )
    return each(found, keys, starts, "at")


def regex_grep(df: DataFrame, keys: list[str], text: str, pattern: str, context: int) -> DataFrame:
    """All matches of a pattern with up to ``context`` characters between neighbours."""
    hits = pin(
        df.where(F.col(text).rlike(pattern)), keys,
        _parts=F.split(text, pattern, -1),
        _m=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
    )
    rows = each_at(hits, [*keys, "_parts"], F.col("_m"), "_i", "match")
    before = F.element_at("_parts", F.col("_i") + 1)
    after = F.element_at("_parts", F.col("_i") + 2)
    return rows.select(
        *keys,
        (F.col("_i") + 1).alias("hit_no"),
        "match",
        F.when(F.length(before) > context, F.expr(f"right(element_at(_parts, _i + 1), {context})"))
        .otherwise(before).alias("before"),
        F.substring(after, 1, context).alias("after"),
    )


def facet_filter(df: DataFrame, filters: list[Column], facets: list[str]) -> DataFrame:
    """Facet values left after all filters, with counts, in one aggregation."""
    for test in filters:
        df = df.where(test)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]
    )
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def keyword_monitor(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """Rows that mention a watched term (column ``term``), with the hit count."""
    words = each(df, [key], tokens(F.col(text)), "term")
    return words.join(terms, "term").groupBy(key, "term").agg(F.count("*").alias("hits"))


def prefix_suggest(df: DataFrame, text: str, prefix: str, k: int) -> DataFrame:
    """Most frequent words that start with ``prefix``."""
    words = F.filter(tokens(F.col(text)), lambda w: w.startswith(prefix))
    counted = each(df, [], words, "word").groupBy("word").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(k)


def rank_fusion(lists: DataFrame, source: str, item: str, score: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of scored lists, highest score first; equal scores share a rank."""
    placed = lists.withColumn("_down", -F.col(score))
    ranks = value_ranks(placed, [source], "_down").select(
        source, "_down", (F.col("before") + 1).alias("rank")
    )
    fused = placed.join(ranks, [source, "_down"]).groupBy(item).agg(
        F.sum(1 / (c + F.col("rank"))).alias("fused"), F.count("*").alias("lists")
    )
    return fused.orderBy(F.desc(F.round("fused", 6)), item).limit(k)


def result_overlap(
    lists: DataFrame, source: str, item: str, score: str, base: str, k: int
) -> DataFrame:
    """Top ``k`` of each list against the base list: overlap, Jaccard, mean rank shift."""
    top = top_k_per_group(lists, [source], [F.desc(score), F.asc(item)], k)
    ref = top.where(F.col(source) == base).select(item, F.col("position").alias("base_position"))
    size = ref.agg(F.count("*")).scalar()
    joined = top.where(F.col(source) != base).join(ref, item, "left")
    both = F.count("base_position")
    return joined.groupBy(source).agg(
        both.alias("overlap"),
        (both / (F.count("*") + size - both)).alias("jaccard"),
        F.coalesce(F.avg(F.abs(F.col("position") - F.col("base_position"))), F.lit(-1.0)).alias("shift"),
    )


def enrich_lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Add the columns of a dimension by key; rows without a match are kept."""
    return df.join(dim, key, "left")

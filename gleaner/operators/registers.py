"""Registries, name matching and catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rows import each
from gleaner.functions.textcols import tokens
from gleaner.functions.webcols import probes, segments
from gleaner.plans.scale import top_k_per_group

# Legal forms left out of company names.
LEGAL_FORMS = r" (?:LTD|LLC|INC|PLC|GMBH|AG|SA|SARL|BV|OOO|CORP|CO)\.?$"


def company_key(name: Column) -> Column:
    """Company name in upper case with single blanks and without its legal form."""
    c = F.regexp_replace(F.upper(F.trim(name)), r"[ \t]+", " ")
    return F.regexp_replace(c, LEGAL_FORMS, "")


def watchlist_screening(names: DataFrame, name: str, listed: DataFrame, entry: str,
                        edits: int, threshold: float) -> DataFrame:
    """Company names within ``edits`` changes of a listed one, with score 1 - distance / length.

    Distinct names are matched once, on a shared piece of the listed name, and joined back to their rows.
    Null names match nothing.
    """
    keys = names.select(company_key(F.col(name)).alias("_n")).distinct()
    wanted = listed.select(entry, company_key(F.col(entry)).alias("_e"))
    left = each(keys, ["_n"], probes(F.col("_n"), edits), "_k")
    right = each(wanted.select("_e").distinct(), ["_e"], segments(F.col("_e"), edits), "_k")
    near = left.join(right, "_k").select("_n", "_e", F.levenshtein("_n", "_e", edits).alias("edits")).where("edits >= 0").distinct()
    score = 1 - F.col("edits") / F.greatest(F.length("_n"), F.length("_e"), F.lit(1))
    scored = near.withColumn("score", score).where(F.col("score") >= threshold)
    hits = scored.join(wanted, "_e").drop("_e")
    return names.withColumn("_n", company_key(F.col(name))).join(hits, "_n").drop("_n")


def id_lookup(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Exact registry lookup with a found flag."""
    return df.join(registry.withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def trade_flows(lines: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame,
                part: DataFrame, nation: DataFrame) -> DataFrame:
    """Shipments and value by seller country, buyer country and product type.

    Lines meet the supplier and part tables first; what is left is added up per
    order and country before the join with orders.
    """
    seller = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("seller"))
    buyer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("buyer"))
    value = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    per_order = (
        lines.select("l_orderkey", "l_suppkey", "l_partkey", value.alias("value"))
        .join(seller, "l_suppkey")
        .join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
        .groupBy("l_orderkey", "seller", "p_type")
        .agg(F.count("*").alias("shipments"), F.sum("value").alias("value")))
    return (
        per_order.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(buyer, "o_custkey")
        .groupBy("seller", "buyer", "p_type")
        .agg(F.sum("shipments").alias("shipments"), F.sum("value").alias("value")))


def harmonise_sources(sources: dict[str, DataFrame], mapping: dict[str, dict[str, str]]) -> DataFrame:
    """Many source schemas in one, by a mapping of target column to expression, with provenance."""
    parts = [
        df.select(*[F.expr(e).alias(c) for c, e in mapping[n].items()], F.lit(n).alias("provenance"))
        for n, df in sources.items()
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def fuzzy_name_search(df: DataFrame, name: str, asked: list[str], k: int) -> DataFrame:
    """The ``k`` closest distinct names for each asked one; one pass over the names."""
    names = df.groupBy(name).agg(F.count("*").alias("rows"))
    pairs = names.withColumn("asked", F.explode(F.array(*[F.lit(q) for q in asked])))
    scored = pairs.withColumn("distance", F.levenshtein(F.lower(name), F.lower("asked")))
    return top_k_per_group(scored, ["asked"], [F.asc("distance"), F.asc(name)], k)


def longest_prefix_lookup(df: DataFrame, number: str, prefixes: DataFrame, prefix: str, owner: str) -> DataFrame:
    """Owner of the longest listed prefix of each distinct number, null for a number without one."""
    sizes = prefixes.agg(F.collect_set(F.length(prefix))).scalar()  # one entry per length in use
    asked = df.select(number).where(F.col(number).isNotNull()).distinct().select(number, F.explode_outer(sizes).alias("_n"))
    head = F.substr(F.col(number), F.lit(1), F.col("_n"))
    keyed = asked.withColumn(prefix, F.when(F.length(head) == F.col("_n"), head))
    listed = prefixes.select(prefix, owner, F.lit(True).alias("_listed"))
    return keyed.join(listed, prefix, "left").groupBy(number).agg(
        F.max(F.when(F.col("_listed"), F.struct("_n", owner))).alias("_b")).select(
        number, F.col(f"_b.{owner}").alias(owner), F.col("_b._n").alias("digits"))


def company_mentions(docs: DataFrame, text: str, groups: list[str], names: DataFrame, name: str,
                     ts: str | None = None, grain: str = "month") -> DataFrame:
    """Mentions of listed one-word names by group and, with ``ts``, by ``period`` of that grain."""
    if ts is not None:
        docs = docs.withColumn("period", F.to_date(F.date_trunc(grain, F.col(ts))))
        groups = [*groups, "period"]
    words = each(docs, groups, tokens(F.col(text)), name)
    return words.join(names.select(name).distinct(), name).groupBy(name, *groups).agg(F.count("*").alias("mentions"))


def catalogue_availability(df: DataFrame, title: Column, source: str) -> DataFrame:
    """How many sources hold each title, and the source of titles found in one only."""
    held = df.groupBy(title.alias("title")).agg(
        F.count_distinct(source).alias("sources"), F.min(source).alias("_s"), F.count("*").alias("rows"))
    return held.withColumn("only_in", F.when(F.col("sources") == 1, F.col("_s")).otherwise("")).drop("_s")


def map_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``changed``: sorted keys whose values differ between two metadata maps."""
    differ = F.map_zip_with(a, b, lambda _, x, y: ~x.eqNullSafe(y))
    return df.withColumn("changed", F.array_sort(F.map_keys(F.map_filter(differ, lambda _, v: v))))

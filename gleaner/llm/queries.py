"""Queries of this subpackage: one per operator over its whole table, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    alignment, checks, decontam, hyperminhash, language, lines, ngramjoin, pieces, quality, quoting, repeats, sharding,
    tokencount, trie,
)
from gleaner.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document for the 50k byte-level vocabulary, and whether they exceed 1024."""
    rows = tokencount.count_tokens(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and whether decoding them gives the text back (U+2581 as a blank)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.round_trip(docs)
    same = F.col("decoded").eqNullSafe(F.translate("text", pieces.BLANK, " "))
    return rows.select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), same.alias("round_trip"), "pieces")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose ten-word windows occur in each document, and the words they cover."""
    rows = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))  # noqa: E731  a null id is not held out
    model = language.learn(docs.where(~held_out("doc_id")))
    rows = language.identify(docs, model)
    own = held_out("id")
    return rows.select(F.col("id").alias("doc_id"), own.alias("held_out"), "lang_pred", "score")


@query
def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all conversations in reply order, without quotes and linked to what they quote."""
    rows = quoting.link_quotes(read_table(spark, sf_dir, "conversations"))
    return rows.withColumnsRenamed({"conv": "conv_id", "clean": "text"})


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of documents before it."""
    rows = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and verdict of every document."""
    rows = quality.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ledger.*")
    base = quality.passes(F.col("failed"), quality.POLICIES["base"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"),
        quality.passes(F.col("failed"), quality.POLICIES["v2"]).alias("kept"), F.col("failed").alias("failed_rules"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes over all documents."""
    rows = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), 16)
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that later occurrences of three-line windows cover."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lines.dedup_lines(docs).select("doc_id", "lines.*")
    return rows.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets overlap to 90 of 100 or more."""
    rows = ngramjoin.components(read_table(spark, sf_dir, "documents"), words=3, percent=90)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets overlap to 85 of 100 or more, found by sketches."""
    rows = hyperminhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)
    return rows.withColumnsRenamed({"id": "doc_id", "component": "component_id"})


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all conversations, after each has borrowed its first turns."""
    turns, convs = trie.rebuilt(trie.ordered_turns(read_table(spark, sf_dir, "conversations")))
    rows = trie.prefix_trie(turns, convs)
    return rows.withColumnsRenamed(
        {"conv": "conv_id", "parent_conv": "parent_conv_id", "saved": "saved_tokens", "ends": "ends_sha256"})


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level tokens and the pieces of every document."""
    rows = alignment.align(read_table(spark, sf_dir, "documents"))
    return rows.withColumnsRenamed({"id": "doc_id", "digest": "groups_sha256"})


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository, from documents to encoded documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


CHECKS = checks.SQL

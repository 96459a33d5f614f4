"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; policies are masks over those bits, so that a new policy
version or an ablation is a bitwise expression over the ledger and never reads a
text again.

Repeated lines are judged by the words in them (``n_dup_words``), so that a short text
whose opening line comes again at its end is not taken for boilerplate.

Defined cases: a null or empty text has no words and fails ``few_words``; rows that
repeat are measured each; columns of the input are kept as they are and new names
that clash are put into one struct whose name is free; an empty table gives an empty
ledger; a very long text is measured whole, in the memory of one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.frames import cols, fresh, once, text_of

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger; ``fails`` reads the measurements by name."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Integer arithmetic throughout, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule(2, "symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule(3, "duplicate_lines", lambda m: m("n_dup_words") * 100 > m("n_words") * 30),
    Rule(4, "word_length", lambda m: (m("word_chars") > m("n_words") * 12) | (m("word_chars") * 2 < m("n_words") * 5)),
    Rule(5, "shouting", lambda m: m("n_upper") * 100 > m("word_chars") * 40),
)
BITS = {r.name: 1 << r.bit for r in RULES}
#: Versions of the verdict; a document is kept if none of the policy's bits is set.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_words"],
    "v1": BITS["few_words"] | BITS["repeated_words"] | BITS["symbols"] | BITS["duplicate_lines"],
    "v2": sum(BITS.values()),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_dup_words",
)


def measured(docs: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """``docs`` and a struct ``out`` with the measurements of each whole text.

    Three-word windows are hashed in place, sorted and compared with their
    neighbours, so a text of n words costs n log n and no row leaves its task.
    """
    words, n, small, wins, at = fresh(docs, "_words", "_n", "_small", "_wins", "_at")
    t = text_of(text)
    spoken = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    one = once(docs, **{
        words: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        small: F.struct(
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            spoken.alias("lines"),
        ),
    })
    w = F.col(words)
    hashed = F.transform(
        w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    two = once(one.select(*cols(docs), words, small), **{
        n: F.size(w).cast("long"),
        wins: F.sort_array(F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))),
    }).select(*cols(docs), small, n, wins)
    s = F.col(wins)
    twice = F.transform(
        s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"]))
    three = once(two, **{at: F.sort_array(F.filter(twice, lambda p: p.isNotNull()))}).drop(wins)
    p = F.col(at)
    covered = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    lines = F.col(f"{small}.lines")
    unlike = F.array_distinct(lines)
    in_unlike = F.regexp_count(F.array_join(unlike, "\n"), F.lit(WORD))
    return three.select(*cols(docs), F.struct(
        F.col(n).alias("n_words"),
        F.col(f"{small}.word_chars"),
        F.col(f"{small}.n_symbols"),
        (F.size(lines) - F.size(unlike)).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.col(f"{small}.n_upper"),
        F.when(F.size(lines) == F.size(unlike), F.lit(0)).otherwise(F.col(n) - in_unlike).cast("long").alias("n_dup_words"),
    ).alias(out))


def ledger(docs: DataFrame, text: str = "text", rules: tuple = RULES, out: str = "ledger") -> DataFrame:
    """``docs`` and a struct ``out``: the measurements and ``failed``, one bit per failed rule."""
    (m,) = fresh(docs, "_m")
    rows = measured(docs, text, m)
    read = lambda name: F.col(f"{m}.{name}")
    failed = F.lit(0).cast("long")
    for r in rules:
        bit = F.when(r.fails(read), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
        failed = failed.bitwiseOR(bit)
    fields = [read(x).alias(x) for x in MEASURES]
    return once(rows, **{out: F.struct(*fields, failed.alias("failed"))}).drop(m)


def passes(failed: Column, policy: int) -> Column:
    """Whether no bit of the policy's mask is set."""
    return failed.bitwiseAND(F.lit(policy).cast("long")) == 0


def ablations(rows: DataFrame, failed: Column, policy: int, rules: tuple = RULES) -> DataFrame:
    """One row per rule of a policy, from the bits alone and in one pass.

    ``n_failed`` documents fail the rule, ``n_only`` fail no other rule of the
    policy, and ``n_kept_without`` would be kept if the policy dropped the rule.
    """
    aggs, used = [], [r for r in rules if policy & (1 << r.bit)]
    for r in used:
        own = ~passes(failed, 1 << r.bit)
        rest = passes(failed, policy & ~(1 << r.bit))
        aggs.append(F.struct(
            F.lit(r.name).alias("rule"),
            F.count_if(own).alias("n_failed"),
            F.count_if(own & rest).alias("n_only"),
            F.count_if(rest).alias("n_kept_without"),
        ))
    if not aggs:
        return rows.sparkSession.createDataFrame(
            [], "rule string, n_failed bigint, n_only bigint, n_kept_without bigint")
    return rows.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def kept_documents(docs: DataFrame, text: str = "text", policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with the columns of ``docs``."""
    (led,) = fresh(docs, "_ledger")
    rows = ledger(docs, text, out=led)
    return rows.where(passes(F.col(f"{led}.failed"), POLICIES[policy])).select(*cols(docs))

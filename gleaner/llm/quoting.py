"""Chat formatting by quotation linking (DataFrame functions only).

Lines that begin with ``>`` are quotes; the number of marks is the level. Runs of
lines of one level are passages. A passage is normalised (lower case, single blanks)
and hashed, as are the whole own text and each own line of every message of the same
conversation; equal hashes link the passage to the latest earlier message, first as
a whole and else line by line. A message replies to the author of its least nested
linked quote, without one to the message before it. Messages are numbered in reply
order, which follows the turns as replies come after what they answer, and their
texts are returned without the quotes.

Defined cases: null and empty texts have no lines of their own; a null turn comes
first and is nobody's predecessor; equal turns are ordered by role and text; repeated
rows are kept and numbered each. Own lines without any letter or digit are no origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.frames import fresh, once, text_of
from gleaner.plans.scale import carry_forward_within

MARKS = r"^(?:[ \t]*>)+"


def normalised(c: Column) -> Column:
    """Lower case with single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\x09-\x0D\x20]+", " "))


def _hash(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("second"), c).alias("h2"))


def parsed(messages: DataFrame, text: str = "text", out: str = "parsed") -> DataFrame:
    """``messages`` and a struct ``out``: ``own`` lines, ``passages`` of (level, lines), ``n_quoted`` lines."""
    ls, quotes = fresh(messages, "_ls", "_quotes")
    t = text_of(text)
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    parts = F.transform(F.split(t, "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), r"[^>]", "")).alias("level"),
        F.substr(x, F.length(marks(x)) + 1).alias("body")))
    one = once(messages, **{ls: parts})
    p = F.col(ls)
    # a passage begins where the level differs from that of the line before
    begins = F.filter(F.transform(p, lambda x, i: F.when(
        (x["level"] > 0) & F.coalesce(F.get(p, i - 1)["level"] != x["level"], F.lit(True)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(p, lambda x, i: F.when(
        (x["level"] > 0) & F.coalesce(F.get(p, i + 1)["level"] != x["level"], F.lit(True)), i)), lambda i: i.isNotNull())
    two = once(one, **{quotes: F.arrays_zip(begins.alias("b"), ends.alias("e"))})
    keep = [F.col(f"`{c}`") for c in messages.columns]
    own = F.transform(F.filter(p, lambda x: x["level"] == 0), lambda x: x["body"])
    passages = F.transform(F.col(quotes), lambda q: F.struct(
        F.get(p, q["b"])["level"].alias("level"),
        F.transform(F.slice(p, q["b"] + 1, q["e"] - q["b"] + 1), lambda x: x["body"]).alias("lines")))
    quoted = F.size(F.filter(p, lambda x: x["level"] > 0))
    return two.select(*keep, F.struct(
        own.alias("own"), passages.alias("passages"), quoted.cast("long").alias("n_quoted")).alias(out))


def _speaks(line: Column) -> Column:
    return line.rlike(r"[\p{L}\p{N}]")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row per message: ``conv``, ``turn``, ``role``, ``max_level``, ``n_quoted`` lines, ``n_passages``,
    ``n_linked`` passages, ``reply_to`` (turn), ``position`` (from 0) and ``clean`` (text without quotes)."""
    base = messages.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
        text_of(text).alias("text"))
    rows = once(parsed(base, "text", "q"), th=F.xxhash64("text")).drop("text")
    clean = F.trim(F.array_join("q.own", "\n"), F.lit("\n"))

    # what can be quoted: the whole own text and each of its lines
    whole = normalised(F.array_join("q.own", " "))
    origins = rows.where(F.col("turn").isNotNull()).select(
        "conv", "turn", F.explode(F.array_distinct(F.concat(
            F.array(whole), F.transform("q.own", normalised)))).alias("said")
    ).where(_speaks(F.col("said"))).select("conv", F.col("turn").alias("from_turn"), _hash(F.col("said")).alias("h"))

    # what is quoted: each passage as a whole (line -1) and line by line
    quoting = rows.where(F.size("q.passages") > 0).select(
        "conv", "turn", "role", "th", F.posexplode("q.passages").alias("no", "passage"))
    asked = quoting.select(
        "conv", "turn", "role", "th", "no", F.col("passage.level").alias("level"), F.posexplode(F.concat(
            F.array(normalised(F.array_join("passage.lines", " "))), F.transform("passage.lines", normalised)
        )).alias("line", "quoted")
    ).where(_speaks(F.col("quoted"))).withColumn("h", _hash(F.col("quoted"))).drop("quoted")
    met = _latest_before(asked, origins)
    me = ["conv", "turn", "role", "th"]
    by_passage = met.groupBy(*me, "no").agg(
        F.min("level").alias("level"),
        F.coalesce(F.max(F.when(F.col("line") == 0, F.col("from_turn"))), F.max("from_turn")).alias("from_turn"))
    links = by_passage.groupBy(*me).agg(
        F.count("*").alias("n_linked"), F.max_by("from_turn", F.struct(-F.col("level"), "from_turn")).alias("linked"))
    cond = None
    right = links.select(*[F.col(c).alias(f"k_{c}") for c in me], "n_linked", "linked")
    for c in me:
        term = rows[c].eqNullSafe(right[f"k_{c}"])
        cond = term if cond is None else cond & term
    joined = rows.join(right, cond, "left").select(
        "conv", "turn", "role", "th",
        F.coalesce(F.array_max(F.transform("q.passages", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.col("q.n_quoted").alias("n_quoted"), F.size("q.passages").cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "linked", clean.alias("clean"))
    return _in_order(joined)


def _latest_before(asked: DataFrame, origins: DataFrame, chunk: int = 1024) -> DataFrame:
    """``asked`` with ``from_turn``: the latest origin of the same conversation and hash in an earlier turn.

    Both sides are stacked and the origin is carried forward, so a line that is said and
    quoted many times makes no pairs.
    """
    h = [F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")]
    q = asked.where(F.col("turn").isNotNull()).select("*", *h).drop("h")
    o = origins.select("conv", *h, F.col("from_turn").alias("turn"), F.col("from_turn").alias("origin"))
    o = o.join(q.select("conv", "h1", "h2"), ["conv", "h1", "h2"], "left_semi").distinct()
    stacked = q.withColumn("side", F.lit(0)).unionByName(o.withColumn("side", F.lit(1)), allowMissingColumns=True)
    filled = carry_forward_within(
        stacked, ["conv", "h1", "h2"], ["turn", "side"], "origin", "from_turn", F.floor(F.col("turn") / chunk))
    return filled.where((F.col("side") == 0) & F.col("from_turn").isNotNull())


def _in_order(rows: DataFrame, chunk: int = 1024) -> DataFrame:
    """Adds ``position`` and the turn before; a long conversation is numbered in chunks of turns."""
    low = F.lit(-(1 << 62))  # a chunk of its own for null turns
    cut = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), low))
    sizes = cut.groupBy("conv", "chunk").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    past = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("conv").alias("k_conv"), F.col("chunk").alias("k_chunk"),
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("offset"), F.max("last").over(past).alias("before"))
    within = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "clean", "th")
    earlier = Window.partitionBy("conv", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("rn", F.row_number().over(within)).withColumn("prev", F.max("turn").over(earlier))
    out = local.join(
        offsets, local["conv"].eqNullSafe(offsets["k_conv"]) & (local["chunk"] == offsets["k_chunk"]))
    return out.select(
        "conv", "turn", "role", "max_level", "n_quoted", "n_passages", "n_linked",
        F.coalesce("linked", "prev", "before").alias("reply_to"),
        (F.col("offset") + F.col("rn") - 1).cast("long").alias("position"), "clean")

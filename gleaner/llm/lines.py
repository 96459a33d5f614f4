"""Line deduplication by overlapping three-line windows (DataFrame functions only).

Every three consecutive lines form a window. A window that occurs more than once in
the corpus keeps its first occurrence, by (id, line); the lines of all later
occurrences are removed, overlapping ones merged.

Defined cases: lines are compared as they are; a window without any word is never
counted; documents of fewer than three lines, null and empty texts have no window
and stay. Rows with one id and one text count as one document and get one result;
a null id sorts first. If all lines go, the text is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.frames import cols, fresh, once, same_key, text_of

WORD = r"[^\x20\x09-\x0D]"


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row per window: ``id``, ``th`` (text hash), ``at`` (line from 0), ``h1`` and ``h2``.

    The two 64-bit hashes stand for the window's lines.
    """
    t = text_of(text)
    rows = once(docs.select(F.col(f"`{key}`").alias("id"), t.alias("t")),
                th=F.xxhash64("t"), lines=F.split("t", "\n")).drop("t")
    ls = F.col("lines")

    def hashed(x, i):
        run = [x] + [F.get(ls, i + k) for k in range(1, size)]
        spoken = run[0].rlike(WORD)
        for r in run[1:]:
            spoken = spoken | r.rlike(WORD)
        return F.when((i + size <= F.size(ls)) & spoken, F.struct(
            i.alias("at"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit("second"), *run[::-1]).alias("h2")))

    made = F.filter(F.transform(ls, hashed), lambda w: w.isNotNull())
    return rows.select("id", "th", F.explode(made).alias("w")).select("id", "th", "w.*")


def later_windows(rows: DataFrame) -> DataFrame:
    """(id, th, at) of every window that occurred before.

    First occurrences come from a partial minimum per hash; only windows that
    repeat are joined back, and that join's hot keys can be split.
    """
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "at", "th")).alias("first"), F.count("*").alias("n"))
    repeated = first.where("n > 1").select("h1", "h2", "first")
    return rows.join(repeated, ["h1", "h2"]).where(
        ~F.struct("id", "at", "th").eqNullSafe(F.col("first"))).select("id", "th", "at")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``kept`` (the remaining text), ``n_lines``, ``n_removed`` and ``n_spans``.

    The four columns come in one struct named ``lines`` (or a longer free name).
    A text from which nothing goes is kept as it is.
    """
    later = later_windows(windows(docs, key, text, size))
    th, out, ats, sid, sth, _b, _e, _ls = fresh(docs, "_th", "lines", "_ats", "_id", "_sth", "_b", "_e", "_ls")
    spots = later.groupBy(F.col("id").alias(sid), F.col("th").alias(sth)).agg(
        F.sort_array(F.collect_set("at")).alias(ats))
    left = docs.withColumn(th, F.xxhash64(text_of(text)))
    joined = left.join(spots, same_key(left, spots, {key: sid, th: sth}), "left").select(*cols(docs), ats)
    p = F.col(ats)
    begins = F.filter(p, lambda x, i: (i == 0) | (x > F.get(p, i - 1) + size))
    ends = F.transform(
        F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + size)), lambda x: x + size)
    none = F.array().cast("array<int>")
    cut = once(joined, **{_b: F.coalesce(begins, none), _e: F.coalesce(ends, none), _ls: F.split(text_of(text), "\n")})
    b, e, ls = F.col(_b), F.col(_e), F.col(_ls)
    n = F.size(ls)
    # what stays lies between one span's end and the next span's begin
    stops = F.concat(b, F.array(n))
    pieces = F.transform(stops, lambda stop, i: F.slice(
        ls, F.coalesce(F.get(e, i - 1), F.lit(0)) + 1, stop - F.coalesce(F.get(e, i - 1), F.lit(0))))
    gone = F.aggregate(F.transform(b, lambda x, i: F.get(e, i) - x), F.lit(0), lambda a, x: a + x)
    source = F.col(f"`{text}`")
    return cut.select(*cols(docs), F.struct(
        F.when(F.size(b) > 0, F.array_join(F.flatten(pieces), "\n")).otherwise(source).alias("kept"),
        F.when(source.isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        gone.cast("long").alias("n_removed"),
        F.size(b).cast("long").alias("n_spans"),
    ).alias(out))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with shortened texts; documents that lose all their lines go.

    ``length``, if it is a column of ``docs``, is brought in line with changed texts.
    """
    rows = dedup_lines(docs, key, text)
    box = [c for c in rows.columns if c not in docs.columns][0]
    changed = F.col(f"{box}.n_removed") > 0
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col(f"{box}.kept").alias(text))
        elif c == length:
            out.append(F.when(changed, F.length(f"{box}.kept").cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    whole = changed & (F.col(f"{box}.n_removed") == F.col(f"{box}.n_lines"))
    return rows.where(~whole).select(*out)

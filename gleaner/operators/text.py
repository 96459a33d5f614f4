"""Extraction from text, scalar checks, text statistics and copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import textcols as X
from gleaner.functions.rows import each, each_at, pin
from gleaner.plans.leaders import follow_leaders
from gleaner.plans.scale import cut_lineage, discard, placed, top_k_per_group


def detect_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of personal-data patterns per row, for governance of own data."""
    counts = {f"n_{name}": F.regexp_count(text, F.lit(p)) for name, p in X.PII.items()}
    total = sum((F.col(c) for c in counts), F.lit(0))
    return pin(df, [key], **counts).where(total > 0)


def redact(text: Column) -> Column:
    """The text with every personal-data pattern replaced by its type tag."""
    for name in ("email", "phone", "ip", "card"):
        text = F.regexp_replace(text, X.PII[name], f"[{name}]")
    return text


def redact_pii(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds personal data, with the redacted text."""
    return pin(df, df.columns, redacted=redact(F.col(text))).where(F.col("redacted") != F.col(text))


def extract_dates_prices(df: DataFrame, key: str, text: str) -> DataFrame:
    """Typed dates and money amounts (thousands separated or not) with currency sign; one row per find.

    ``raw`` is the find as it stands; an amount of more than 36 digits before the point is null beside it.
    """
    dates = each(df, [key], F.regexp_extract_all(text, F.lit(X.ISO_DATE), F.lit(0)), "raw").select(key, F.lit("date").alias("kind"), F.try_to_date("raw", "yyyy-MM-dd").alias("on_date"),
             F.lit(None).cast("decimal(38,2)").alias("amount"), F.lit(None).cast("string").alias("currency"), "raw")
    money = each(df, [key], F.regexp_extract_all(text, F.lit(X.MONEY), F.lit(0)), "raw").select(key, F.lit("price").alias("kind"), F.lit(None).cast("date").alias("on_date"),
             F.replace(F.substr("raw", F.lit(2)), F.lit(",")).try_cast("decimal(38,2)").alias("amount"),
             F.substring("raw", 1, 1).alias("currency"), "raw")
    return dates.where("on_date IS NOT NULL").unionByName(money)


def extract_urls(df: DataFrame, key: str, text: str) -> DataFrame:
    """URLs in text, one row each, in order."""
    found = F.regexp_extract_all(text, F.lit(X.URL), F.lit(0))
    return each_at(df, [key], found, "at", "url")


def extract_tags(df: DataFrame, text: str) -> DataFrame:
    """Hashtags and mentions with counts."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[#@][\p{L}\p{N}_]+"), F.lit(0))
    return each(df, [], found, "tag").groupBy("tag").agg(F.count("*").alias("n"))


def extract_timecodes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """mm:ss and h:mm:ss marks with their second of play time."""
    marks = F.regexp_extract_all(text, F.lit(X.TIMECODE), F.lit(0))
    rows = each_at(df, keys, marks, "at", "mark")
    seconds = F.aggregate(F.split("mark", ":"), F.lit(0), lambda acc, p: acc * 60 + p.cast("int"))
    return rows.withColumn("second", seconds)


def scan_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key-like strings in own text, masked to four characters, with length and entropy."""
    found = F.regexp_extract_all(text, F.lit(X.SECRET), F.lit(1))
    rows = each(df, [key], found, "_s")
    return rows.select(
        key,
        F.concat(F.substring("_s", 1, 4), F.lit("****")).alias("masked"),
        F.length("_s").alias("chars"),
        X.entropy(F.col("_s")).alias("bits"),
    )


def validate_luhn(df: DataFrame, group: str, text: str) -> DataFrame:
    """Check-digit pass rate of the sixteen-digit numbers in text, by group."""
    nums = each(df, [group], F.regexp_extract_all(text, F.lit(r"\b[0-9]{16}\b"), F.lit(0)), "num")
    ok = F.count_if(F.expr("luhn_check(num)"))
    return nums.groupBy(group).agg(
        F.count("*").alias("numbers"), ok.alias("passed"), (ok / F.count("*")).alias("rate")
    )


def validate_mod97(df: DataFrame, group: str, code: str) -> DataFrame:
    """Check-digit pass rate of account or entity numbers, by group."""
    ok = F.count_if(X.mod97_valid(F.col(code)))
    return df.groupBy(group).agg(
        F.count("*").alias("codes"), ok.alias("passed"), (ok / F.count("*")).alias("rate")
    )


def validate_contact_syntax(df: DataFrame, group: str, email: str, phone: str) -> DataFrame:
    """Share of rows with well-formed e-mail and E.164 phone, and mean score of 0 to 10."""
    good_mail = F.coalesce(F.col(email).rlike(f"^{X.EMAIL}$"), F.lit(False))
    good_phone = F.coalesce(F.col(phone).rlike(r"^\+[1-9][0-9]{6,14}$"), F.lit(False))
    score = F.when(good_mail, 6).otherwise(0) + F.when(good_phone, 4).otherwise(0)
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(good_mail.cast("int")).alias("mail_share"),
        F.avg(good_phone.cast("int")).alias("phone_share"),
        F.avg(score).alias("score"),
    )


def hash_columns(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Digests of the joined columns."""
    joined = F.concat_ws("|", *cols)
    return df.select(
        key,
        F.md5(joined).alias("md5"),
        F.sha1(joined).alias("sha1"),
        F.sha2(joined, 256).alias("sha256"),
        F.crc32(joined).alias("crc32"),
    )


def digest_groups(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Digests that several rows share: how many rows, and the least and greatest key."""
    digest = F.sha2(F.concat_ws("|", *cols), 256)
    return df.groupBy(digest.alias("sha256")).agg(
        F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")).where(F.col("rows") > 1)


def decode_report(df: DataFrame, group: str, base64: str, hexed: str, url: str) -> DataFrame:
    """Decode stored base64, hex and URL-encoded columns; failures and sizes by group."""
    b = F.try_to_binary(base64, F.lit("base64"))
    h = F.try_to_binary(hexed, F.lit("hex"))
    u = F.try_url_decode(url)
    return df.groupBy(group).agg(
        F.count_if(b.isNull()).alias("base64_failed"),
        F.count_if(h.isNull()).alias("hex_failed"),
        F.count_if(u.isNull()).alias("url_failed"),
        F.sum(F.coalesce(F.octet_length(b), F.lit(0))).alias("base64_bytes"),
        F.sum(F.coalesce(F.octet_length(h), F.lit(0))).alias("hex_bytes"),
        F.sum(F.coalesce(F.length(u), F.lit(0))).alias("url_chars"),
    )


def encode_column(text: Column, codec: str) -> Column:
    """Text as base64, hex or URL-encoded."""
    if codec == "base64":
        return F.base64(F.encode(text, "UTF-8"))
    if codec == "hex":
        return F.hex(F.encode(text, "UTF-8"))
    return F.url_encode(text)


def word_frequency(df: DataFrame, text: str, groups: list[str] = []) -> DataFrame:
    """Word counts, all or by group."""
    words = each(df, groups, X.tokens(F.col(text)), "word")
    return words.groupBy(*groups, "word").agg(F.count("*").alias("n"))


def distinctive_terms(df: DataFrame, group: str, text: str, k: int) -> DataFrame:
    """Highest TF-IDF words per group: group count times log of groups over groups using it."""
    tf = word_frequency(df, text, [group])
    per_word = tf.groupBy("word").agg(F.count("*").alias("in_groups"))
    groups = df.select(group).agg(F.count_distinct(group)).scalar()
    scored = tf.join(per_word, "word").withColumn(
        "score", F.col("n") * F.log((1 + groups) / (0.0 + F.col("in_groups")))
    )
    return top_k_per_group(
        scored.select(group, "word", "n", "score"), [group],
        [F.desc(F.round("score", 6)), F.asc("word")], k,
    )


def cooccurring_terms(df: DataFrame, text: str, term: str, min_docs: int, k: int) -> DataFrame:
    """Words found together with a keyword, by lift; only rows with the keyword are expanded twice."""
    words = pin(df, [], w=F.array_distinct(X.tokens(F.col(text))))
    has = F.array_contains("w", term)
    facts = words.agg(F.struct(F.count("*").alias("n"), F.count_if(has).alias("n_term"))).scalar()
    counted = (
        each(words, [has.cast("int").alias("_both")], F.col("w"), "word")
        .groupBy("word")
        .agg(F.count("*").alias("docs"), F.sum("_both").alias("together"))
        .where((F.col("together") >= min_docs) & (F.col("word") != term))
    )
    lift = F.col("together") * facts["n"] / (F.col("docs") * facts["n_term"])
    return (
        counted.withColumn("lift", lift)
        .orderBy(F.desc(F.round("lift", 9)), "word")
        .limit(k)
    )


def text_diff(a: DataFrame, b: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines added, removed and kept between two versions, counted with repeats."""
    def lines(df: DataFrame, old: int, new: int) -> DataFrame:
        return each(df, keys, F.split(text, "\n"), "line").select(
            *keys, "line", F.lit(old).alias("o"), F.lit(new).alias("n")
        )

    both = lines(a, 1, 0).unionByName(lines(b, 0, 1))
    per_line = both.groupBy(*keys, "line").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return per_line.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("added"),
        F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("removed"),
        F.sum(F.least("o", "n")).alias("kept"),
    )


#: Words in the most documents, which every task is given instead of being sent all their occurrences.
COMMON_WORDS = 4096


def summarise_extractive(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Best ``k`` sentences per document by mean document frequency of their words.

    Occurrences of the ``COMMON_WORDS`` most common words meet their weight where they are read;
    only those of other words are shuffled to theirs.
    """
    parts = F.filter(F.split(text, r"[.!?][ \n]+"), lambda s: s != "")
    sent = each_at(df, [key], parts, "at", "sentence")
    words = each(sent, [key, "at"], X.tokens(F.col("sentence")), "word")
    weight = (
        each(df, [], F.array_distinct(X.tokens(F.col(text))), "word")
        .groupBy("word")
        .agg(F.count("*").alias("docs"))
    )
    weight = cut_lineage(weight)
    common = F.broadcast(cut_lineage(weight.orderBy(F.desc("docs"), "word").limit(COMMON_WORDS)))
    weighed = words.join(common, "word").unionByName(words.join(common, "word", "left_anti").join(weight, "word"))
    scored = (
        weighed.groupBy(key, "at")
        .agg(F.avg(F.log(1.0 + F.col("docs"))).alias("score"))
    )
    best = top_k_per_group(scored, [key], [F.desc(F.round("score", 6)), F.asc("at")], k)
    return sent.join(best, [key, "at"]).select(key, "position", "at", "score", "sentence")


#: Parts in which the entries of all sets are counted at most, and entries of a part below which there are fewer.
ENTRY_PARTS, ENTRY_ROWS = 8, 1 << 22


def prefix_buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """The rarest shared entries of each set, as buckets (id, bucket, about = size and place of the entry).

    ``sets`` is (id, s). With the entries of a set in one order, rarest first, two sets of a Jaccard of
    ``threshold`` or more share one of the first ``n - ceil(threshold * n) + 1``. Entries of one set only
    stand first and are counted, not kept, so what most sets have in common is rarely a bucket. Entries are
    counted part by part, and shared ones are kept of sets only that have one so early. Runs jobs while the plan is built.
    """
    many = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    parts = min(ENTRY_PARTS, 1 + many // ENTRY_ROWS)

    def entries(rows: DataFrame, part: int) -> DataFrame:
        return rows.select("id", F.size("s").alias("n"), F.explode("s").alias("h")).where(F.pmod("h", F.lit(parts)) == part)

    shared = [cut_lineage(entries(sets, part).groupBy("h").agg(F.count("*").alias("df")).where("df > 1")) for part in range(parts)]
    counts = [cut_lineage(entries(sets, part).join(of, "h").groupBy("id", "n").agg(F.count("*").alias("shared")))
              for part, of in enumerate(shared)]
    most = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    counted = reduce(DataFrame.unionByName, counts).groupBy("id", "n").agg(F.sum("shared").alias("shared"))
    early = cut_lineage(counted.where(F.col("n") - F.col("shared") < most).select("id").distinct())
    kept = [cut_lineage(entries(sets.join(early, "id", "left_semi"), part).join(of, "h").select("id", "n", "df", "h"))
            for part, of in enumerate(shared)]
    discard(*shared, *counts, early)
    ordered = reduce(DataFrame.unionByName, kept).groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    alone = F.col("n") - F.size("t")
    first = pin(ordered, ["id", "n"], alone=alone, t=F.slice("t", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int")))
    buckets = cut_lineage(each_at(first, ["id", "n", "alone"], F.col("t.h"), "at", "bucket").select(
        "id", "bucket", F.struct("n", (F.col("alone") + F.col("at")).alias("at")).alias("about")))
    discard(*kept)
    return buckets


def may_reach(threshold: float):
    """Whether sets that meet in a bucket can have a Jaccard of ``threshold``, from sizes and places alone.

    The bound on places holds for the first entry two sets share, where they meet in any case.
    """
    def may(x: Column, y: Column) -> Column:
        sizes = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * threshold - 1e-9
        rest = F.least(x["n"] - x["at"], y["n"] - y["at"])
        return sizes & (rest >= (x["n"] + y["n"]) * (threshold / (1 + threshold)) - 1e-9)

    return may


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.7, n: int = 3) -> DataFrame:
    """Each near copy with the leader it repeats and their exact Jaccard of word n-grams.

    Of equal texts (equal words in order) the smallest key stands for all and leads the others. Every
    such representative follows the smallest representative of a Jaccard of ``threshold`` or more, none
    missed: sets meet on their rarest shared n-grams, bounded by size and place, and are compared with
    leaders in order of their keys, never pair by pair. Texts of fewer than ``n`` words are one n-gram;
    texts without words are equal to each other, and a null text follows nothing.
    """
    named = df.select(F.col(key).alias("id"), F.col(text).alias("_t")).where("_t IS NOT NULL")

    def sets(rows: DataFrame) -> DataFrame:
        """N-grams of the texts that stand for all; long as they are, they are made where they will lie."""
        words = pin(rows.join(first, "id", "left_semi"), ["id"], _w=X.tokens(F.col("_t")))
        grams = F.when(F.size("_w") >= n, X.ngrams(F.col("_w"), n)).otherwise(
            F.array(F.array_join("_w", " "))
        )
        return words.select("id", F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))).alias("s"))

    texts = cut_lineage(pin(named, ["id"], _w=X.tokens(F.col("_t"))).select("id", F.md5(F.array_join("_w", " ")).alias("_d")))
    copies = cut_lineage(texts.groupBy("_d").agg(F.min("id").alias("leader")))
    exact = (
        texts.join(copies, "_d")
        .where(F.col("id") != F.col("leader"))
        .select(F.col("id").alias(key), "leader", F.lit(1.0).alias("jaccard"))
    )
    first = copies.select(F.col("leader").alias("id"))
    shingles = placed(named, "id", made=sets)

    def jaccard(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return both / (F.size(x) + F.size(y) - both)

    buckets = prefix_buckets(shingles, threshold)
    near = follow_leaders(shingles.withColumnRenamed("s", "item"), buckets, jaccard, threshold, may_reach(threshold))
    discard(shingles, buckets)
    return exact.unionByName(
        near.select(F.col("id").alias(key), "leader", F.col("score").alias("jaccard")))


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups with equal content: digest, size and the row to keep."""
    return (
        df.groupBy(F.sha2(text, 256).alias("digest"))
        .agg(F.count("*").alias("copies"), F.min(key).alias("keep"))
        .where("copies > 1")
    )


def passage_reuse(
    df: DataFrame, key: str, text: str, protected: DataFrame, protected_text: str, n: int
) -> DataFrame:
    """Share of each row's word n-grams that come from protected texts.

    N-grams travel as 128 bits (two 64-bit hashes), not as strings.
    """
    def grams() -> Column:
        return F.transform(X.ngrams(F.col("_w"), n), lambda g: F.struct(
            F.xxhash64(g).alias("a"), F.xxhash64(g, F.lit(1)).alias("b")))

    listed = pin(protected, [], _w=X.tokens(F.col(protected_text)))
    known = each(listed, [], grams(), "gram").distinct()
    words = pin(df, [key], _w=X.tokens(F.col(text)))
    totals = words.select(key, (F.size("_w") - (n - 1)).alias("grams")).where("grams > 0")
    hits = (
        each(words, [key], grams(), "gram")
        .join(known, "gram", "left_semi")
        .groupBy(key)
        .agg(F.count("*").alias("reused"))
    )
    return totals.join(hits, key).withColumn("share", F.col("reused") / F.col("grams"))


def tag_clauses(df: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """Rows with the clause labels whose pattern they hold."""
    labels = F.array_compact(
        F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in rules.items()])
    )
    return df.select(key, F.array_sort(labels).alias("labels")).where(F.size("labels") > 0)


def cluster_texts(df: DataFrame, key: str, text: str, k: int, seed: int = 7) -> DataFrame:
    """Group texts on one subject: hashed TF-IDF and seeded k-means.

    Iterates until no centre moves by more than 1e-4; ``maxIter`` only ends runs that circle.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF

    words = df.select(key, X.tokens(F.col(text)).alias("words"))
    # three passes follow, which must not split the texts anew
    tf = cut_lineage(HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 18).transform(words).drop("words"))
    tfidf = IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf)
    model = KMeans(k=k, seed=seed, maxIter=1000, tol=1e-4, initMode="k-means||").fit(tfidf.select("features"))
    return model.transform(tfidf).select(key, F.col("prediction").alias("cluster"))


def term_timeline(df: DataFrame, text: str, ts: str, terms: list[str], grain: str) -> DataFrame:
    """When and how often items are mentioned, by time grain."""
    words = X.tokens(F.col(text))
    return df.groupBy(F.date_trunc(grain, F.col(ts)).alias("at")).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.array_contains(words, x)).alias(f"n_{x}") for x in terms],
    )


def transliterate(df: DataFrame, text: str) -> DataFrame:
    """Add ``latin``: the lower-cased text in plain Latin letters."""
    return df.withColumn("latin", X.latin(F.lower(F.col(text))))


def phonetic_key(df: DataFrame, name: str) -> DataFrame:
    """Spelling variants of names that share a phonetic key of their last word."""
    key = F.soundex(F.element_at(F.split(name, " "), -1))
    return df.groupBy(key.alias("key")).agg(
        F.count("*").alias("rows"),
        F.count_distinct(name).alias("variants"),
        F.min(name).alias("first_name"),
        F.max(name).alias("last_name"),
    ).withColumn("spread", F.levenshtein("first_name", "last_name"))


def compare_languages(df: DataFrame, row: str, lang: str, langs: list[str], size: str) -> DataFrame:
    """Coverage side by side per language: counts and mean length."""
    aggs = []
    for x in langs:
        on = F.col(lang) == x
        aggs += [F.count_if(on).alias(f"n_{x}"),
                 F.coalesce(F.avg(F.when(on, F.col(size))), F.lit(0.0)).alias(f"size_{x}")]
    return df.groupBy(row).agg(*aggs)


def id_timestamp(df: DataFrame, col: str) -> DataFrame:
    """Counts by hour of the time in a time-ordered id (high 32 bits are seconds)."""
    at = F.timestamp_seconds(F.shiftright(F.col(col), 32))
    return df.groupBy(F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("n"))

"""Search, predicates and ranking: catalogue entries with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.operators import search as B

TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x<>'')"


@query("b01_boolean_search", rf"""SELECT doc_id, lang, source, n_chars FROM (SELECT *, {TOK} AS w FROM documents)
 WHERE lang='en' AND n_chars>200 AND list_contains(w,'the') AND list_has_any(w,['from','this','were','ining'])
 AND NOT list_contains(w,'token')""")
def _(t):
    return B.boolean_search(
        t.documents, "text", ["The"], ["from", "this", "were", "Ining"], ["token"],
        [F.col("lang") == "en", F.col("n_chars") > 200],
    ).select("doc_id", "lang", "source", "n_chars")


@query("b02_ranked_search", rf"""WITH d AS (SELECT doc_id, {TOK} AS w FROM documents),
 c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x='reading')) AS tf0,
  len(list_filter(w, lambda x: x='that')) AS tf1, len(list_filter(w, lambda x: x='with')) AS tf2 FROM d),
 s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (tf0>0) AS d0, count(*) FILTER (tf1>0) AS d1,
  count(*) FILTER (tf2>0) AS d2 FROM c),
 r AS (SELECT doc_id, ln(1+(n-d0+0.5::double)/(d0+0.5::double))*tf0*2.2::double/(tf0+1.2::double*(0.25::double+0.75::double*dl/a))
 + ln(1+(n-d1+0.5::double)/(d1+0.5::double))*tf1*2.2::double/(tf1+1.2::double*(0.25::double+0.75::double*dl/a))
 + ln(1+(n-d2+0.5::double)/(d2+0.5::double))*tf2*2.2::double/(tf2+1.2::double*(0.25::double+0.75::double*dl/a)) AS sc
 FROM c, s WHERE tf0+tf1+tf2>0)
 SELECT doc_id, R4(sc) AS score FROM r ORDER BY round(sc,6) DESC, doc_id LIMIT 20""")
def _(t):
    return B.ranked_search(t.documents, "doc_id", "text", ["reading", "that", "with"], 20)


@query("b03_phrase_search", rf"""WITH d AS (SELECT doc_id, {TOK} AS w FROM documents),
 p AS (SELECT doc_id, w, unnest(generate_series(1, len(w)-1)) AS pos FROM d)
 SELECT doc_id, pos AS "at" FROM p WHERE w[pos]='of' AND w[pos+1]='the'""")
def _(t):
    return B.phrase_search(t.documents, ["doc_id"], "text", "Of-the")


@query("b03_phrase_in_dialogue", rf"""WITH d AS (SELECT conv_id, turn, {TOK} AS w FROM conversations),
 p AS (SELECT conv_id, turn, w, unnest(generate_series(1, len(w)-1)) AS pos FROM d)
 SELECT conv_id, turn, pos AS "at" FROM p WHERE w[pos]='in' AND w[pos+1]='the'""")
def _(t):
    return B.phrase_search(t.conversations, ["conv_id", "turn"], "text", "in the")


GREP = r"[A-Za-z]+@[a-z]+|[0-9]{4,}"


@query("b04_regex_grep", rf"""WITH d AS (SELECT doc_id, string_split_regex(text,'{GREP}') AS p,
 regexp_extract_all(text,'{GREP}') AS m FROM documents),
 e AS (SELECT doc_id, p, m, unnest(generate_series(1,len(m))) AS i FROM d)
 SELECT doc_id, i AS hit_no, m[i] AS match, right(p[i],20) AS before, left(p[i+1],20) AS after FROM e""")
def _(t):
    return B.regex_grep(t.documents, ["doc_id"], "text", GREP, 20)


@query("b05_facet_filter", """WITH f AS (SELECT * FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice>905)
 SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM f GROUP BY 2
 UNION ALL SELECT 'p_type', p_type, count(*) FROM f GROUP BY 2
 UNION ALL SELECT 'p_size', cast(p_size AS varchar), count(*) FROM f GROUP BY 2""")
def _(t):
    return B.facet_filter(
        t.part, [F.col("p_size").between(5, 30), F.col("p_retailprice") > 905], ["p_brand", "p_type", "p_size"])


@query("b06_keyword_monitor", rf"""WITH d AS (SELECT doc_id, unnest({TOK}) AS term FROM documents)
 SELECT doc_id, term, count(*) AS hits FROM d WHERE term IN (SELECT p FROM (
 SELECT DISTINCT string_split(lower(c_mktsegment),' ')[1] AS p FROM customer UNION SELECT 'reading' UNION SELECT 'quele'
 UNION SELECT 'license' UNION SELECT 'copyright')) GROUP BY 1,2""")
def _(t):
    terms = t.customer.select(F.lower("c_mktsegment").alias("term")).distinct().union(
        t.spark.createDataFrame([("reading",), ("quele",), ("license",), ("copyright",)], "term string"))
    return B.keyword_monitor(t.documents, "doc_id", "text", terms)


@query("b07_prefix_suggest", rf"""WITH d AS (SELECT unnest({TOK}) AS word FROM documents)
 SELECT word, count(*) AS n FROM d WHERE starts_with(word,'th') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    return B.prefix_suggest(t.documents, "text", "th", 15)


@query("b08_rank_fusion", """WITH l AS (SELECT source, doc_id%97 AS item, max(n_chars) AS score FROM documents GROUP BY 1,2),
 r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score DESC) AS rk FROM l),
 f AS (SELECT item, sum(1/(60+rk)::double) AS fused, count(*) AS lists FROM r GROUP BY 1)
 SELECT item, R4(fused) AS fused, lists FROM f ORDER BY round(f.fused,6) DESC, item LIMIT 20""")
def _(t):
    lists = t.documents.groupBy("source", (F.col("doc_id") % 97).alias("item")).agg(F.max("n_chars").alias("score"))
    return B.rank_fusion(lists, "source", "item", "score", 20)


@query("b09_result_overlap", rf"""WITH c AS (SELECT lang, word, count(*) AS n FROM (
 SELECT lang, unnest({TOK}) AS word FROM documents) GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS p FROM c),
 top AS (SELECT * FROM r WHERE p<=100), b AS (SELECT word, p AS bp FROM top WHERE lang='en')
 SELECT lang, count(bp) AS overlap, R4(count(bp)/(count(*)+(SELECT count(*) FROM b)-count(bp))) AS jaccard,
 R4(coalesce(avg(abs(p-bp)),-1)) AS shift FROM top LEFT JOIN b USING (word) WHERE lang<>'en' GROUP BY 1""")
def _(t):
    from gleaner.operators.text import word_frequency

    return B.result_overlap(word_frequency(t.documents, "text", ["lang"]), "lang", "word", "n", "en", 100)


@query("b10_enrich_lookup", """SELECT l_returnflag, p_brand, count(*) AS lines, R4(sum(p_retailprice)) AS price
 FROM lineitem LEFT JOIN part ON l_partkey=p_partkey GROUP BY 1,2""")
def _(t):
    dim = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    rows = B.enrich_lookup(t.lineitem.select("l_partkey", "l_returnflag"), dim, "l_partkey")
    return rows.groupBy("l_returnflag", "p_brand").agg(
        F.count("*").alias("lines"), F.sum("p_retailprice").alias("price"))

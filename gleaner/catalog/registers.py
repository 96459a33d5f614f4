"""Registries, matching, catalogues: entries with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.catalog.search import TOK
from gleaner.operators import registers as H

BUYERS = "SELECT c_custkey, concat(substr(md5(cast(c_custkey%300 as varchar(9))),1,8),' Ltd') AS company FROM customer"
LISTED = """SELECT concat(substr(md5(cast(s_suppkey as varchar(9))),1,3),CASE WHEN s_suppkey%2=0 THEN 'x' ELSE 'xy' END,
 substr(md5(cast(s_suppkey as varchar(9))),5,4),' GmbH') AS entry FROM supplier"""


@query("h01_watchlist_screening", f"""WITH b AS (SELECT *, regexp_replace(upper(company),'{H.LEGAL_FORMS}','') AS n FROM ({BUYERS})),
 l AS (SELECT entry, regexp_replace(upper(entry),'{H.LEGAL_FORMS}','') AS e FROM ({LISTED})),
 s AS (SELECT c_custkey, company, entry, levenshtein(n,e) AS edits, 1-levenshtein(n,e)/cast(greatest(length(n),length(e)) as double) AS score FROM b, l)
 SELECT c_custkey, company, entry, edits, R4(score) AS score FROM s WHERE edits<=2 AND score>=0.75""")
def _(t):
    return H.watchlist_screening(t.sql(BUYERS), "company", t.sql(LISTED), "entry", 2, 0.75)


@query("h02_id_lookup", """SELECT found, count(*) AS n, count(distinct k) AS ids FROM (SELECT o_custkey*2 AS k, EXISTS
 (SELECT 1 FROM customer WHERE c_custkey=o_custkey*2) AS found FROM orders) GROUP BY 1""")
def _(t):
    ids = t.orders.select((F.col("o_custkey") * 2).alias("c_custkey"))
    return H.id_lookup(ids, t.customer, "c_custkey").groupBy("found").agg(
        F.count("*").alias("n"), F.count_distinct("c_custkey").alias("ids"))


@query("h03_trade_flows", """SELECT sn.n_name AS seller, cn.n_name AS buyer, p_type, count(*) AS shipments,
 R4(sum(cast(l_extendedprice*(1-l_discount) as decimal(18,4)))) AS value FROM lineitem JOIN orders ON l_orderkey=o_orderkey
 JOIN customer ON o_custkey=c_custkey JOIN nation cn ON c_nationkey=cn.n_nationkey JOIN supplier ON l_suppkey=s_suppkey
 JOIN nation sn ON s_nationkey=sn.n_nationkey JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3""")
def _(t):
    flows = H.trade_flows(t.lineitem, t.orders, t.customer, t.supplier, t.part, t.nation)
    return flows.withColumn("shipments", F.col("shipments").cast("bigint"))


@query("h04_harmonise_sources", """SELECT cast(c_custkey as varchar) AS id, upper(c_name) AS name, c_nationkey AS country, c_mktsegment AS kind,
 'customers' AS provenance FROM customer UNION ALL SELECT concat('S',cast(s_suppkey as varchar)), upper(s_name), s_nationkey, NULL, 'suppliers' FROM supplier""")
def _(t):
    return H.harmonise_sources(
        {"customers": t.customer, "suppliers": t.supplier},
        {"customers": {"id": "cast(c_custkey as string)", "name": "upper(c_name)", "country": "c_nationkey", "kind": "c_mktsegment"},
         "suppliers": {"id": "concat('S', cast(s_suppkey as string))", "name": "upper(s_name)", "country": "s_nationkey"}})


@query("h05_fuzzy_name_search", """WITH n AS (SELECT p_name, count(*) AS rows FROM part GROUP BY 1),
 s AS (SELECT p_name, rows, q AS asked, levenshtein(lower(p_name),lower(q)) AS distance FROM n, (SELECT unnest(['smal rng','Blu widgets','cold anvill']) AS q))
 SELECT p_name, rows, asked, distance, position FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, p_name) AS position FROM s) WHERE position<=3""")
def _(t):
    return H.fuzzy_name_search(t.part, "p_name", ["smal rng", "Blu widgets", "cold anvill"], 3)


NUMBERS = "SELECT cast(1000000+event_id*7919%8999993 as varchar(20)) AS num FROM events"
PREFIXES = """SELECT cast(1000+p_partkey*37%8999 as varchar(20)) AS prefix, max(p_brand) AS owner FROM part GROUP BY 1
 UNION ALL SELECT cast(n_nationkey+10 as varchar(20)), n_name FROM nation UNION ALL SELECT cast(r_regionkey+1 as varchar(20)), r_name FROM region"""


@query("h06_longest_prefix_lookup", f"""SELECT num, arg_max(owner, length(prefix)) AS owner, max(length(prefix)) AS digits FROM (
 SELECT DISTINCT num FROM ({NUMBERS} UNION ALL SELECT unnest(regexp_extract_all(text,'\\b[0-9]{{16}}\\b')) FROM documents)) LEFT JOIN ({PREFIXES}) ON starts_with(num,prefix) WHERE num IS NOT NULL GROUP BY 1""")
def _(t):
    nums = t.sql(NUMBERS).union(t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{16}\b"), F.lit(0)))))
    return H.longest_prefix_lookup(nums, "num", t.sql(PREFIXES), "prefix", "owner")


@query("h07_company_mentions", f"""WITH d AS (SELECT source, lang, date '2024-01-01' + cast(doc_id%90 as int) AS seen, concat(text,' ',coalesce(p_name,'')) AS text
 FROM documents LEFT JOIN part ON p_partkey=doc_id)
 SELECT name, source, lang, strftime(date_trunc('month',seen),'%Y-%m-%d') AS period, count(*) AS mentions
 FROM (SELECT source, lang, seen, unnest({TOK}) AS name FROM d)
 WHERE name IN (SELECT DISTINCT string_split(p_name,' ')[2] FROM part) GROUP BY 1,2,3,4""")
def _(t):
    docs = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id"), "left").select(
        "source", "lang", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("seen"),
        F.concat("text", F.lit(" "), F.coalesce("p_name", F.lit(""))).alias("text"))
    names = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return H.company_mentions(docs, "text", ["source", "lang"], names, "name", "seen", "month")


@query("h08_catalogue_availability", """SELECT md5(text) AS title, count(distinct source) AS sources, count(*) AS rows,
 CASE WHEN count(distinct source)=1 THEN min(source) ELSE '' END AS only_in FROM documents GROUP BY 1""")
def _(t):
    return H.catalogue_availability(t.documents, F.md5("text"), "source")


@query("h09_map_diff", """SELECT event_id, concat_ws('|', CASE WHEN user_id%3=0 THEN 'extra' END,
 CASE WHEN cast(regexp_extract(props,'([0-9]+)',1) as int)%10<>user_id%10 THEN 'k' END, CASE WHEN user_id%2=0 THEN 'type' END) AS changed FROM events""")
def _(t):
    rows = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    a = F.expr("map('k', cast(k%10 as string), 'type', event_type)")
    b = F.expr("""map_concat(map('k', cast(user_id%10 as string), 'type', if(user_id%2=0, 'other', event_type)),
        if(user_id%3=0, map('extra','1'), cast(map() as map<string,string>)))""")
    return H.map_diff(rows.withColumn("a", a).withColumn("b", b), "a", "b").select("event_id", "changed")

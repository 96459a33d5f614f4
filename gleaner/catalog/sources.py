"""Sources and sinks: round trips and profiles with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.plans.derive import BASE
from gleaner.sources import files as R
from gleaner.sources import profile as P
from gleaner.sources import sinks as W
from gleaner.sources.tables import SCHEMAS


@query("a01_read_table", """SELECT l_returnflag, l_linestatus, count(*) AS n, R4(sum(cast(l_quantity as decimal(18,2)))) AS quantity,
 R4(avg(l_extendedprice)) AS mean_price FROM lineitem WHERE l_shipdate <= timestamp '2000-09-02' GROUP BY 1,2""")
def _(t):
    old = t.lineitem.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return old.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"),
        F.avg("l_extendedprice").alias("mean_price"))


@query("a02_read_csv", """SELECT c_custkey, c_name, c_nationkey, R4(c_acctbal) AS c_acctbal, c_mktsegment, c_custkey%50=0 AS bad
 FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey%50=0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer)""")
def _(t):
    path = W.scratch_folder(t.spark)
    broken = F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string"))
    W.write_csv(t.customer.withColumn("c_nationkey", broken), path)
    back = R.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return back.withColumn("bad", F.col(R.BAD_ROW).isNotNull()).drop(R.BAD_ROW)


@query("a03_read_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    path = W.scratch_folder(t.spark)
    W.write_json(t.conversations, path)
    return R.read_json_lines(t.spark, path, "conv_id bigint, turn bigint, role string, text string").where(
        F.col(R.BAD_ROW).isNull()).drop(R.BAD_ROW)


@query("a04_read_xml_items", "SELECT doc_id, lang, source, md5(text) AS digest FROM documents")
def _(t):
    path = W.scratch_folder(t.spark)
    W.write_xml(t.documents.select("doc_id", "lang", "source", "text"), path, "feed", "item")
    items = R.read_xml_items(t.spark, path, "item", "doc_id bigint, lang string, source string, text string")
    return items.select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@query("a05_read_text_corpus", """SELECT lang, count(*) AS lines, cast(sum(length(line)) as bigint) AS chars FROM (
 SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def _(t):
    path = W.scratch_folder(t.spark)
    t.documents.select("lang", "text").write.partitionBy("lang").text(path, lineSep="\n")
    rows = R.read_text_corpus(t.spark, path)
    return rows.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(
        F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("a06_file_inventory")
def _(t):
    return R.inventory_totals(R.file_inventory(t.spark, t.folder))


@query("a07_write_csv", """SELECT role, count(*) AS n, cast(sum(length(words)) as bigint) AS chars FROM (
 SELECT role, concat_ws('|', role, cast(turn as varchar), text) AS words FROM conversations) GROUP BY 1""")
def _(t):
    path = W.scratch_folder(t.spark)
    W.write_csv(t.conversations.select("role", F.array("role", F.col("turn").cast("string"), F.col("text")).alias("words")), path)
    back = R.read_csv(t.spark, path, "role string, words string", escaped=True)
    return back.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("words")).alias("chars"))


@query("a08_write_json", "SELECT event_id, user_id, R4(value) AS value, strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts FROM events")
def _(t):
    path = W.scratch_folder(t.spark)
    W.write_json(t.events.select("event_id", "user_id", "value", "ts"), path)
    return R.read_json_lines(t.spark, path, "event_id bigint, user_id bigint, value double, ts timestamp_ntz").drop(R.BAD_ROW)


@query("a09_write_graph_tables", """SELECT 'node' AS kind, node AS a, '' AS b, count(*) AS n FROM (
 SELECT concat('u',cast(user_id as varchar)) AS node FROM events UNION ALL SELECT event_type FROM events) GROUP BY 2
 UNION ALL SELECT 'edge', concat('u',cast(user_id as varchar)), event_type, count(*) FROM events GROUP BY 2,3""")
def _(t):
    path = W.scratch_folder(t.spark)
    e = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"), "event_type")
    W.write_graph_tables(e, "u", "event_type", path)
    nodes = t.spark.read.parquet(f"{path}/nodes").selectExpr("'node' AS kind", "node AS a", "'' AS b", "degree AS n")
    return nodes.union(t.spark.read.parquet(f"{path}/edges").selectExpr("'edge'", "source", "target", "weight"))


@query("a10_write_routed", "SELECT lang, count(*) AS n, cast(sum(n_chars) as bigint) AS chars FROM documents GROUP BY 1")
def _(t):
    path = W.scratch_folder(t.spark)
    W.write_routed(t.documents, path, "lang")
    back = t.spark.read.parquet(path)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a11_append_snapshot", """WITH r AS (SELECT digest, captured_on, url, row_number() OVER (PARTITION BY digest ORDER BY captured_on, page_id, url) AS rn FROM v_captures)
 SELECT sha256(digest) AS digest, cast(captured_on as varchar) AS captured_on, url FROM r WHERE rn=1""")
def _(t):
    path = W.scratch_folder(t.spark)
    c = t.v_captures.withColumnRenamed("digest", "content").select("captured_on", "page_id", "url", "content")
    cut = F.lit("2024-02-01").cast("date")
    W.append_snapshot(c.where(F.col("captured_on") < cut), "content", "captured_on", path)
    W.append_snapshot(c.where(F.col("captured_on") >= cut), "content", "captured_on", path)
    return t.spark.read.parquet(path).select("digest", "captured_on", "url")


@query("a12_export_issue_table", """SELECT conv_id, role, list_filter(string_split(role,'s'), lambda x: true)[1] AS label, i AS line_no FROM (
 SELECT conv_id, role, unnest(generate_series(1, 1+turn%2)) AS i FROM conversations)""")
def _(t):
    path = W.scratch_folder(t.spark)
    nested = t.conversations.select(
        F.struct("conv_id", "role").alias("issue"), F.struct(F.split("role", "s")[0].alias("label")).alias("meta"),
        F.sequence(F.lit(1).cast("bigint"), 1 + F.col("turn") % 2).alias("lines"))
    W.export_issue_table(nested, {"conv_id": "issue.conv_id", "role": "issue.role", "label": "meta.label", "line_no": "item"}, "lines", path)
    back = R.read_csv(t.spark, path, "conv_id bigint, role string, label string, line_no bigint").drop(R.BAD_ROW)
    return back.fillna("", ["label"])


KIND = "CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' " \
    "WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(any_value(typeof({c}))) END"


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


@query("a13_table_profile", " UNION ALL ".join(
    f"""SELECT '{n}' AS "table", '{c}' AS "column", {KIND.format(c=c)} AS "type", count(*) AS rows, R4(count(*) FILTER ({c} IS NULL)/count(*)) AS null_share,
 count(distinct {c}) AS distinct_values FROM {n}""" for n in BASE for c in _columns(n)))
def _(t):
    return P.table_profile({n: getattr(t, n) for n in BASE}, exact=True)


@query("a13_table_profile_sketch")
def _(t):
    return P.table_profile({n: getattr(t, n) for n in BASE})

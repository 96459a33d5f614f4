"""Structured Streaming: file streams run to the end of their input, with batch twins in SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.catalog.search import TOK
from gleaner.catalog.web import HOST
from gleaner.functions.webcols import host_of
from gleaner.streaming import operators as J
from gleaner.streaming.runner import as_stored, latest_version, read_stream, run_arrivals, run_to_table

CLOSED = "(SELECT max(ts) - interval 1 hour FROM events)"


def _events(t):
    return read_stream(t.spark, t.folder, "events")


@query("j01_stream_tumbling_counts", f"""SELECT strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
 GROUP BY 1,2, date_trunc('day',ts) HAVING date_trunc('day',ts) + interval 1 day <= {CLOSED}""")
def _(t):
    out = run_to_table(J.stream_tumbling_counts(_events(t), "ts", "event_type", "1 day", "1 hour"))
    return out.withColumn("window_start", as_stored(F.col("window_start")))


# Events as they arrive: four quarters of the time, then rows of the first half that were held up.
SPAN = "SELECT min(ts) AS a, max(ts) AS b FROM events"
HELD_UP = f"event_id%50=0 AND ts < (SELECT a + (b-a)/2 FROM ({SPAN}))"


def _arrivals(t):
    a, b = t.events.agg(F.min("ts"), F.max("ts")).first()
    ev = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [a + (b - a) * i / 4 for i in range(5)]
    stored = F.col("ts").cast("timestamp_ntz")
    late = (F.col("event_id") % 50 == 0) & (stored < F.lit(cuts[2]))
    part = lambda i: (stored >= F.lit(cuts[i])) & ((stored < F.lit(cuts[i + 1])) if i < 3 else F.lit(True))
    return [*[ev.where(part(i) & ~late) for i in range(4)], ev.where(late)]


@query("j01_stream_arrivals", f"""SELECT strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
 WHERE NOT ({HELD_UP}) GROUP BY 1,2, date_trunc('day',ts) HAVING date_trunc('day',ts) + interval 1 day <= {CLOSED}""")
def _(t):
    out, _late = run_arrivals(_arrivals(t), lambda s: J.stream_tumbling_counts(s, "ts", "event_type", "1 day", "1 hour"))
    return out.withColumn("window_start", as_stored(F.col("window_start")))


@query("j04_stream_alert_arrivals", f"""WITH d AS (SELECT user_id, date_trunc('day',ts) AS s, sum(value) AS total FROM events
 WHERE NOT ({HELD_UP}) GROUP BY 1,2 HAVING date_trunc('day',ts)+interval 1 day <= {CLOSED}),
 p AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY s) AS before FROM d)
 SELECT user_id, strftime(s,'%Y-%m-%d %H:%M:%S') AS window_start, R4(total) AS total FROM p WHERE total>=120 AND (before IS NULL OR before<120)""")
def _(t):
    out, _late = run_arrivals(_arrivals(t), lambda s: J.stream_threshold_alert(s, "user_id", "ts", "value", 120.0, "1 day", "1 hour"))
    return out.withColumn("window_start", as_stored(F.col("window_start")))


@query("j02_stream_sliding_trend", f"""WITH w AS (SELECT unnest([date_trunc('day',ts) + to_hours(cast(floor(hour(ts)/12)*12 as bigint)),
  date_trunc('day',ts) + to_hours(cast(floor(hour(ts)/12)*12-12 as bigint))]) AS s, event_type, value FROM events)
 SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, R4(sum(value)) AS total FROM w GROUP BY s, event_type
 HAVING s + interval 24 hour <= {CLOSED}""")
def _(t):
    out = run_to_table(J.stream_sliding_trend(_events(t), "ts", "event_type", "value", "24 hours", "12 hours", "1 hour"))
    return out.withColumn("window_start", as_stored(F.col("window_start")))


@query("j03_stream_sessions", f"""WITH s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
 SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + interval 1 hour THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
 SELECT user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts)+interval 1 hour,'%Y-%m-%d %H:%M:%S') AS closed, count(*) AS hits
 FROM s GROUP BY user_id, n HAVING max(ts)+interval 1 hour <= {CLOSED}""")
def _(t):
    out = run_to_table(J.stream_sessions(_events(t), "ts", "user_id", "1 hour", "1 hour"))
    return out.withColumn("started", as_stored(F.col("started"))).withColumn("closed", as_stored(F.col("closed")))


@query("j04_stream_threshold_alert", f"""WITH d AS (SELECT user_id, date_trunc('day',ts) AS s, sum(value) AS total FROM events GROUP BY 1,2
 HAVING date_trunc('day',ts)+interval 1 day <= {CLOSED}),
 p AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY s) AS before FROM d)
 SELECT user_id, strftime(s,'%Y-%m-%d %H:%M:%S') AS window_start, R4(total) AS total FROM p WHERE total>=120 AND (before IS NULL OR before<120)""")
def _(t):
    out = run_to_table(J.stream_threshold_alert(_events(t), "user_id", "ts", "value", 120.0, "1 day", "1 hour"))
    return out.withColumn("window_start", as_stored(F.col("window_start")))


@query("j05_stream_keyword_alert", f"""SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents)
 WHERE term IN ('reading','token','that','lang')""")
def _(t):
    terms = t.spark.createDataFrame([("reading",), ("token",), ("that",), ("lang",)], "term string")
    docs = read_stream(t.spark, t.folder, "documents")
    return run_to_table(J.stream_keyword_alert(docs, "doc_id", "text", terms, "term"))


@query("j06_stream_blocklist_join", f"""SELECT page_id, {HOST} AS host, CASE WHEN {HOST} LIKE '%example.net' THEN 'example.net' ELSE 'cheap-pills.example.com' END AS entry
 FROM pages WHERE {HOST} LIKE '%example.net' OR {HOST} LIKE '%.cheap-pills.example.com' OR {HOST}='cheap-pills.example.com'""")
def _(t):
    feed = t.spark.createDataFrame([("cheap-pills.example.com",), ("example.net",)], "entry string")
    pages = read_stream(t.spark, t.folder, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    return run_to_table(J.stream_blocklist_join(pages, "page_id", "host", feed, "entry"))


@query("j07_stream_latest_state", """SELECT user_id, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS ts, max_by(event_id,ts) AS event_id, max_by(event_type,ts) AS event_type
 FROM events GROUP BY 1""")
def _(t):
    out = run_to_table(J.stream_latest_state(_events(t), "user_id", ["ts", "event_id"], ["event_type"]), "update")
    return latest_version(out, ["user_id"]).withColumn("ts", as_stored(F.col("ts")))


@query("j08_stream_dedupe", "SELECT DISTINCT user_id, event_type, cast(cast(ts as date) as varchar) AS day FROM events")
def _(t):
    ev = _events(t).withColumn("day", F.to_date("ts")).select("user_id", "event_type", "day", "ts")
    return run_to_table(J.stream_dedupe(ev, "ts", ["user_id", "event_type", "day"], "1 hour")).select("user_id", "event_type", "day")


@query("j09_stream_interval_join", """SELECT o_orderkey, l_linenumber, cast(cast(l_shipdate as date) as varchar) AS shipped FROM orders JOIN lineitem ON o_orderkey=l_orderkey
 AND l_shipdate>=o_orderdate AND l_shipdate<=o_orderdate + interval 60 day""")
def _(t):
    o = read_stream(t.spark, t.folder, "orders").select("o_orderkey", "o_orderdate")
    l = read_stream(t.spark, t.folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    out = run_to_table(J.stream_interval_join(o, l, "o_orderkey", "o_orderdate", "l_shipdate", "60 days", "1 day"))
    return out.select("o_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))


@query("j10_stream_expiry_reminder", """WITH p AS (SELECT page_id, timestamp '2024-01-01' + to_days(cast(page_id%60 as int)) AS seen,
 timestamp '2024-01-01' + to_days(cast(page_id%90 as int)) AS due FROM pages)
 SELECT page_id, strftime(due - interval 5 day,'%Y-%m-%d %H:%M:%S') AS reminded_at FROM p
 WHERE due - interval 5 day <= (SELECT max(seen) FROM p) - interval 1 hour""")
def _(t):
    day0 = F.lit("2024-01-01").cast("timestamp")
    pages = read_stream(t.spark, t.folder, "pages").select(
        "page_id", (day0 + F.make_dt_interval((F.col("page_id") % 60).cast("int"))).alias("seen"),
        (day0 + F.make_dt_interval((F.col("page_id") % 90).cast("int"))).alias("due"))
    out = run_to_table(J.stream_expiry_reminder(pages, "page_id", "seen", "due", 5, "1 hour"))
    return out.withColumn("reminded_at", as_stored(F.col("reminded_at")))


@query("j11_stream_running_balance", """SELECT user_id, cast(coalesce(sum(cast(value as decimal(18,2))) FILTER (event_type='purchase'),0) as double) AS money_out,
 cast(coalesce(sum(cast(value as decimal(18,2))) FILTER (event_type<>'purchase'),0) as double) AS money_in, count(*) AS moves FROM events GROUP BY 1""")
def _(t):
    out = run_to_table(J.stream_running_balance(_events(t), "user_id", "value", F.col("event_type") != "purchase"), "update")
    return latest_version(out, ["user_id"])

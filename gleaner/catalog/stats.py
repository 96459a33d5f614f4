"""Aggregation, windows and time series: catalogue entries with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.operators import stats as S
from gleaner.sources import sinks as W

KINDS = ["click", "error", "purchase", "signup", "view"]

DAILY = """days AS (SELECT user_id, cast(ts as date) AS day, count(*) AS n FROM events GROUP BY 1,2),
 cal AS (SELECT u.user_id, cast(d.day as date) AS day FROM (SELECT DISTINCT user_id FROM days) u,
   (SELECT unnest(generate_series((SELECT min(day) FROM days),(SELECT max(day) FROM days), interval 1 day)) AS day) d),
 series AS (SELECT c.user_id, c.day, coalesce(d.n,0) AS n FROM cal c LEFT JOIN days d
   ON c.user_id=d.user_id AND c.day=d.day)"""


@query("f01_daily_series", f"""WITH {DAILY}
 SELECT user_id, cast(day as varchar) AS day, n FROM series""")
def _(t):
    return S.daily_series(t.events, "user_id", "ts")


@query("f02_growth_delta", f"""WITH {DAILY},
 p AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM series)
 SELECT user_id, cast(day as varchar) AS day, n, prev, n-prev AS delta,
  CASE WHEN prev<>0 THEN R4((n-prev)*100.0/prev) END AS pct FROM p WHERE prev IS NOT NULL""")
def _(t):
    return S.growth_delta(S.daily_series(t.events, "user_id", "ts"), "user_id", "day", "n")


@query("f03_compare_entities", """
 SELECT 'visits' AS measure, cast(count(*) FILTER (user_id=1) as double) AS id_1,
  cast(count(*) FILTER (user_id=2) as double) AS id_2, cast(count(*) FILTER (user_id=3) as double) AS id_3 FROM events
 UNION ALL SELECT 'value', R4(sum(value) FILTER (user_id=1)), R4(sum(value) FILTER (user_id=2)),
  R4(sum(value) FILTER (user_id=3)) FROM events
 UNION ALL SELECT 'kinds', count(distinct event_type) FILTER (user_id=1),
  count(distinct event_type) FILTER (user_id=2), count(distinct event_type) FILTER (user_id=3) FROM events""")
def _(t):
    return S.compare_entities(
        t.events, "user_id", [1, 2, 3],
        {
            "visits": F.count_if,
            "value": lambda on: F.sum(F.when(on, F.col("value"))),
            "kinds": lambda on: F.count_distinct(F.when(on, F.col("event_type"))),
        },
    )


@query("f04_activity_heatmap", "SELECT event_type, hour(ts) AS hour, "
       + ", ".join(f"count(*) FILTER (dayofweek(ts)={d - 1}) AS dow{d}" for d in range(1, 8))
       + " FROM events GROUP BY 1,2")
def _(t):
    return S.activity_heatmap(t.events, "event_type", "ts")


@query("f05_top_k", """SELECT o_orderkey, o_custkey, R4(o_totalprice) AS o_totalprice FROM orders
 ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20""")
def _(t):
    return S.top_k(t.orders, "o_totalprice", "o_orderkey", 20).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query("f06_top_k_per_group", """SELECT n_name, c_custkey, R4(c_acctbal) AS c_acctbal, position FROM (
 SELECT n_name, c_custkey, c_acctbal,
  row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS position
 FROM customer JOIN nation ON c_nationkey=n_nationkey) WHERE position<=3""")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", "c_custkey", "c_acctbal")
    return S.top_k_by_group(rows, "n_name", "c_acctbal", "c_custkey", 3)


@query("f07_engagement_last_n", """SELECT user_id, count(*) AS items, R4(avg(value)) AS mean_value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
 WHERE rn<=40 GROUP BY 1""")
def _(t):
    return S.engagement_last_n(t.events, "user_id", ["ts", "event_id"], "value", 40)


@query("f08_audience_overlap", """SELECT groups, count(*) AS members FROM (
 SELECT followed_by, string_agg(g, '+' ORDER BY g) AS groups FROM (
  SELECT DISTINCT follower AS followed_by, 'g'||cast(followed AS varchar) AS g FROM v_follows
  WHERE followed IN (1,2,3)) GROUP BY 1) GROUP BY 1""")
def _(t):
    rows = t.v_follows.withColumn("grp", F.concat(F.lit("g"), F.col("followed").cast("string")))
    return S.audience_overlap(rows, "grp", "follower", ["g1", "g2", "g3"])


@query("f09_membership_check", """SELECT DISTINCT a.user_id AS follower, (a.user_id*7)%150 AS followed,
 EXISTS (SELECT 1 FROM v_follows f WHERE f.follower=a.user_id AND f.followed=(a.user_id*7)%150) AS held
 FROM events a""")
def _(t):
    pairs = t.events.select(
        F.col("user_id").alias("follower"), (F.col("user_id") * 7 % 150).alias("followed")
    ).distinct()
    return S.membership_check(pairs, t.v_follows, "follower", "followed")


@query("f10_departed_members", """SELECT DISTINCT user_id, event_type FROM events a
 WHERE ts < timestamp '2024-01-15' AND NOT EXISTS (SELECT 1 FROM events b
 WHERE b.ts >= timestamp '2024-01-15' AND b.user_id=a.user_id AND b.event_type=a.event_type
 AND b.value > 50)""")
def _(t):
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    new = t.events.where((F.col("ts") >= cut) & (F.col("value") > 50))
    return S.departed_members(t.events.where(F.col("ts") < cut), new, ["user_id", "event_type"])


@query("f11_non_reciprocal", """SELECT follower, followed FROM v_follows a WHERE NOT EXISTS (
 SELECT 1 FROM v_follows b WHERE b.follower=a.followed AND b.followed=a.follower)""")
def _(t):
    return S.non_reciprocal(t.v_follows, "follower", "followed")


@query("f12_inactivity_score", """SELECT user_id, silent_days, kinds, days,
 CASE WHEN silent_days>=7 THEN 40 ELSE 0 END + CASE WHEN kinds<2 THEN 30 ELSE 0 END
 + CASE WHEN days<4 THEN 20 ELSE 0 END + CASE WHEN m<10 THEN 10 ELSE 0 END AS score FROM (
 SELECT user_id, date_diff('day', cast(max(ts) as date), (SELECT cast(max(ts) as date) FROM events)) AS silent_days,
 count(distinct event_type) AS kinds, count(distinct cast(ts as date)) AS days, avg(value) AS m
 FROM events GROUP BY 1)""")
def _(t):
    return S.inactivity_score(t.events, "user_id", "ts", "event_type", "value")


@query("f13_revenue_estimate", """SELECT l_returnflag, cast(sum(v) as double) AS volume,
 R4(sum(v*cast(0.010+0.001*(cast(p_size AS integer)%5) as decimal(6,3)))) AS low,
 R4(sum(v*cast(0.020+0.002*(cast(p_size AS integer)%5) as decimal(6,3)))) AS high FROM (
 SELECT l_returnflag, l_partkey, sum(cast(l_extendedprice as decimal(18,2))) AS v FROM lineitem GROUP BY 1,2)
 JOIN part ON l_partkey=p_partkey GROUP BY 1""")
def _(t):
    step = F.col("p_size") % 5
    rates = t.part.select(
        F.col("p_partkey").alias("l_partkey"),
        (F.lit(0.01) + 0.001 * step).cast("decimal(6,3)").alias("low_rate"),
        (F.lit(0.02) + 0.002 * step).cast("decimal(6,3)").alias("high_rate"),
    )
    return S.revenue_estimate(t.lineitem, rates, "l_partkey", F.col("l_extendedprice"), "l_returnflag")


@query("f14_message_stats", """SELECT role, count(*) AS messages, count(distinct conv_id) AS chats,
 R4(count(*)/count(distinct conv_id)) AS per_chat, R4(avg(length(text))) AS mean_chars,
 max(length(text)) AS max_chars FROM conversations GROUP BY 1""")
def _(t):
    return S.message_stats(t.conversations, "conv_id", "role", "text")


@query("f14_message_rates", """SELECT conv_id, role, count(*) AS messages, count(distinct conv_id%60+turn//4) AS days,
 R4(count(*)/count(distinct conv_id%60+turn//4)) AS per_day, R4(avg(length(text))) AS mean_chars FROM conversations GROUP BY 1,2""")
def _(t):
    sent = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(
        (F.col("conv_id") % 60).cast("int"), (F.col("turn") * 6).cast("int"))
    return S.message_rates(t.conversations.withColumn("sent", sent), ["conv_id", "role"], "text", "sent")


THREAD = """WITH RECURSIVE w AS (SELECT conv_id, turn, turn AS pos, parent, 0 AS depth FROM v_thread
 UNION ALL SELECT w.conv_id, w.turn, p.turn, p.parent, w.depth+1 FROM w JOIN v_thread p ON w.conv_id=p.conv_id AND w.parent=p.turn)"""


@query("f15_thread_tree", f"""{THREAD} SELECT w.conv_id, w.turn, max_by(pos, depth) AS root, max(depth) AS depth,
 (SELECT count(*) FROM v_thread c WHERE c.conv_id=w.conv_id AND c.parent=w.turn) AS children FROM w GROUP BY 1,2""")
def _(t):
    return S.thread_tree(t.v_thread, "conv_id", "turn", "parent")


@query("f15_thread_paths", f"""{THREAD} SELECT conv_id, turn, depth AS hop, pos AS ancestor FROM w WHERE depth>0""")
def _(t):
    return S.thread_paths(t.v_thread, "conv_id", "turn", "parent")


@query("f16_reply_matrix", """SELECT role, count(*) FILTER (p='user') AS to_user,
 count(*) FILTER (p='assistant') AS to_assistant, count(*) FILTER (p='system') AS to_system FROM (
 SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
 WHERE p IS NOT NULL GROUP BY 1""")
def _(t):
    return S.reply_matrix(t.conversations, "conv_id", "turn", "role", ["user", "assistant", "system"])


@query("f17_duration_total", """SELECT event_type, count(*) AS items, R4(sum(floor(value))) AS total_s,
 R4(avg(floor(value))) AS mean_s,
 format('{:d}:{:02d}:{:02d}', cast(sum(floor(value)) as bigint)//3600,
  (cast(sum(floor(value)) as bigint)//60)%60, cast(sum(floor(value)) as bigint)%60) AS hms
 FROM events GROUP BY 1""")
def _(t):
    return S.duration_total(t.events, "event_type", F.floor("value").cast("double"))


@query("f18_dominant_category", """SELECT p_brand, p_type AS top, n, R4(n/alln) AS share FROM (
 SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn,
 sum(count(*)) OVER (PARTITION BY p_brand) AS alln FROM part GROUP BY 1,2) WHERE rn=1""")
def _(t):
    return S.dominant_category(t.part, "p_brand", "p_type")


SESSIONS = """s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
 SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts)-epoch(lag(ts) OVER w) > 7200 THEN 1 ELSE 0 END AS st
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query("f19_sessionise", f"""WITH {SESSIONS}
 SELECT user_id, cast(session_no as bigint) AS session_no, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS started,
 strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS ended, count(*) AS hits, R4(epoch(max(ts))-epoch(min(ts))) AS seconds
 FROM s GROUP BY user_id, session_no""")
def _(t):
    s = S.sessionise(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 7200)
    return S.session_measures(s, ["user_id"], "ts")


@query("f20_contributor_stats", "SELECT user_id, "
       + ", ".join(f"count(*) FILTER (event_type='{k}') AS n_{k}" for k in KINDS)
       + """, count(distinct cast(ts as date)) AS active_days, count(distinct event_type) AS kinds
 FROM events GROUP BY 1""")
def _(t):
    return S.contributor_stats(t.events, "user_id", "event_type", KINDS, "ts")


@query("f21_composite_score", """SELECT c_custkey, R4(score) AS score, CASE WHEN score>=0.75 THEN 'A'
 WHEN score>=0.5 THEN 'B' WHEN score>=0.25 THEN 'C' ELSE 'D' END AS band FROM (
 SELECT c_custkey, 0.0 + cast(0.7 as double)*(c_acctbal-(SELECT min(c_acctbal) FROM customer))/
  ((SELECT max(c_acctbal) FROM customer)-(SELECT min(c_acctbal) FROM customer))
 + cast(0.3 as double)*(cast(c_nationkey as double)-(SELECT min(c_nationkey) FROM customer))/
  ((SELECT max(c_nationkey) FROM customer)-(SELECT min(c_nationkey) FROM customer)) AS score FROM customer)""")
def _(t):
    return S.composite_score(
        t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), {"c_acctbal": 0.7, "c_nationkey": 0.3}
    ).select("c_custkey", "score", "band")


@query("f22_multi_window_totals", """WITH o AS (SELECT o_orderstatus, cast(o_totalprice as decimal(18,2)) AS v,
 date_diff('day', cast(o_orderdate as date), (SELECT cast(max(o_orderdate) as date) FROM orders)) AS age FROM orders)
 SELECT o_orderstatus, cast(coalesce(sum(v) FILTER (age<7),0) as double) AS week,
 cast(coalesce(sum(v) FILTER (age<30),0) as double) AS month,
 cast(coalesce(sum(v) FILTER (age<365),0) as double) AS year, cast(sum(v) as double) AS all_time FROM o GROUP BY 1""")
def _(t):
    return S.multi_window_totals(
        t.orders, "o_orderdate", "o_totalprice", "o_orderstatus", {"week": 7, "month": 30, "year": 365})


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("f23_crosstab", "SELECT o_orderstatus, " + ", ".join(
    f"count(*) FILTER (o_orderpriority='{p}') AS n_{n}, "
    f"R4(count(*) FILTER (o_orderpriority='{p}')/count(*)) AS share_{n}"
    for p in PRIORITIES for n in [p.lower().replace(" ", "_").replace("-", "_")])
    + " FROM orders GROUP BY 1")
def _(t):
    return S.crosstab(t.orders, "o_orderstatus", "o_orderpriority", PRIORITIES)


@query("f24_multi_level_totals", """SELECT coalesce(l_returnflag,'*') AS l_returnflag,
 coalesce(l_linestatus,'*') AS l_linestatus, count(*) AS items, R4(sum(cast(l_quantity as decimal(18,2)))) AS quantity,
 cast(grouping(l_returnflag,l_linestatus) as bigint) AS level FROM lineitem
 GROUP BY CUBE (lineitem.l_returnflag,lineitem.l_linestatus)""")
def _(t):
    totals = S.multi_level_totals(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        [F.count("*").alias("items"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity")],
    )
    return totals.fillna("*", ["l_returnflag", "l_linestatus"])


@query("f25_demand_forecast", """WITH s AS (SELECT o_orderpriority, year(o_orderdate)*12+month(o_orderdate) AS m,
 count(*) AS n FROM orders GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m DESC) AS rn FROM s)
 SELECT o_orderpriority, max(m)+1 AS month_no, R4(regr_slope(n,m)) AS slope,
 R4(avg(n)+regr_slope(n,m)*(max(m)+1-avg(m))) AS expected, R4(avg(n) FILTER (rn<=3)) AS moving_mean
 FROM r GROUP BY 1""")
def _(t):
    series = S.monthly_counts(t.orders, "o_orderpriority", "o_orderdate")
    return S.demand_forecast(series, "o_orderpriority", "m", "n")


def _trend(now):
    return f"""WITH c AS (SELECT user_id,
 count(*) FILTER (date_diff('day',cast(ts as date),cast({now} as date))<7) AS recent,
 count(*) FILTER (date_diff('day',cast(ts as date),cast({now} as date)) BETWEEN 7 AND 27) AS base
 FROM events WHERE ts<={now} GROUP BY 1)
 SELECT user_id, recent, base, R4(score) AS score FROM (SELECT *, ((recent+1)/7.0::double)/((base+1)/21.0::double) AS score FROM c)
 ORDER BY round(score,9) DESC, user_id LIMIT 25"""


@query("f26_trending_score", _trend("(SELECT max(ts) FROM events)"))
def _(t):
    return S.trending_top(t.events, "user_id", "ts", 25)


@query("f27_trending_as_of", _trend("timestamp '2024-01-20 00:00:00'"))
def _(t):
    return S.trending_top(t.events, "user_id", "ts", 25, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("f28_sample_draw", """SELECT c_custkey, c_name, md5(concat(cast(c_custkey as varchar),'s1')) AS draw
 FROM customer ORDER BY 3, 1 LIMIT 50""")
def _(t):
    return S.sample_draw(t.customer.select("c_custkey", "c_name"), "c_custkey", 50, "s1")


@query("f29_profile_summary", """SELECT c_custkey, c_name, coalesce(acts,0) AS acts, total, mean_value, min_value,
 max_value, first_day, last_day, coalesce(years,0) AS years FROM customer LEFT JOIN (
 SELECT o_custkey, count(*) AS acts, R4(sum(cast(o_totalprice as decimal(18,2)))) AS total,
 R4(avg(o_totalprice)) AS mean_value, R4(min(o_totalprice)) AS min_value, R4(max(o_totalprice)) AS max_value,
 cast(cast(min(o_orderdate) as date) as varchar) AS first_day, cast(cast(max(o_orderdate) as date) as varchar) AS last_day,
 count(distinct year(o_orderdate)) AS years FROM orders GROUP BY 1) ON c_custkey=o_custkey""")
def _(t):
    acts = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return S.profile_summary(t.customer.select("c_custkey", "c_name"), acts, "c_custkey", "o_orderdate", "o_totalprice")


@query("f30_distribution_bands", """SELECT c_custkey, R4(c_acctbal) AS c_acctbal, rank() OVER w AS rank,
 R4(percent_rank() OVER w) AS percent_rank,
 cast(floor((rank() OVER w-1)*10/count(*) OVER ()) as bigint)+1 AS tile FROM customer
 WINDOW w AS (ORDER BY customer.c_acctbal)""")
def _(t):
    return S.distribution_bands(t.customer, "c_custkey", "c_acctbal")


@query("f30_quantiles", """SELECT c_mktsegment, R4(quantile_cont(c_acctbal,0.25)) AS p25,
 R4(quantile_cont(c_acctbal,0.5)) AS p50, R4(quantile_cont(c_acctbal,0.9)) AS p90 FROM customer GROUP BY 1""")
def _(t):
    return S.quantile_report(t.customer, "c_mktsegment", "c_acctbal", {"p25": 0.25, "p50": 0.5, "p90": 0.9})


@query("f31_approx_reach")
def _(t):
    return S.approx_reach(t.events, "event_type", "user_id")


@query("f31_merged_sketches", """SELECT event_type, count(*) AS acts, count(value) AS n_values, count(distinct user_id) AS exact,
 true AS reach_in_bound, true AS median_in_bound FROM events WHERE cast(ts as date)>(SELECT min(cast(ts as date)) FROM events) GROUP BY 1""")
def _(t):
    path = W.scratch_folder(t.spark)
    S.day_sketches(t.events, ["event_type"], "ts", "user_id", "value").write.parquet(path)
    stored = t.spark.read.parquet(path)
    from_day = stored.agg(F.date_add(F.min("day"), 1)).scalar()
    late = t.events.where(F.to_date("ts") >= from_day)
    bounds = S.quantile_report(late, "event_type", "value", {"low": 0.48, "high": 0.52})
    exact = late.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    whole = S.merged_sketches(stored.where(F.col("day") >= from_day), ["event_type"])
    return whole.join(exact, "event_type").join(bounds, "event_type").select(
        "event_type", "acts", "n_values", "exact",
        (F.abs(F.col("reach") - F.col("exact")) <= F.col("exact") * 5 * 1.04 / 128).alias("reach_in_bound"),
        F.col("p50").between(F.col("low"), F.col("high")).alias("median_in_bound"))


@query("f32_list_copy", """SELECT item, min(label) AS label, count(*) AS listed FROM (
 SELECT c_custkey AS item, c_name AS label FROM customer WHERE c_acctbal>5000
 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey<12) GROUP BY 1""")
def _(t):
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("label"))
    near = t.customer.where("c_nationkey < 12").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("label"))
    return S.list_copy([rich, near], "item", ["label"])

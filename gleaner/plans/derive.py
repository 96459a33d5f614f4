"""Derived inputs: the same SQL text runs on Spark and on the checking engine."""

VIEWS = {
    "v_geo": """SELECT c_custkey AS id, cast((c_custkey*37)%18000 AS double)/100-90 AS lat,
        cast((c_custkey*91)%36000 AS double)/100-180 AS lon FROM customer""",
    "v_moves": """SELECT user_id AS mover, ts, event_id,
        cast((user_id*53)%120 AS double)-60+value/1000 AS lat,
        cast((user_id*71)%300 AS double)-150+value/500 AS lon FROM events""",
    "v_hops": """SELECT page_id AS src, cast(floor(page_id/2) AS bigint) AS dst
        FROM pages WHERE page_id>0""",
    "v_captures": """SELECT page_id, url, date '2024-01-01' + cast(page_id%30 AS int) AS captured_on,
        md5(html) AS digest FROM pages
        UNION ALL SELECT page_id, url, date '2024-01-01' + cast(page_id%30+30 AS int),
        md5(concat(html, CASE WHEN page_id%3<1 THEN '1' ELSE '' END)) FROM pages
        UNION ALL SELECT page_id, url, date '2024-01-01' + cast(page_id%30+60 AS int),
        md5(concat(html, CASE WHEN page_id%3<2 THEN '2' ELSE '' END)) FROM pages""",
    "v_edges": """SELECT DISTINCT l.l_suppkey AS a, o.o_custkey AS b
        FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey""",
    "v_follows": """SELECT DISTINCT user_id AS follower, cast(floor(value) AS bigint)%150 AS followed
        FROM events WHERE user_id <> cast(floor(value) AS bigint)%150""",
    "v_dns": """SELECT concat('h', cast(user_id%40 AS varchar(20))) AS host,
        cast(floor(value) AS bigint)%16 AS ip_id, ts, event_id FROM events""",
    "v_shares": """SELECT s_suppkey AS child, cast(floor(s_suppkey/3) AS bigint) AS owner,
        0.25+cast(s_suppkey%4 AS double)/10 AS share FROM supplier WHERE s_suppkey>0
        UNION ALL SELECT s_suppkey, cast(floor(s_suppkey/5) AS bigint),
        cast(0.1 AS double) FROM supplier
        WHERE s_suppkey>10 AND floor(s_suppkey/5) <> floor(s_suppkey/3)""",
    "v_nets": """SELECT n_name AS net, cast(n_nationkey AS bigint)*171798691 AS lo,
        (cast(n_nationkey AS bigint)+1)*171798691-1 AS hi, 1 AS depth FROM nation
        UNION ALL SELECT concat(n_name, '/sub'), cast(n_nationkey AS bigint)*171798691+50000000,
        cast(n_nationkey AS bigint)*171798691+99999999, 2 FROM nation""",
    "v_expiry": """SELECT page_id, url, date '2024-01-01' + cast(page_id%60 AS int) AS expires_on
        FROM pages""",
    "v_thread": """SELECT conv_id, turn,
        CASE WHEN turn>0 THEN cast(floor((turn-1)/2) AS bigint) END AS parent FROM conversations""",
    "v_status": """SELECT url, page_id%7 AS day,
        CASE WHEN page_id%5=0 THEN 404 WHEN page_id%7=0 THEN 500 ELSE 200 END AS status FROM pages
        UNION ALL SELECT url, page_id%7+1 AS day,
        CASE WHEN page_id%4=0 THEN 404 ELSE 200 END AS status FROM pages WHERE page_id%3=0""",
    "v_zone": """SELECT n_name AS zone, 1 AS i, cast(n_nationkey AS double)*6-80 AS lat, cast(n_nationkey AS double)*13-170 AS lon FROM nation
        UNION ALL SELECT n_name, 2, cast(n_nationkey AS double)*6-80, cast(n_nationkey AS double)*13-120 FROM nation
        UNION ALL SELECT n_name, 3, cast(n_nationkey AS double)*6-45, cast(n_nationkey AS double)*13-110 FROM nation
        UNION ALL SELECT n_name, 4, cast(n_nationkey AS double)*6-60, cast(n_nationkey AS double)*13-140 FROM nation
        UNION ALL SELECT n_name, 5, cast(n_nationkey AS double)*6-40, cast(n_nationkey AS double)*13-170 FROM nation""",
    "v_plot": """SELECT c_custkey AS plot, c_mktsegment AS kind, 1 AS i, cast((c_custkey*37)%16000 AS double)/100-80 AS lat, cast((c_custkey*91)%35000 AS double)/100-175 AS lon FROM customer
        UNION ALL SELECT c_custkey, c_mktsegment, 2, cast((c_custkey*37)%16000 AS double)/100-80, cast((c_custkey*91)%35000 AS double)/100-174.5 FROM customer
        UNION ALL SELECT c_custkey, c_mktsegment, 3, cast((c_custkey*37)%16000 AS double)/100-79.25, cast((c_custkey*91)%35000 AS double)/100-174 FROM customer
        UNION ALL SELECT c_custkey, c_mktsegment, 4, cast((c_custkey*37)%16000 AS double)/100-79, cast((c_custkey*91)%35000 AS double)/100-175 FROM customer""",
    "v_poi": """SELECT s_suppkey AS poi, concat('type', cast(s_nationkey%3 AS varchar(9))) AS kind,
        cast((s_suppkey*1171)%18000 AS double)/100-90 AS plat, cast((s_suppkey*2377)%36000 AS double)/100-180 AS plon FROM supplier""",
    "v_visits": """SELECT event_id, user_id, event_type AS site, ts, value,
        cast(ts AS date) AS day FROM events""",
}

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

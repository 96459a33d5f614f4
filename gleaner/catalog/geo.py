"""Geospatial and movement: catalogue entries with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.catalog.graph import PATHS
from gleaner.functions.geocols import EARTH_KM
from gleaner.operators import geo as E


def hav(a, b, c, d):
    return (f"2*{EARTH_KM}::double*asin(sqrt(least(1.0::double, sin((radians({c})-radians({a}))/2)*sin((radians({c})-radians({a}))/2)"
            f"+cos(radians({a}))*cos(radians({c}))*sin((radians({d})-radians({b}))/2)*sin((radians({d})-radians({b}))/2))))")


@query("e01_haversine_distance", f"SELECT id, R4({hav('lat', 'lon', 'lon/3', 'lat*1.5::double')}) AS km FROM v_geo")
def _(t):
    return E.haversine_distance(t.v_geo, "lat", "lon", F.col("lon") / 3, F.col("lat") * 1.5).select("id", "km")


@query("e02_within_radius", f"SELECT id, R4(km) AS km FROM (SELECT id, {hav('lat', 'lon', '10.0::double', '20.0::double')} AS km FROM v_geo) WHERE km<=2500")
def _(t):
    return E.within_radius(t.v_geo, 10.0, 20.0, 2500.0).select("id", "km")


@query("e03_within_bbox", "SELECT id FROM v_geo WHERE lat BETWEEN -20 AND 30 AND (lon>=150 OR lon<=-120)")
def _(t):
    return E.within_bbox(t.v_geo, -20, 150, 30, -120).select("id")


EASTWARD = "(CASE WHEN abs({b}-{a})>180 THEN {b}-{a}-360*sign({b}-{a}) ELSE {b}-{a} END)"


@query("e04_points_in_polygons", f"""WITH d AS (SELECT *, lag(lon) OVER w AS was, first_value(lon) OVER w AS f FROM v_zone WINDOW w AS (PARTITION BY zone ORDER BY i)),
 u AS (SELECT zone, i, lat, lon+360*sum(CASE WHEN lon-was<-180 THEN 1 WHEN lon-was>180 THEN -1 ELSE 0 END) OVER (PARTITION BY zone ORDER BY i) AS lon FROM d),
 s AS (SELECT a.zone, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM u a JOIN u b ON a.zone=b.zone AND b.i=a.i%5+1)
 SELECT DISTINCT id, zone FROM (SELECT p.id, s.zone, k, count(*) FILTER ((y1>lat)<>(y2>lat) AND lon+k<(x2-x1)*(lat-y1)/nullif(y2-y1,0)+x1) AS n
 FROM v_geo p, s, (VALUES (-720), (-360), (0), (360), (720)) t(k) GROUP BY 1,2,3) WHERE n%2=1""")
def _(t):
    return E.points_in_polygons(t.v_geo, E.rings(t.v_zone, ["zone"]), "zone").select("id", "zone")


RING = f"""m AS (SELECT a.plot, a.kind, abs(sum(radians({EASTWARD.format(a='a.lon', b='b.lon')})*(sin(radians(a.lat))+sin(radians(b.lat)))/2))*{EARTH_KM}::double*{EARTH_KM}::double AS km2,
 sum({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS km FROM v_plot a JOIN v_plot b ON a.plot=b.plot AND b.i=a.i%4+1 GROUP BY 1,2)"""


def _plots(t):
    return E.polygon_measures(E.rings(t.v_plot, ["plot", "kind"]))


@query("e05_polygon_measures", f"WITH {RING} SELECT plot, R4(km2) AS km2, R4(km) AS km FROM m")
def _(t):
    return _plots(t).select("plot", "km2", "km")


@query("e06_compare_areas", f"""WITH {RING} SELECT a.plot AS a, b.plot AS b, R4(a.km2/b.km2) AS ratio FROM m a JOIN m b ON b.plot=a.plot+1""")
def _(t):
    pairs = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return E.compare_areas(_plots(t), pairs, "plot", "a", "b").select("a", "b", "ratio")


@query("e07_grid_density", """SELECT cast(floor(lat/10) as bigint) AS ci, cast(floor(lon/10) as bigint) AS cj, count(*) AS n, R4(avg(id)) AS mean_value FROM v_geo GROUP BY 1,2""")
def _(t):
    return E.grid_density(t.v_geo, 10.0, "id")


@query("e08_nearest_poi", f"""SELECT id, kind, poi, R4(km) AS km, position FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY round(km,6), poi) AS position
 FROM (SELECT id, kind, poi, {hav('lat', 'lon', 'plat', 'plon')} AS km FROM v_geo, v_poi)) WHERE position<=2""")
def _(t):
    return E.nearest_poi(t.v_geo, "id", t.v_poi, "poi", "kind", 2)


SPANS = {"day": 1, "week": 7, "month": 30, "half_year": 182}


@query("e09_events_per_region", "WITH c AS (SELECT user_id%25 AS k, date_diff('day',cast(ts as date),(SELECT cast(max(ts) as date) FROM events)) AS age FROM events) SELECT n_name, "
       + ", ".join(f"count(*) FILTER (age<{d}) AS {n}" for n, d in SPANS.items()) + " FROM nation LEFT JOIN c ON k=n_nationkey GROUP BY 1")
def _(t):
    ev = t.events.withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    return E.events_per_region(ev, t.nation, "n_nationkey", "n_name", "ts", SPANS)


SEG = f"""g AS (SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS km, epoch(ts)-epoch(pts) AS seconds FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
 lag(ts) OVER w AS pts FROM v_moves WINDOW w AS (PARTITION BY mover ORDER BY ts, event_id)) WHERE pts IS NOT NULL)"""


@query("e10_trajectory_segments", f"WITH {SEG} SELECT mover, event_id, R4(km) AS km, R4(seconds) AS seconds FROM g")
def _(t):
    return E.trajectory_segments(t.v_moves, "mover", ["ts", "event_id"]).select("mover", "event_id", "km", "seconds")


@query("e10_trip_totals", f"""WITH {SEG} SELECT mover, cast(cast(ts as date) as varchar) AS day, count(*) AS legs, R4(sum(km)) AS km, R4(sum(seconds)) AS seconds
 FROM g GROUP BY mover, cast(ts as date)""")
def _(t):
    return E.trip_totals(E.trajectory_segments(t.v_moves, "mover", ["ts", "event_id"]), "mover", "ts")


@query("e11_route_totals", f"""WITH w AS (SELECT m.*, e.value AS h, lag(m.lat) OVER w AS plat, lag(m.lon) OVER w AS plon, lag(e.value) OVER w AS ph
 FROM v_moves m JOIN events e USING (event_id) WINDOW w AS (PARTITION BY mover ORDER BY m.ts, event_id))
 SELECT mover, count(*) AS points, R4(sum({hav('plat', 'plon', 'lat', 'lon')})) AS km, R4(sum(CASE WHEN h>ph THEN h-ph ELSE 0 END)) AS ascent FROM w GROUP BY 1""")
def _(t):
    moves = t.sql("""SELECT user_id AS mover, ts, event_id, value AS height, cast((user_id*53)%120 AS double)-60+value/1000 AS lat,
        cast((user_id*71)%300 AS double)-150+value/500 AS lon FROM events""")
    return E.route_totals(moves, "mover", ["ts", "event_id"], "height")


@query("e12_port_eta", f"""WITH RECURSIVE {PATHS.format(limit=20)} SELECT node, cast(cost*100 as double) AS miles, legs, k AS knots, R4(cost*100/cast(k as double)) AS hours
 FROM m, (SELECT unnest([5,10,20,40]) AS k) WHERE node<>1""")
def _(t):
    legs = t.v_follows.withColumn("miles", (1 + (F.col("follower") + F.col("followed")) % 9) * 100)
    return E.port_eta(legs, "follower", "followed", "miles", 1, [5, 10, 20, 40])


@query("e13_reachable_within", f"""WITH RECURSIVE {PATHS.format(limit=3)} SELECT node, cast(cost as double) AS minutes FROM m""")
def _(t):
    edges = t.v_follows.withColumn("minutes", 1 + (F.col("follower") + F.col("followed")) % 9)
    return E.reachable_within(edges, "follower", "followed", "minutes", 1, 3.0)


@query("e14_direct_connections", """SELECT DISTINCT c_nationkey AS target FROM lineitem JOIN orders ON l_orderkey=o_orderkey
 JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE s_nationkey=7""")
def _(t):
    lanes = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target")), "o_custkey"))
    return E.direct_connections(lanes, "s_nationkey", "target", 7)


DENSITY = {"BUILDING": 2.5, "AUTOMOBILE": 0.5, "MACHINERY": 1.0}


@query("e15_crowd_estimate", f"""WITH {RING} SELECT plot, kind, cast(floor(km2*CASE kind WHEN 'BUILDING' THEN 2.5::double WHEN 'AUTOMOBILE' THEN 0.5::double
 WHEN 'MACHINERY' THEN 1.0::double ELSE 0.0::double END) as bigint) AS people FROM m""")
def _(t):
    return E.crowd_estimate(_plots(t), "kind", DENSITY).select("plot", "kind", "people")


@query("e16_coverage_rate", """SELECT coalesce(c_mktsegment,'*') AS c_mktsegment, coalesce(c_nationkey,-1) AS c_nationkey, count(*) AS samples,
 R4(avg(cast(c_acctbal>2000 as int))) AS rate, grouping(customer.c_mktsegment, customer.c_nationkey) AS level FROM customer
 GROUP BY ROLLUP (customer.c_mktsegment, customer.c_nationkey)""")
def _(t):
    r = E.coverage_rate(t.customer, ["c_mktsegment", "c_nationkey"], F.col("c_acctbal") > 2000)
    return r.fillna("*", ["c_mktsegment"]).fillna(-1, ["c_nationkey"])


@query("e17_country_scores", """WITH f AS (SELECT n_name, avg(c_acctbal) AS balance, count(*) AS customers FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1),
 p AS (SELECT n_name, 'balance' AS indicator, balance AS v FROM f UNION ALL SELECT n_name, 'customers', customers FROM f)
 SELECT n_name, indicator, R4(1+99*(v-min(v) OVER w)/(max(v) OVER w-min(v) OVER w)) AS score, rank() OVER (PARTITION BY indicator ORDER BY v DESC) AS rank
 FROM p WINDOW w AS (PARTITION BY indicator)""")
def _(t):
    facts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.avg("c_acctbal").alias("balance"), F.count("*").alias("customers"))
    return E.country_scores(facts, "n_name", ["balance", "customers"])


@query("e18_union_geo_sources", """SELECT 'buyers' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS kind FROM customer
 UNION ALL SELECT 'makers', s_suppkey, s_name, NULL FROM supplier""")
def _(t):
    return E.union_geo_sources({
        "buyers": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind")),
        "makers": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))})


@query("e19_latest_position", """SELECT mover, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS ts, max_by(event_id, ts) AS event_id, R4(max_by(lat, ts)) AS lat,
 R4(max_by(lon, ts)) AS lon FROM v_moves GROUP BY 1""")
def _(t):
    return E.latest_position(t.v_moves, "mover", ["ts", "event_id"], ["lat", "lon"])


def _trips(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.date_add(F.to_date("o_orderdate"), 60).alias("planned"))
    return t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate").join(o, "l_orderkey")


@query("e20_on_time_performance", """WITH d AS (SELECT o_orderpriority, cast(date_diff('day', cast(o_orderdate as date)+60, cast(l_shipdate as date)) as double) AS d
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
 SELECT o_orderpriority, count(*) AS trips, R4(avg(cast(d<=0 as int))) AS on_time, R4(avg(d)) AS mean_delay, R4(quantile_cont(d,0.5)) AS p50,
 R4(quantile_cont(d,0.9)) AS p90 FROM d GROUP BY 1""")
def _(t):
    return E.on_time_performance(_trips(t), ["o_orderpriority"], "planned", "l_shipdate")


@query("e20_on_time_by_station_day", """WITH d AS (SELECT l_suppkey, cast(o_orderdate as date)+60 AS planned,
 cast(date_diff('day', cast(o_orderdate as date)+60, cast(l_shipdate as date)) as double) AS d FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
 SELECT l_suppkey, strftime(planned,'%Y-%m-%d') AS planned, count(*) AS trips, R4(avg(cast(d<=0 as int))) AS on_time, R4(avg(d)) AS mean_delay,
 R4(quantile_cont(d,0.5)) AS p50, R4(quantile_cont(d,0.9)) AS p90 FROM d GROUP BY 1,2""")
def _(t):
    return E.on_time_performance(_trips(t), ["l_suppkey", "planned"], "planned", "l_shipdate")


def _reports(t):
    return t.lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("day"), "l_linenumber", "l_linestatus")


@query("e21_shipment_status", """SELECT l_orderkey, arg_max(l_linestatus, strftime(l_shipdate,'%Y%m%d')||'-'||cast(l_linenumber as varchar)||'-'||l_linestatus) AS state,
 cast(cast(min(l_shipdate) as date) as varchar) AS first_at, cast(cast(max(l_shipdate) as date) as varchar) AS last_at, count(*) AS reports FROM lineitem GROUP BY 1""")
def _(t):
    return E.shipment_status(_reports(t), "l_orderkey", ["day", "l_linenumber", "l_linestatus"], "l_linestatus")


@query("e21_shipment_history", """WITH c AS (SELECT l_orderkey, l_linestatus, cast(l_shipdate as date) AS day, l_linenumber,
 CASE WHEN lag(l_linestatus) OVER w = l_linestatus THEN 0 ELSE 1 END AS ch FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY cast(l_shipdate as date), l_linenumber, l_linestatus)),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY l_orderkey ORDER BY day, l_linenumber, l_linestatus) AS run FROM c)
 SELECT l_orderkey, l_linestatus, cast(min(day) as varchar) AS first_at, cast(max(day) as varchar) AS last_at, count(*) AS reports
 FROM r GROUP BY l_orderkey, l_linestatus, run""")
def _(t):
    return E.shipment_history(_reports(t), "l_orderkey", ["day", "l_linenumber", "l_linestatus"], "l_linestatus")


@query("e22_weather_statistics", """SELECT event_type, cast(cast(ts as date) as varchar) AS period, R4(min(value)) AS low, R4(max(value)) AS high, R4(avg(value)) AS mean_value,
 R4(quantile_cont(value,0.9)) AS p90 FROM events GROUP BY event_type, cast(ts as date)""")
def _(t):
    return E.weather_statistics(t.events, "event_type", "ts", "value", "day")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("e23_recent_hazards", "SELECT user_id%10 AS place, count(*) AS events, " + ", ".join(f"count(*) FILTER (event_type='{k}') AS n_{k}" for k in KINDS)
       + " FROM events WHERE ts >= (SELECT max(ts) FROM events) - interval 48 hour GROUP BY 1")
def _(t):
    return E.recent_hazards(t.events, F.col("user_id") % 10, "event_type", KINDS, "ts", 48)


@query("e24_place_time_search", """SELECT event_id, mover FROM v_moves WHERE lat BETWEEN -40 AND 20 AND lon BETWEEN -100 AND 60
 AND ts>=timestamp '2024-01-05' AND ts<timestamp '2024-01-12'""")
def _(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return E.place_time_search(t.v_moves, (-40, -100, 20, 60), "ts", day("2024-01-05"), day("2024-01-12")).select("event_id", "mover")


@query("e25_year_over_year", """WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS year, sum(cast(o_totalprice as decimal(18,2))) AS total FROM orders GROUP BY 1,2)
 SELECT a.o_orderpriority, a.year, R4(a.total) AS total, R4(b.total) AS before, R4(cast(a.total-b.total as double)*100/cast(b.total as double)) AS change_pct
 FROM y a JOIN y b ON a.o_orderpriority=b.o_orderpriority AND a.year=b.year+1""")
def _(t):
    return E.year_over_year(t.orders, "o_orderpriority", "o_orderdate", "o_totalprice")

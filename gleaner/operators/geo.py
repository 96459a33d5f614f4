"""Points, areas and movement."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import geocols as X
from gleaner.functions.rows import each, pin
from gleaner.operators.graph import shortest_paths
from gleaner.operators.stats import epoch_seconds, latest
from gleaner.operators.web import dns_history
from gleaner.plans.scale import cut_lineage, exact_quantiles, lag_within, sized_chunks, top_k_per_group


def haversine_distance(df: DataFrame, lat1: str, lon1: str, lat2: Column, lon2: Column) -> DataFrame:
    """Add ``km``, the great-circle distance of two points."""
    return df.withColumn("km", X.haversine_km(F.col(lat1), F.col(lon1), lat2, lon2))


def within_radius(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Points inside a circle, with distance; a latitude band is cut off at the scan first."""
    band = km / X.DEGREE_KM + 0.01
    near = points.where(F.col("lat").between(lat - band, lat + band))
    return haversine_distance(near, "lat", "lon", F.lit(lat), F.lit(lon)).where(F.col("km") <= km)


def within_bbox(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Points inside a rectangle; one that crosses the date line has west over east."""
    lat_ok = F.col("lat").between(south, north)
    if west <= east:
        return points.where(lat_ok & F.col("lon").between(west, east))
    return points.where(lat_ok & ((F.col("lon") >= west) | (F.col("lon") <= east)))


def rings(vertices: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Vertex rows as one ring value per polygon."""
    v = F.array_sort(F.collect_list(F.struct(order, "lat", "lon")))
    return vertices.groupBy(*keys).agg(
        F.transform(v, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("ring"))


def points_in_polygons(points: DataFrame, polys: DataFrame, name: str, cell: float = 10.0) -> DataFrame:
    """Join points to the areas that hold them: equal grid cells first, then ray casting.

    Edges go the short way round, so a ring may cross the date line; ``cell`` has to divide 360. The
    inside of a ring is what it holds with its last vertex joined straight to its first; a ring around
    a pole does not close that way and has to name the pole's latitude among its vertices. Points and
    rings without a position match nothing.
    """
    columns = round(360 / cell)
    if abs(columns * cell - 360) > 1e-9:
        raise ValueError("cell has to divide 360")
    turned = pin(polys, [name, "ring"], _turns=X.date_line_turns(F.col("ring")))
    flat = pin(turned, [name], ring=X.unrolled(F.col("ring"), F.col("_turns")))
    lats, lons = F.col("ring.lat"), F.col("ring.lon")
    def span(c: Column) -> Column:
        return F.sequence(X.cell(F.array_min(c), cell), X.cell(F.array_max(c), cell))
    cover = (
        flat.select(name, "ring", F.array_min(lons).alias("_west"), F.array_max(lons).alias("_east"),
                    F.explode(span(lats)).alias("_ci"))
        .withColumn("_cj", F.explode(F.array_distinct(F.transform(span(F.col("ring.lon")), lambda j: F.pmod(j, F.lit(columns))))))
    )
    placed = points.withColumn("_ci", X.cell(F.col("lat"), cell)).withColumn(
        "_cj", F.pmod(X.cell(F.col("lon"), cell), F.lit(columns)))
    # the first turn of the globe on which the point is not west of the ring
    lon = F.col("lon") + 360 * F.ceil((F.col("_west") - F.col("lon")) / 360)
    again = (F.col("_east") - F.col("_west") > 360) & X.inside_ring(F.col("lat"), lon + 360, F.col("ring"))
    return (
        placed.join(cover, ["_ci", "_cj"])
        .where(X.inside_ring(F.col("lat"), lon, F.col("ring")) | again)
        .drop("_ci", "_cj", "ring", "_west", "_east")
    )


def polygon_measures(polys: DataFrame) -> DataFrame:
    """Area in square km and perimeter in km."""
    return polys.withColumn("km2", X.ring_area_km2(F.col("ring"))).withColumn("km", X.ring_length_km(F.col("ring")))


def compare_areas(areas: DataFrame, pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Area ratio of the asked pairs of territories."""
    left = areas.select(F.col(key).alias(a), F.col("km2").alias("km2_a"))
    right = areas.select(F.col(key).alias(b), F.col("km2").alias("km2_b"))
    return pairs.join(left, a).join(right, b).withColumn("ratio", F.col("km2_a") / F.col("km2_b"))


def grid_density(points: DataFrame, cell: float, value: str) -> DataFrame:
    """Count and mean of a measure per grid cell."""
    return points.groupBy(X.cell(F.col("lat"), cell).alias("ci"), X.cell(F.col("lon"), cell).alias("cj")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_value"))


# Halvings of the cube edge that are looked at: 2 down to 2e-6, about ten metres.
FINEST = 20
#: Places in one list of a cube.
LISTED = 2048


def nearest_poi(points: DataFrame, key: str, pois: DataFrame, poi: str, kind: str, k: int,
                crowd: int = 64) -> DataFrame:
    """The ``k`` nearest places of each kind for every point, exactly.

    Points and places are put on the unit sphere and into cubes. The cube edge
    starts so small that no cube holds more than ``crowd`` places at different
    spots and doubles each round. A (point, kind) is settled once its k-th place
    lies within one cube edge, since nothing outside the 27 cubes around can be
    nearer; only the rest goes on. Points in crowded areas settle among few
    candidates and sparse ones widen their search. Of the places of a kind at one
    spot only the first ``k`` can be asked for. Places wait in lists of a bounded
    length in every cube that sees them; a point takes its best ``k`` of each list
    within its row, so that only those are shuffled and ordered.
    """
    xyz = ["_x", "_y", "_z"]
    cells = [f"_c{c}" for c in xyz]

    def on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
        for n, c in zip(xyz, X.unit_vector(F.col(lat), F.col(lon))):
            df = df.withColumn(n, c)
        return df

    def chord2(x: Column) -> Column:
        d = [x[c] - F.col(c) for c in xyz]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    pois = pois.select(poi, kind, "plat", "plon")
    per_kind = cut_lineage(pois.groupBy(kind).agg(F.least(F.count("*"), F.lit(k)).alias("_need")))
    firsts = top_k_per_group(pois.where("plat IS NOT NULL AND plon IS NOT NULL"), [kind, "plat", "plon"], [F.asc(poi)], k)
    place = cut_lineage(on_sphere(firsts.drop("position"), "plat", "plon"))
    # how crowded the fullest cube is at every edge from 2 down, in one pass
    levels = (
        place.select("plat", "plon", *xyz).distinct()
        .select(F.explode(F.sequence(F.lit(0), F.lit(FINEST))).alias("_l"), *xyz)
        .groupBy("_l", *[F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("_l") - 1)).alias(f"_c{c}") for c in xyz])
        .agg(F.count("*").alias("n")).groupBy("_l").agg(F.max("n").alias("n")))
    fullest = {r["_l"]: r["n"] for r in levels.collect()}  # one row per level
    edge = 2.0 / 2 ** next((l for l in range(FINEST) if fullest.get(l, 0) <= crowd), FINEST)
    todo = on_sphere(points.select(key, "lat", "lon"), "lat", "lon").select(
        "*", F.explode(per_kind.agg(F.collect_set(kind)).scalar()).alias(kind))
    todo = cut_lineage(todo)
    out = []
    while True:
        asked = todo.select("*", *[F.floor(F.col(c) / edge).alias(f"_c{c}") for c in xyz])
        # places go to the cubes around their own, so that a point meets them all in its own cube, as lists
        around = place
        for c in xyz:
            mid = F.floor(F.col(c) / edge)
            around = around.withColumn(f"_c{c}", F.explode(F.array(mid - 1, mid, mid + 1)))
        around = around.join(asked.select(kind, *cells).distinct(), [kind, *cells], "left_semi")
        lists = around.groupBy(kind, *cells).agg(F.ceil(F.count("*") / LISTED).alias("_lists"))
        lists = around.join(lists, [kind, *cells]).groupBy(
            kind, *cells, F.pmod(F.xxhash64(poi, "plat", "plon"), "_lists").alias("_list")).agg(
            F.collect_list(F.struct(poi, "plat", "plon", *xyz)).alias("_near"))
        met = asked.join(lists, [kind, *cells])
        # whatever may tie with the k-th chord at the six places that order kilometres goes on to the exact distance
        kth = F.element_at(F.sort_array(F.transform("_near", chord2)), F.least(F.lit(k), F.size("_near")))
        base = [key, kind, "lat", "lon", *xyz, "_near"]
        met = pin(met, base, _kth=kth)
        met = pin(met, base, _most=F.col("_kth") + 1e-9 * F.sqrt("_kth") + 1e-18)

        def exact(p: Column) -> Column:
            km = X.haversine_km(F.col("lat"), F.col("lon"), p["plat"], p["plon"])
            return F.struct(F.round(km, 6).alias("r"), p[poi].alias("poi"), km.alias("km"))

        best = F.slice(F.sort_array(F.transform(F.filter("_near", lambda p: chord2(p) <= F.col("_most")), exact)), 1, k)
        near = each(met, [key, kind], best, "_b").select(key, kind, F.col("_b.poi").alias(poi), F.col("_b.km").alias("km"))
        near = cut_lineage(top_k_per_group(near, [key, kind], [F.round("km", 6), F.asc(poi)], k))
        # a chord of one edge is an arc of 2 asin(edge / 2)
        safe = 2 * math.asin(min(edge / 2, 1.0)) * X.EARTH_KM
        full = near.groupBy(key, kind).agg(F.count("*").alias("_n"), F.max("km").alias("_far"))
        if edge >= 2.0:
            settled = full.select(key, kind)
        else:
            settled = full.join(per_kind, kind).where(
                (F.col("_n") >= F.col("_need")) & (F.col("_far") < safe - 1e-6)).select(key, kind)
        settled = cut_lineage(settled)
        out.append(near.join(settled, [key, kind], "left_semi"))
        todo = cut_lineage(todo.join(settled, [key, kind], "left_anti"))
        if edge >= 2.0 or todo.isEmpty():
            return reduce(DataFrame.unionByName, out)
        edge *= 2


def events_per_region(events: DataFrame, regions: DataFrame, key: str, name: str, ts: str, spans: dict[str, int]) -> DataFrame:
    """Counts by region over several spans of days up to now, counted before the join."""
    age = F.date_diff(F.to_date(latest(events, ts)), F.to_date(ts))
    counted = events.groupBy(key).agg(*[F.count_if(age < d).alias(n) for n, d in spans.items()])
    return regions.join(counted, key, "left").groupBy(name).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in spans])


def trajectory_segments(points: DataFrame, mover: str, order: list[str]) -> DataFrame:
    """Leg distance, time and speed per mover; days, or parts of one, keep a busy mover spread out."""
    ts = order[0]
    parts = sized_chunks(points, [mover], order, F.to_date(ts))
    seq = lag_within(parts, [mover], order, ["lat", "lon", ts], F.col("_part")).drop("_part")
    seq = seq.where(F.col(f"prev_{ts}").isNotNull())
    km = X.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    sec = epoch_seconds(F.col(ts)) - epoch_seconds(F.col(f"prev_{ts}"))
    return seq.select("*", km.alias("km"), sec.alias("seconds")).withColumn(
        "kmh", F.when(F.col("seconds") > 0, F.col("km") / F.col("seconds") * 3600))


def trip_totals(segments: DataFrame, mover: str, ts: str) -> DataFrame:
    """Totals per mover and day."""
    return segments.groupBy(mover, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("legs"), F.sum("km").alias("km"), F.sum("seconds").alias("seconds"))


def route_totals(points: DataFrame, route: str, order: list[str], height: str) -> DataFrame:
    """Length and ascent per route."""
    parts = sized_chunks(points, [route], order, F.to_date(order[0]))
    seq = lag_within(parts, [route], order, ["lat", "lon", height], F.col("_part"))
    km = X.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    up = F.greatest(F.col(height) - F.col(f"prev_{height}"), F.lit(0.0))
    return seq.groupBy(route).agg(
        F.count("*").alias("points"), F.sum(km).alias("km"), F.sum(up).alias("ascent"))


def port_eta(legs: DataFrame, a: str, b: str, miles: str, start, knots: list[int]) -> DataFrame:
    """Travel hours of the best sea route to each port for each speed, and legs passed."""
    best = shortest_paths(legs, a, b, start, miles)
    speeds = F.explode(F.array(*[F.lit(x) for x in knots])).alias("knots")
    return best.where(F.col("node") != start).select(
        "node", F.col("cost").alias("miles"), "legs", speeds).withColumn("hours", F.col("miles") / F.col("knots"))


def reachable_within(edges: DataFrame, a: str, b: str, minutes: str, start, limit: float) -> DataFrame:
    """Stops reachable from ``start`` within ``limit`` minutes."""
    return shortest_paths(edges, a, b, start, minutes, limit).select("node", F.col("cost").alias("minutes"))


def direct_connections(edges: DataFrame, origin: str, target: str, hub) -> DataFrame:
    """Places with a direct service from a hub."""
    return edges.where(F.col(origin) == hub).select(target).distinct()


def crowd_estimate(areas: DataFrame, kind: str, density: dict[str, float]) -> DataFrame:
    """People for an area and a density class, in people per square km."""
    per = reduce(lambda acc, kv: acc.when(F.col(kind) == kv[0], F.lit(kv[1])), density.items(),
                 F.when(F.lit(False), F.lit(0.0))).otherwise(0.0)
    return areas.withColumn("people", F.floor(F.col("km2") * per))


def coverage_rate(samples: DataFrame, dims: list[str], covered: Column) -> DataFrame:
    """Share of covered samples for every level of the dimensions, from coarse to fine."""
    return samples.withColumn("_c", covered.cast("int")).rollup(*dims).agg(
        F.count("*").alias("samples"), F.avg("_c").alias("rate"), F.grouping_id(*dims).alias("level"))


def country_scores(facts: DataFrame, country: str, measures: list[str]) -> DataFrame:
    """Score 1 to 100 per country and indicator, min-max scaled, ranked. One row per country in."""
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("indicator"), F.col(m).cast("double").alias("v")) for m in measures]))
    rows = facts.select(country, pairs)
    w = Window.partitionBy("indicator")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    scored = rows.withColumn("score", F.when(hi > lo, 1 + 99 * (F.col("v") - lo) / (hi - lo)).otherwise(1.0))
    return scored.withColumn("rank", F.rank().over(w.orderBy(F.desc("v")))).drop("v")


def union_geo_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """One table from differently shaped sources with a source column; missing columns are null."""
    named = [df.withColumn("source", F.lit(n)) for n, df in sources.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def latest_position(df: DataFrame, mover: str, order: list[str], cols: list[str]) -> DataFrame:
    """Last known row per mover."""
    return df.groupBy(mover).agg(
        F.max_by(F.struct(*order, *cols), F.struct(*order)).alias("_r")).select(mover, "_r.*")


def on_time_performance(trips: DataFrame, by: list[str], planned: str, actual: str) -> DataFrame:
    """Delay in days, share on time, exact median and 90th percentile by carrier, station or day.

    Trips are counted per delay first, which combines before the shuffle; everything
    else comes from those counts. Trips without one of the two dates have no delay.
    """
    late = F.date_diff(F.to_date(actual), F.to_date(planned)).cast("double")
    counts = trips.groupBy(*by, late.alias("delay")).agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("delay").isNotNull(), F.col("n")))
    at = F.percentile("delay", [0.5, 0.9], F.col("n"))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("trips"),
        (F.coalesce(F.sum(F.when(F.col("delay") <= 0, F.col("n"))), F.lit(0)) / known).alias("on_time"),
        (F.sum(F.col("delay") * F.col("n")) / known).alias("mean_delay"),
        F.get(at, F.lit(0)).alias("p50"), F.get(at, F.lit(1)).alias("p90"))


def shipment_history(events: DataFrame, number: str, order: list[str], state: str) -> DataFrame:
    """Every stay of a container or voyage number in one state: first and last report, and how many."""
    return dns_history(events, number, order, state).withColumnsRenamed(
        {"valid_from": "first_at", "last_seen": "last_at", "sightings": "reports"})


def shipment_status(events: DataFrame, number: str, order: list[str], state: str) -> DataFrame:
    """Current state per container or voyage number, first and last report, reports so far."""
    return events.groupBy(number).agg(
        F.max_by(state, F.struct(*order)).alias("state"), F.min(order[0]).alias("first_at"),
        F.max(order[0]).alias("last_at"), F.count("*").alias("reports"))


def weather_statistics(df: DataFrame, place: str, ts: str, value: str, grain: str) -> DataFrame:
    """Minimum, maximum, mean and exact 90th percentile by place and time grain."""
    rows = df.select(place, F.to_date(F.date_trunc(grain, F.col(ts))).alias("period"), value)
    base = rows.groupBy(place, "period").agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean_value"))
    return base.join(exact_quantiles(rows, [place, "period"], value, {"p90": 0.9}), [place, "period"])


def recent_hazards(df: DataFrame, place: Column, kind: str, kinds: list[str], ts: str, hours: int) -> DataFrame:
    """Events of the last ``hours`` by place with counts per type; the cut-off reaches the scan."""
    since = latest(df, ts) - F.make_dt_interval(hours=F.lit(hours))
    return df.where(F.col(ts) >= since).groupBy(place.alias("place")).agg(
        F.count("*").alias("events"), *[F.count_if(F.col(kind) == x).alias(f"n_{x}") for x in kinds])


def place_time_search(df: DataFrame, box: tuple, ts: str, start: Column, end: Column) -> DataFrame:
    """Items inside a rectangle and a time range, end excluded."""
    timed = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    return within_bbox(timed, *box)


def year_over_year(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Change of a yearly total per key against the year before."""
    yearly = df.groupBy(key, F.year(ts).alias("year")).agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
    prev = yearly.select(key, (F.col("year") + 1).alias("year"), F.col("total").alias("before"))
    return yearly.join(prev, [key, "year"]).withColumn(
        "change_pct", (F.col("total") - F.col("before")).cast("double") * 100 / F.col("before").cast("double"))

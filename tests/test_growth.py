"""Steps whose work grew faster than their input, on rows where that shows."""

import random

from gleaner.operators import geo


def test_places_at_one_spot_are_not_all_ordered(spark, monkeypatch):
    pois = [(i, "x", 50.0, 10.0) for i in range(400)] + [(500 + i, "x", 50.0 + i, 11.0) for i in range(5)]
    points = [(i, 49.0 + i / 100, 10.0) for i in range(20)]
    ordered = []

    def counted(df, keys, order, k, real=geo.top_k_per_group):
        if "id" in keys:
            ordered.append(df.count())
        return real(df, keys, order, k)

    monkeypatch.setattr(geo, "top_k_per_group", counted)
    got = geo.nearest_poi(spark.createDataFrame(points, "id long, lat double, lon double"), "id",
                          spark.createDataFrame(pois, "poi long, kind string, plat double, plon double"), "poi", "kind", 2)
    assert sorted((r.id, r.position, r.poi) for r in got.collect()) == [(i, p, p - 1) for i in range(20) for p in (1, 2)]
    assert max(ordered) <= 2 * 20


def test_nearest_places_in_several_lists_with_ties_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(geo, "LISTED", 7, raising=False)
    rnd = random.Random(3)
    pois = [(rnd.randrange(40), rnd.choice("xy"), float(rnd.randrange(5)), float(rnd.randrange(5))) for _ in range(120)]
    pois += [(None, "x", 1.0, 1.0), (7, None, 1.0, 1.0), (8, "y", None, 1.0)]
    points = [(i % 12, rnd.random() * 5, rnd.random() * 5) for i in range(15)] + [(50, None, 1.0)]
    points = spark.createDataFrame(points, "id long, lat double, lon double")
    pois = spark.createDataFrame(pois, "poi long, kind string, plat double, plon double")
    got = geo.nearest_poi(points, "id", pois, "poi", "kind", 3)
    points.createOrReplaceTempView("asked")
    pois.createOrReplaceTempView("places")
    want = spark.sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY round(km, 6), poi) AS position
        FROM (SELECT id, kind, poi, 2 * {geo.X.EARTH_KM}D * asin(sqrt(least(1D, pow(sin(radians(plat - lat) / 2), 2)
         + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS km
         FROM asked CROSS JOIN places WHERE kind IS NOT NULL AND plat IS NOT NULL AND lat IS NOT NULL)) WHERE position <= 3""")

    def rows(df):
        return sorted((r.id, r.kind, r.position, -1 if r.poi is None else r.poi, round(r.km, 5)) for r in df.collect())

    assert rows(got) == rows(want)

"""Operators against brute force on small fixtures, and plan checks."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import geocols, textcols, webcols
from gleaner.operators import geo, graph, registers, search, stats, text, vectors, web
from gleaner.sources import files, sinks

HERE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    from gleaner.sources.tables import read_table

    return read_table(spark, HERE, name)


def shingles(s, n=3):
    w = [x for x in __import__("regex").split(r"[^\p{L}\p{N}]+", s.lower()) if x]
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)}


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(60)) for _ in range(12)]
    rows, i = [], 0
    for b in base:
        for _ in range(5):
            words = b.split()
            words[rnd.randrange(60)] = f"new{i}"
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(1000 + j, base[0]) for j in range(40)]  # a third of the rows are one copy
    got = {r["id"]: (r["leader"], r["jaccard"]) for r in text.near_duplicates(
        spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.7).collect()}
    texts = dict(rows)
    for k, (leader, j) in got.items():
        a, b = shingles(texts[k]), shingles(texts[leader])
        assert j == pytest.approx(len(a & b) / len(a | b)) and j >= 0.7 and leader < k
    # every other text follows the smallest one that is close enough, copies the smallest equal one
    want = {}
    for b in sorted(texts):
        y = shingles(texts[b])
        same = [a for a in texts if a < b and texts[a] == texts[b]]
        near = [a for a in texts if a < b and len(shingles(texts[a]) & y) / len(shingles(texts[a]) | y) >= 0.7]
        if near:
            want[b] = min(same or near)
    assert {k: leader for k, (leader, _) in got.items()} == want


def test_near_duplicates_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " . "), (4, "one"), (5, "One!"), (6, None), (7, "one two"), (8, "a b c d e f g"), (8, "a b c d e f g")]
    got = text.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert sorted((r.id, r.leader, r.jaccard) for r in got) == [(3, 2, 1.0), (5, 4, 1.0)]
    assert text.near_duplicates(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_unlike_texts_with_a_passage_in_common_hardly_meet(spark):
    """Pairs scored grow with the texts, not with their square."""
    def pairs(many):
        rnd = random.Random(many)
        sets = [(i, [*range(20), *{rnd.randrange(100, 100 + 40 * many) for _ in range(40)}]) for i in range(many)]
        b = text.prefix_buckets(spark.createDataFrame(sets, "id long, s array<long>"), 0.7).alias("b")
        a = b.select(F.col("id").alias("lead"), "bucket", F.col("about").alias("_about"))
        met = b.join(a, "bucket").where("lead < id").where(text.may_reach(0.7)(F.col("about"), F.col("_about")))
        return met.select("id", "lead").distinct().count()

    few, more = pairs(200), pairs(800)
    assert more <= 4 * 1.25 * max(few, 200)


def test_near_duplicate_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in v + rng.standard_normal(16) * 0.05]) for i, v in enumerate(base)]
    rows += [(200 + i, [float(x) for x in base[0]]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["leader"] for r in vectors.near_duplicate_vectors(df, "id", "v", 16, 0.95).collect()}
    for i in range(30):
        assert got[100 + i] == i
        assert got[200 + i] == 0


def test_components_and_labels_do_not_depend_on_row_order(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    edges += [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 340)]
    runs = []
    for _ in range(2):
        rnd.shuffle(edges)
        df = spark.createDataFrame(edges, "a long, b long")
        runs.append({r["node"]: r["component"] for r in graph.connected_components(df, "a", "b").collect()})
    assert runs[0] == runs[1]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert runs[0] == {n: find(n) for n in parent}


def test_page_rank_sums_to_one_and_communities_split(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6)], "a long, b long")
    ranks = {r["node"]: r["rank"] for r in graph.page_rank(edges, "a", "b", 20).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks[3] == max(ranks.values())
    got = {r["node"]: r["community"] for r in graph.communities(edges, "a", "b").collect()}
    assert got[1] == got[2] == got[3] != got[5]


def test_shortest_path_and_trace(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0), (4, 1, 1.0)], "a long, b long, c double")
    best = graph.shortest_paths(e, "a", "b", 1, "c")
    assert {r["node"]: (r["cost"], r["legs"]) for r in best.collect()} == {1: (0.0, 0), 3: (1.0, 1), 2: (2.0, 2), 4: (3.0, 3)}
    assert [r["place"] for r in graph.trace_path(best, 4).orderBy("hop").collect()] == [4, 2, 3, 1]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_co_membership_against_all_pairs(spark, least):
    rnd = random.Random(4)
    rows = [(f"g{rnd.randrange(12)}", rnd.randrange(25)) for _ in range(150)] + [(f"g{i}", 99) for i in range(12)]
    got = {(r["a"], r["b"]): r["shared"] for r in graph.co_membership(
        spark.createDataFrame(rows, "g string, m long"), "g", "m", least).collect()}
    sets = {}
    for g, m in rows:
        sets.setdefault(g, set()).add(m)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)
            if len(sets[a] & sets[b]) >= least}
    assert got == want


def test_ownership_with_loop_ends(spark):
    s = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "d", 0.4), ("c", "d", 0.2), ("b", "e", 0.1), ("e", "b", 0.1)],
                              "c string, o string, s double")
    got = {(r["company"], r["holder"]): r["part"] for r in graph.ownership_chain(s, "c", "o", "s").collect()}
    assert got[("a", "d")] == pytest.approx(0.5 * 0.4 / (1 - 0.01) + 0.1)


def test_nearest_poi_in_crowd_and_far_away(spark):
    rnd = random.Random(8)
    pois = [(i, "x" if i % 2 else "y", 50 + rnd.random() / 100, 10 + rnd.random() / 100) for i in range(300)]
    pois += [(900, "x", -60.0, 179.9), (901, "y", 89.9, 0.0)]
    pts = [(1, 50.005, 10.005), (2, -60.0, -179.9), (3, 90.0, 120.0), (4, 0.0, 0.0)]
    got = geo.nearest_poi(spark.createDataFrame(pts, "id long, lat double, lon double"), "id",
                          spark.createDataFrame(pois, "poi long, kind string, plat double, plon double"), "poi", "kind", 3).collect()
    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geocols.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))
    for pid, lat, lon in pts:
        for kind in "xy":
            want = sorted(round(km(lat, lon, p[2], p[3]), 6) for p in pois if p[1] == kind)[:3]
            have = sorted(round(r["km"], 6) for r in got if r["id"] == pid and r["kind"] == kind)
            assert have == pytest.approx(want, abs=1e-5)


def test_haversine_is_symmetric(spark):
    df = spark.sql("SELECT 10.0D a, 20.0D b, -33.0D c, 151.0D d")
    x = df.select(geocols.haversine_km(*[F.col(c) for c in "abcd"]), geocols.haversine_km(*[F.col(c) for c in "cdab"])).first()
    assert x[0] == pytest.approx(x[1])


def test_prefix_lookup_picks_narrowest(spark):
    nets = spark.createDataFrame([("world", 0, 2**32 - 1), ("a", 1000, 5000), ("b", 2000, 2007), ("odd", 3001, 3003)], "n string, lo long, hi long")
    ips = spark.createDataFrame([(x,) for x in (0, 999, 1000, 2003, 2008, 3001, 3003, 3004, 5000, 5001, 2**32 - 1)], "ip long")
    got = {r["ip"]: r["n"] for r in web.ip_prefix_lookup(ips, "ip", nets, "lo", "hi", "n").collect()}
    assert got == {0: "world", 999: "world", 1000: "a", 2003: "b", 2008: "a", 3001: "odd", 3003: "odd", 3004: "a",
                   5000: "a", 5001: "world", 2**32 - 1: "world"}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_shared_pieces_find_every_near_name(spark, edits):
    rnd = random.Random(6)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(120)})
    hosts = spark.createDataFrame([(n,) for n in names], "h string")
    brands = spark.createDataFrame([(n,) for n in names[::4]], "b string")
    got = {(r["h"], r["b"]) for r in web.lookalike_domains(hosts, "h", brands, "b", edits).collect()}
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]
    assert got == {(h, b) for h in names for b in names[::4] if h != b and lev(h, b) <= edits}


def test_keys_per_name_do_not_grow_with_its_length(spark):
    df = spark.createDataFrame([(n, "".join(chr(97 + i * i % 23) for i in range(n))) for n in (0, 1, 8, 64, 4000)], "n int, s string")
    rows = {r["n"]: (r["asked"], r["kept"]) for r in df.select(
        "n", F.size(webcols.probes(F.col("s"), 2)).alias("asked"), F.size(webcols.segments(F.col("s"), 2)).alias("kept")).collect()}
    assert all(asked <= 75 and kept == 3 for asked, kept in rows.values())


def test_screening_with_short_and_missing_names(spark):
    names = spark.createDataFrame([(1, "AB"), (2, None), (3, ""), (4, "Gazprom Neft Ltd"), (4, "Gazprom Neft Ltd")], "id int, n string")
    listed = spark.createDataFrame([("A",), ("GAZPRON NEFT",), (None,), ("ABCDEFG",)], "e string")
    got = registers.watchlist_screening(names, "n", listed, "e", 2, 0.5).select("id", "e", "edits").collect()
    assert sorted(map(tuple, got)) == [(1, "A", 1), (4, "GAZPRON NEFT", 1), (4, "GAZPRON NEFT", 1)]


def test_diff_added_plus_kept_is_new_version(spark):
    docs = table(spark, "documents").select("doc_id", "text").where("doc_id < 40")
    new = docs.withColumn("text", F.concat("text", F.lit("\nmore\nmore")))
    out = text.text_diff(docs, new, ["doc_id"], "text").join(
        new.select("doc_id", F.size(F.split("text", "\n")).alias("lines")), "doc_id").collect()
    assert all(r["added"] + r["kept"] == r["lines"] and r["added"] == 2 for r in out)


def test_cube_levels_add_up(spark):
    t = stats.multi_level_totals(table(spark, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count("*").alias("n")])
    sums = {r["level"]: r["s"] for r in t.groupBy("level").agg(F.sum("n").alias("s")).collect()}
    assert len(set(sums.values())) == 1


def test_sessions_keep_every_event(spark):
    ev = table(spark, "events").select("user_id", "ts", "event_id")
    m = stats.session_measures(stats.sessionise(ev, ["user_id"], ["ts", "event_id"], 1800), ["user_id"], "ts")
    assert m.agg(F.sum("hits")).first()[0] == ev.count()


def test_check_digits(spark):
    got = spark.sql("SELECT * FROM VALUES ('GB82WEST12345698765432'), ('GB82WEST12345698765433'), ('x') t(c)").select(
        textcols.mod97_valid(F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_ipv4_and_versions(spark):
    r = spark.range(1).select(webcols.ipv4_number(F.lit("1.2.3.4")), webcols.ipv4_number(F.lit("1.2.3.400")),
                              webcols.version_number(F.lit("2.10")), webcols.version_number(F.lit("2.9.9"))).first()
    assert r[0] == 16909060 and r[1] is None and r[2] > r[3]


def test_areas_across_the_date_line(spark):
    corners = {"pacific": [(10, 170), (-10, 170), (-10, -170), (10, -170)], "zero": [(10, -5), (-10, -5), (-10, 5), (10, 5)]}
    rows = [(z, i, float(a), float(o)) for z, c in corners.items() for i, (a, o) in enumerate(c)]
    for start in range(4):  # whichever vertex comes first
        turned = [(z, (i + start) % 4, a, o) for z, i, a, o in rows]
        ring = geo.rings(spark.createDataFrame(turned, "zone string, i int, lat double, lon double"), ["zone"])
        pts = spark.createDataFrame(
            [(1, 0.0, 179.5), (2, 0.0, -179.5), (3, 0.0, 0.0), (4, 0.0, 169.0), (5, 0.0, -169.0), (6, 11.0, 180.0), (7, None, 1.0)],
            "id int, lat double, lon double")
        got = {(r["id"], r["zone"]) for r in geo.points_in_polygons(pts, ring, "zone").collect()}
        assert got == {(1, "pacific"), (2, "pacific"), (3, "zero")}, start
        km2 = {r["zone"]: r["km2"] for r in geo.polygon_measures(ring).collect()}
        assert km2["pacific"] == pytest.approx(2 * km2["zero"])


def test_merged_sketches_equal_whole_ones(spark):
    rows = [(f"k{i % 3}", f"2024-01-{1 + i % 5:02d} 10:00:00", i % 97 if i % 11 else None, float(i % 500) if i % 7 else None) for i in range(6000)]
    rows += [("k9", None, None, None)]
    df = spark.createDataFrame(rows, "k string, ts string, m int, v double").withColumn("ts", F.to_timestamp("ts"))
    days = stats.day_sketches(df, ["k"], "ts", "m", "v")
    whole = {r["k"]: r for r in df.groupBy("k").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("m", 14)).alias("reach"), F.count("*").alias("acts"), F.count("v").alias("n"),
        F.percentile("v", F.lit(0.47)).alias("low"), F.percentile("v", F.lit(0.53)).alias("high")).collect()}
    got = {r["k"]: r for r in stats.merged_sketches(days, ["k"]).collect()}
    assert set(got) == set(whole)
    for k, r in got.items():
        w = whole[k]
        assert (r["reach"], r["acts"], r["n_values"]) == (w["reach"], w["acts"], w["n"])
        assert (r["p50"] is None) == (w["n"] == 0) and (r["p50"] is None or w["low"] <= r["p50"] <= w["high"])
    two = stats.merged_sketches(days, [], "2024-01-02", "2024-01-03").first()
    assert two["acts"] == 2400 and two["reach"] == 97
    assert stats.merged_sketches(days.limit(0), ["k"]).count() == 0


def test_hard_joins_have_no_nested_loop(spark):
    pts = spark.range(100).select(F.col("id"), (F.col("id") * 1.0).alias("lat"), (F.col("id") * 1.0).alias("lon"))
    nets = spark.createDataFrame([("a", 0, 9)], "n string, lo long, hi long")
    ring = spark.sql("SELECT 'z' zone, array(named_struct('lat',0D,'lon',0D),named_struct('lat',0D,'lon',9D),named_struct('lat',9D,'lon',0D)) ring")
    names = spark.createDataFrame([("Acme Ltd",)], "c string")
    for df in (geo.points_in_polygons(pts, ring, "zone"), web.ip_prefix_lookup(pts.select(F.col("id").alias("ip")), "ip", nets, "lo", "hi", "n"),
               registers.watchlist_screening(names, "c", names.withColumnRenamed("c", "e"), "e", 1, 0.5)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(stats.top_k(table(spark, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", "o_orderkey", 5))
    assert "EqualTo(o_orderstatus,F)" in p and "o_custkey" not in p and "TakeOrderedAndProject" in p


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    p = plan(stats.top_k_by_group(table(spark, "customer"), "c_nationkey", "c_acctbal", "c_custkey", 3))
    assert "WindowGroupLimit" in p


def test_asked_terms_are_folded_and_cut(spark):
    df = spark.createDataFrame([(1, "A State of the Art fox"), (2, "the state, art")], "id long, t string")
    assert [r["id"] for r in search.boolean_search(df, "t", ["Fox", "state-of-the-art"]).collect()] == [1]
    assert [r["id"] for r in search.boolean_search(df, "t", ["state"], [], ["Of the"]).collect()] == [2]
    assert search.boolean_search(df, "t", ["--"]).count() == 0
    assert [(r["id"], r["at"]) for r in search.phrase_search(df, ["id"], "t", "State-of").collect()] == [(1, 2)]
    assert [r["id"] for r in search.ranked_search(df, "id", "t", ["FOX"], 5).collect()] == [1]


def test_links_in_all_forms(spark):
    html = """<a href="/r">r</a><A HREF='//cdn.b.org/q'>q</A><a class=x href=z.html>z</a><a href="../up/./d?x=../1#k">u</a>
    <a href="?p=2">p</a><a href="#s">s</a><a href="mailto:x@y.org">m</a><a data-href="no" href="https://c.org/">c</a><img src='i.png'>"""
    df = spark.createDataFrame([(1, "https://a.org/x/y/page?n=1#t", html)], "id long, u string, h string")
    got = [(r["target"], r["kind"]) for r in web.extract_links(df, "id", "u", "h").orderBy("at").collect()]
    assert got == [
        ("https://a.org/r", "link"), ("https://cdn.b.org/q", "link"), ("https://a.org/x/y/z.html", "link"),
        ("https://a.org/x/up/d?x=../1#k", "link"), ("https://a.org/x/y/page?p=2", "link"),
        ("https://a.org/x/y/page?n=1#s", "link"), ("mailto:x@y.org", "link"), ("https://c.org/", "link"),
        ("https://a.org/x/y/i.png", "image")]


def test_suffix_rules(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.shop.ck",), ("y.www.ck",), ("z.q.dev",), ("dev",), (None,)], "h string")
    rules = spark.createDataFrame([("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "suffix string")
    got = {r["h"]: (r["suffix"], r["domain"]) for r in web.registered_domain(hosts, "h", rules).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.shop.ck": ("shop.ck", "x.shop.ck"), "y.www.ck": ("ck", "www.ck"),
                   "z.q.dev": ("dev", "q.dev"), "dev": ("dev", "dev")}


def test_robots_agents_in_a_row_share_rules(spark):
    lines = ["Disallow: /early", "User-agent: a", "# between", "user-agent: b # two", "Disallow: /x # note", "Allow: /y", "User-agent: c", "Disallow:"]
    df = spark.createDataFrame([("h", i, x) for i, x in enumerate(lines)], "h string, n long, l string")
    got = sorted((r["agent"], r["rule"], r["path"]) for r in web.robots_rules(df, "h", "n", "l").collect())
    assert got == [("a", "allow", "/y"), ("a", "disallow", "/x"), ("b", "allow", "/y"), ("b", "disallow", "/x"), ("c", "disallow", "")]


def test_amounts_with_separators(spark):
    df = spark.createDataFrame([(1, "for $1,234.56 or €99 and £1234, since 2024-02-30 or 2024-02-29")], "id long, t string")
    got = text.extract_dates_prices(df, "id", "t").collect()
    assert sorted((r["currency"], float(r["amount"])) for r in got if r["kind"] == "price") == [("$", 1234.56), ("£", 1234.0), ("€", 99.0)]
    assert [str(r["on_date"]) for r in got if r["kind"] == "date"] == ["2024-02-29"]


def test_cells_with_line_breaks_come_back(spark, tmp_path):
    cells = ["a\nb", "c:\\new\r\n", ' "q", \\e ', "plain", "\\\n\\n"]
    sinks.write_csv(spark.createDataFrame(list(enumerate(cells)), "id long, t string"), str(tmp_path / "a"))
    back = files.read_csv(spark, str(tmp_path / "a"), "id long, t string", escaped=True)
    assert {r["id"]: r["t"] for r in back.collect()} == dict(enumerate(cells))
    (tmp_path / "b.csv").write_text('id,t\n1,"two\nlines"\n2,one\n')
    rows = files.read_csv(spark, str(tmp_path / "b.csv"), "id long, t string", multi_line=True).collect()
    assert [(r["id"], r["t"]) for r in rows] == [(1, "two\nlines"), (2, "one")]


def test_boolean_search_with_nulls(spark):
    df = spark.createDataFrame([(1, "Red fox, blue sky"), (2, None), (3, "red-blue"), (4, "blue")], "id long, t string")
    assert [r["id"] for r in search.boolean_search(df, "t", ["blue"], ["red", "fox"], ["sky"]).collect()] == [3]


def test_addresses_of_both_kinds_and_without_a_network(spark):
    import ipaddress

    from gleaner.functions import webcols

    good = ["::", "::1", "1::", "2001:db8::ff00:42:8329", "2001:0DB8:0:0:0:0:0:1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "10.1.2.3", "1::8:0"]
    bad = ["1:2:3", "1::2::3", "12345::", ":1::2", "1:2:3:4:5:6:7:8:9", "::g", "300.1.1.1", "x", "", "1:2:3:4:5:6:7::8:9", "1::2:"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "ip string")
    got = {r.ip: r.x for r in df.select("ip", webcols.address_hex(F.col("ip")).alias("x")).collect()}
    for x in good:
        a = ipaddress.ip_address(x)
        assert got[x] == f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}", x
    assert all(got[x] is None for x in [*bad, None])
    nets = spark.createDataFrame([("2001:db8::/32", "a"), ("2001:db8::ff00:0:0/87", "b"), ("10.0.0.0/8", "c"), ("10.1.2.3", "d"), ("::/0", "z"), ("junk/9", "j"), (None, "k")], "cidr string, owner string")
    found = {r.ip: (r.owner, r.prefix_len, r.found) for r in web.cidr_lookup(df, "ip", nets.where("owner != 'z'"), "cidr", "owner").collect()}
    assert found["2001:db8::ff00:42:8329"] == ("b", 87, True) and found["2001:0DB8:0:0:0:0:0:1"] == ("a", 32, True)
    assert found["10.1.2.3"] == ("d", 128, True) and found["::1"] == (None, None, False) and found["x"] == (None, None, False)
    assert len(found) == len(good) + len(bad)
    assert web.cidr_lookup(df, "ip", nets, "cidr", "owner").where("found").count() == len(good)
    assert web.cidr_lookup(df, "ip", nets.limit(0), "cidr", "owner").where("NOT found").count() == len(good) + len(bad)


def test_lookups_keep_what_they_do_not_find_and_long_values_stay_whole(spark):
    from gleaner.functions import textcols
    from gleaner.operators import registers

    ips = spark.createDataFrame([(5,), (500,), (None,)], "ip long")
    nets = spark.createDataFrame([("n", 0, 9)], "n string, lo long, hi long")
    assert {(r.ip, r.n) for r in web.ip_prefix_lookup(ips, "ip", nets, "lo", "hi", "n").collect()} == {(5, "n"), (500, None)}
    nums = spark.createDataFrame([("123",), ("9",), ("",), (None,)], "num string")
    pre = spark.createDataFrame([("12", "x"), ("1", "y"), ("999", "z")], "prefix string, owner string")
    got = {(r.num, r.owner, r.digits) for r in registers.longest_prefix_lookup(nums, "num", pre, "prefix", "owner").collect()}
    assert got == {("123", "x", 2), ("9", None, None), ("", None, None)}
    body = "1" * 80
    code = f"QZ{98 - int(body + '263500') % 97:02d}{body}"
    assert spark.createDataFrame([(code,)], "c string").select(textcols.mod97_valid(F.col("c"))).first()[0]
    long = [("s" * 5000 + x, 1) for x in "ab"]
    sites = web.shared_tracker_groups(spark.createDataFrame(long, "site string, t long"), "site", "t").collect()
    assert {r.site for r in sites} == {x for x, _ in long}
    rows = text.extract_dates_prices(spark.createDataFrame([(1, "$12345678901234567890.00")], "id long, t string"), "id", "t").collect()
    assert [(r.raw, str(r.amount)) for r in rows] == [("$12345678901234567890.00", "12345678901234567890.00")]


def test_load_tree_with_several_parents_and_loops(spark):
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("b", "e"), ("c", "b"), ("x", "y"), ("y", "x"), ("c", "a"), (None, "a"), ("q", None), ("s", "r")]
    df = spark.createDataFrame(links, "src string, dst string")
    got = sorted((r.node, r.root, r.depth, r.parents) for r in web.domain_call_tree(df, "src", "dst").collect())
    assert got == [("b", "a", 1, 2), ("c", "a", 1, 2), ("d", "a", 2, 2), ("e", "a", 3, 1), ("s", "r", 1, 1)]
    got = sorted((r.node, r.depth) for r in web.domain_call_tree(df, "src", "dst", "d").collect())
    assert got == [("b", 2), ("c", 3), ("e", 1)]
    assert web.domain_call_tree(df.limit(0), "src", "dst").count() == 0
    chain = spark.range(1, 41).selectExpr("id AS src", "id - 1 AS dst")
    assert web.domain_call_tree(chain, "src", "dst").selectExpr("max(depth) AS d", "count(*) AS n").first() == (40, 40)


def test_null_content_is_captured_once(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "2024-01-01"), (2, "x", "2024-01-01"), (3, None, "2024-01-01")], "id long, html string, day string")
    for _ in range(3):
        sinks.append_snapshot(df, "html", "day", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_punctuality_from_counts_keeps_trips_without_a_date(spark):
    from gleaner.operators import geo

    rows = spark.sql("""SELECT * FROM VALUES ('a', date'2024-01-01', date'2024-01-03'), ('a', date'2024-01-01', date'2024-01-01'),
        ('a', date'2024-01-01', null), ('b', date'2024-01-01', null) AS t(carrier, planned, actual)""")
    got = {r.carrier: r for r in geo.on_time_performance(rows, ["carrier"], "planned", "actual").collect()}
    assert (got["a"].trips, got["a"].on_time, got["a"].mean_delay, got["a"].p50, got["a"].p90) == (3, 0.5, 1.0, 1.0, 1.8)
    assert (got["b"].trips, got["b"].on_time, got["b"].mean_delay, got["b"].p50) == (1, None, None, None)


def test_mentions_by_period_and_rates_by_chat(spark):
    from gleaner.operators import registers, stats

    rows = spark.sql("""SELECT * FROM VALUES ('Acme and acme', 'x', timestamp'2024-01-05'), ('acme', 'x', timestamp'2024-02-05'),
        (null, 'x', timestamp'2024-02-05'), ('other', 'y', null) AS t(text, chat, ts)""")
    names = spark.sql("SELECT 'acme' AS name UNION ALL SELECT 'acme'")
    got = registers.company_mentions(rows, "text", ["chat"], names, "name", "ts", "month").collect()
    assert sorted((r.chat, str(r.period), r.mentions) for r in got) == [("x", "2024-01-01", 2), ("x", "2024-02-01", 1)]
    rates = {r.chat: r for r in stats.message_rates(rows, ["chat"], "text", "ts").collect()}
    assert (rates["x"].messages, rates["x"].days, rates["x"].per_day, rates["x"].mean_chars) == (3, 2, 1.5, 8.5)
    assert (rates["y"].messages, rates["y"].days, rates["y"].per_day) == (1, 0, None)


def test_profile_counts_times_a_microsecond_apart(spark):
    from gleaner.sources.profile import table_profile

    rows = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2024-01-01 00:00:00.000001'), (timestamp_ntz'2024-01-01 00:00:00.000002'),
        (null) AS t(ts)""")
    (got,) = table_profile({"t": rows}, exact=True).collect()
    assert (got.type, got.rows, got.distinct_values) == ("timestamp_ntz", 3, 2)


def test_digests_that_rows_share(spark):
    from gleaner.operators import text

    rows = spark.sql("SELECT * FROM VALUES (1, 'a', null), (2, 'a', null), (3, 'b', 'c'), (4, 'b', 'd') AS t(id, x, y)")
    (got,) = text.digest_groups(rows, "id", ["x", "y"]).collect()
    assert (got.rows, got.first, got.last) == (2, 1, 2)

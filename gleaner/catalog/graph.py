"""Graphs: catalogue entries with check SQL."""

from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.operators import graph as G

CUT = "SELECT src, CASE WHEN src%10=0 THEN src ELSE dst END AS dst FROM v_hops"


@query("g01_connected_components", f"""WITH RECURSIVE e AS ({CUT}), w AS (SELECT src AS node, src AS pos FROM e
 UNION SELECT dst, dst FROM e UNION SELECT w.node, e.dst FROM w JOIN e ON w.pos=e.src)
 SELECT node, min(pos) AS component FROM w GROUP BY 1""")
def _(t):
    edges = t.v_hops.withColumn("dst", F.when(F.col("src") % 10 == 0, F.col("src")).otherwise(F.col("dst")))
    return G.connected_components(edges, "src", "dst")


def _roads(t):
    return t.v_follows.withColumn("cost", 1 + (F.col("follower") + F.col("followed")) % 9)


PATHS = """e AS (SELECT follower AS a, followed AS b, 1+(follower+followed)%9 AS c FROM v_follows),
 w AS (SELECT cast(1 as bigint) AS node, cast(0 as bigint) AS cost, 0 AS legs UNION SELECT e.b, w.cost+e.c, w.legs+1 FROM w JOIN e ON w.node=e.a
 WHERE w.cost+e.c<={limit} AND w.legs<12),
 m AS (SELECT node, min(cost) AS cost, arg_min(legs, cost*1000+legs) AS legs FROM w GROUP BY 1)"""


def _paths_sql(rounds=40):
    """Rounds of relaxation (Bellman-Ford); extra rounds change nothing."""
    parts = ["e AS (SELECT follower AS a, followed AS b, min(1+(follower+followed)%9) AS c FROM v_follows GROUP BY 1,2)",
             "p0 AS (SELECT cast(1 as bigint) AS node, cast(0 as bigint) AS cost, 0 AS legs, cast(1 as bigint) AS via)"]
    for i in range(rounds):
        parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT node, cost, legs, via FROM (SELECT *, row_number() OVER (PARTITION BY node
 ORDER BY cost, legs, new, via) AS rn FROM (SELECT node, cost, legs, via, 0 AS new FROM p{i} UNION ALL
 SELECT e.b, p.cost+e.c, p.legs+1, e.a, 1 FROM p{i} p JOIN e ON p.node=e.a)) WHERE rn=1)""")
    return ", ".join(parts)


@query("g02_shortest_path", f"""WITH {_paths_sql()} SELECT node, cast(cost as double) AS cost, legs FROM p40""")
def _(t):
    return G.shortest_paths(_roads(t), "follower", "followed", 1, "cost").select("node", "cost", "legs")


@query("g02_path_nodes", f"""WITH RECURSIVE {_paths_sql()}, w AS (SELECT node AS place, via, 0 AS hop FROM p40 WHERE node=77
 UNION ALL SELECT p.node, p.via, w.hop+1 FROM w JOIN p40 p ON p.node=w.via WHERE w.place<>w.via)
 SELECT place, cast(hop as bigint) AS hop FROM w""")
def _(t):
    best = G.shortest_paths(_roads(t), "follower", "followed", 1, "cost")
    return G.trace_path(best, 77)


@query("g03_running_ledger", """SELECT o_orderkey, o_custkey, R4(sum(CASE WHEN o_orderstatus='F' THEN -cast(o_totalprice as decimal(18,2))
 ELSE cast(o_totalprice as decimal(18,2)) END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS balance FROM orders""")
def _(t):
    money = F.col("o_totalprice").cast("decimal(18,2)")
    signed = F.when(F.col("o_orderstatus") == "F", -money).otherwise(money)
    tx = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return G.running_ledger(tx, "o_custkey", ["o_orderdate", "o_orderkey"], signed).select("o_orderkey", "o_custkey", "balance")


@query("g04_k_hop_neighbours", """WITH RECURSIVE w AS (SELECT cast(3 as bigint) AS node, 0 AS steps
 UNION SELECT h.src, w.steps+1 FROM w JOIN v_hops h ON h.dst=w.node WHERE w.steps<4) SELECT node, min(steps) AS steps FROM w GROUP BY 1""")
def _(t):
    return G.k_hop_neighbours(t.v_hops, "dst", "src", 3, 4)


@query("g05_ownership_chain", """WITH RECURSIVE s AS (SELECT child, owner, sum(share) AS share FROM v_shares WHERE child<>owner GROUP BY 1,2),
 w AS (SELECT child AS company, owner AS holder, share AS part, [child] AS path FROM s
 UNION ALL SELECT w.company, s.owner, w.part*s.share, list_append(w.path, s.child) FROM w JOIN s ON w.holder=s.child
 WHERE NOT list_contains(w.path, s.owner))
 SELECT company, holder, R4(sum(part)) AS part FROM w WHERE holder NOT IN (SELECT child FROM s) GROUP BY 1,2""")
def _(t):
    return G.ownership_chain(t.v_shares, "child", "owner", "share")


@query("g06_degree_centrality", """SELECT node, cast(sum(o) as bigint) AS out_degree, cast(sum(i) as bigint) AS in_degree, count(*) AS degree,
 R4(sum(w)) AS weight FROM (
 SELECT concat('s',cast(a as varchar)) AS node, 1 AS o, 0 AS i, cast(1+a%3 as double) AS w FROM v_edges
 UNION ALL SELECT concat('c',cast(b as varchar)), 0, 1, cast(1+a%3 as double) FROM v_edges) GROUP BY 1""")
def _(t):
    e = t.v_edges.select(F.concat(F.lit("s"), F.col("a").cast("string")).alias("x"),
                         F.concat(F.lit("c"), F.col("b").cast("string")).alias("y"), "a")
    return G.degree_centrality(e, "x", "y", (1 + F.col("a") % 3).cast("double"))


@query("g07_co_membership", """WITH m AS (SELECT DISTINCT user_id AS u, regexp_extract(props,'([0-9]+)',1) AS g FROM events),
 p AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM m a JOIN m b ON a.u=b.u AND a.g<b.g GROUP BY 1,2)
 SELECT a, b, shared FROM p WHERE shared>=40""")
def _(t):
    m = t.events.select("user_id", F.get_json_object("props", "$.k").alias("site"))
    return G.co_membership(m, "site", "user_id", 40)


def _named(t):
    return t.v_edges.select(F.concat(F.lit("s"), F.col("a").cast("string")).alias("x"),
                            F.concat(F.lit("c"), F.col("b").cast("string")).alias("y"))


NAMED = "e AS (SELECT DISTINCT concat('s',cast(a as varchar)) AS x, concat('c',cast(b as varchar)) AS y FROM v_edges)"


def _rank_sql(rounds):
    parts = [NAMED, "n AS (SELECT x AS node FROM e UNION SELECT y FROM e)", "d AS (SELECT x, count(*) AS deg FROM e GROUP BY 1)",
             "c AS (SELECT count(*) AS n FROM n)", "r0 AS (SELECT node, 1.0::double/(SELECT n FROM c) AS rank FROM n)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15::double/(SELECT n FROM c)+0.85::double*(coalesce(f.flow,0)
 +(SELECT coalesce(sum(rank),0) FROM r{i} WHERE node NOT IN (SELECT x FROM d))/(SELECT n FROM c)) AS rank FROM n LEFT JOIN (
 SELECT e.y AS node, sum(r.rank/d.deg) AS flow FROM r{i} r JOIN e ON r.node=e.x JOIN d ON d.x=e.x GROUP BY 1) f USING (node))""")
    return f"WITH {', '.join(parts)} SELECT node, R4(rank*1000) AS permille FROM r{rounds}"


def _label_sql(rounds):
    parts = [NAMED, "b AS (SELECT x AS src, y AS dst FROM e UNION SELECT y, x FROM e)",
             "l0 AS (SELECT DISTINCT src AS node, src AS label FROM b)"]
    for i in range(rounds):
        parts.append(f"""l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, label) AS rn
 FROM (SELECT b.src AS node, l.label FROM b JOIN l{i} l ON b.dst=l.node UNION ALL SELECT node, label FROM l{i}) GROUP BY 1,2) WHERE rn=1)""")
    return f"WITH {', '.join(parts)} SELECT l.node, l.label AS community, (SELECT count(*)=0 FROM l{rounds} a JOIN l{rounds - 1} b USING (node) WHERE a.label<>b.label) AS converged FROM l{rounds} l"


@query("g08_page_rank", _rank_sql(50))
def _(t):
    return G.page_rank(_named(t), "x", "y", tolerance=1e-10).select("node", (F.col("rank") * 1000).alias("permille"))


@query("g09_communities", _label_sql(40))
def _(t):
    return G.communities(_named(t), "x", "y")

"""URLs, pages, domains and networks: catalogue entries with check SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.catalog.registry import query
from gleaner.catalog.text import lit
from gleaner.functions import webcols as U
from gleaner.functions.textcols import IPV4
from gleaner.operators import web as D

HOST = "lower(regexp_extract(url,'^https?://([^/?#]+)',1))"
SCHEME_HOST = "regexp_extract(url,'^(https?://[^/]+)',1)"


@query("d01_parse_url_columns", rf"""SELECT page_id, regexp_extract(url,'^([a-z]+):',1) AS scheme, {HOST} AS host,
 regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1) AS path, nullif(regexp_extract(url,'\?([^#]*)',1),'') AS query,
 nullif(regexp_extract(url,'#(.*)$',1),'') AS fragment FROM pages""")
def _(t):
    return D.parse_url_columns(t.pages, "url").select("page_id", "scheme", "host", "path", "query", "fragment")


_canon = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,'#.*$',''),{lit(U.TRACKING)},'\1','g'),'([?&])&+','\1','g'),'[?&]+$',''),'/+$','')"""


@query("d02_canonicalise_url", f"""SELECT {_canon} AS canonical, min(page_id) AS first, count(distinct url) AS spellings
 FROM pages GROUP BY 1""")
def _(t):
    return D.canonicalise_url(t.pages, "page_id", "url")


@query("d03_registered_domain", rf"""WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages),
 s AS (SELECT host, CASE WHEN host LIKE '%.example.org' OR host='example.org' THEN 'example.org' ELSE regexp_extract(host,'[^.]+$') END AS suffix FROM h),
 r AS (SELECT host, suffix, left(host, length(host)-length(suffix)-1) AS head FROM s)
 SELECT host, suffix, concat(regexp_extract(head,'[^.]+$'),'.',suffix) AS domain,
 left(head, greatest(length(head)-length(regexp_extract(head,'[^.]+$'))-1,0)) AS subdomain FROM r""")
def _(t):
    suffixes = t.spark.createDataFrame([("com",), ("org",), ("example.org",)], "suffix string")  # net by the default rule
    return D.registered_domain(t.pages.select(U.host_of(F.col("url")).alias("host")), "host", suffixes)


@query("d04_registrations_per_tld_day", rf"""WITH d AS (SELECT {HOST} AS host, regexp_extract({HOST},'[^.]+$') AS tld,
 date '2024-01-01'+cast(page_id%30 as int) AS day FROM pages),
 f AS (SELECT host, tld, min(day) AS day FROM d GROUP BY 1,2), c AS (SELECT tld, day, count(*) AS n FROM f GROUP BY 1,2),
 g AS (SELECT tld, cast(x as date) AS day FROM (SELECT DISTINCT tld FROM c),
  (SELECT unnest(generate_series((SELECT min(day) FROM c),(SELECT max(day) FROM c), interval 1 day)) AS x))
 SELECT g.tld, cast(g.day as varchar) AS day, coalesce(n,0) AS n FROM g LEFT JOIN c ON g.tld=c.tld AND g.day=c.day""")
def _(t):
    host = U.host_of(F.col("url"))
    d = t.pages.select(host.alias("host"), F.substring_index(host, ".", -1).alias("tld"),
                       F.expr("date '2024-01-01' + cast(page_id%30 as int)").alias("day"))
    return D.registrations_per_tld_day(d, "host", "tld", "day")


LINKS = rf"""l AS (SELECT page_id, url AS page_url, i-1 AS "at", {SCHEME_HOST} AS base, trim(h[i],'"''') AS href, a[i] AS anchor FROM (
 SELECT *, unnest(generate_series(1,len(h))) AS i FROM (SELECT page_id, url, regexp_extract_all(html,{lit(U.LINK)},1) AS h,
 regexp_extract_all(html,{lit(U.LINK)},2) AS a FROM pages)))"""


MORE_LINKS = """<a class='x' href='//cdn.example.org/q'>cdn</a><a href=up.html>up</a><img alt="i" src="pic.png">"""


@query("d05_extract_links", rf"""WITH {LINKS}, m AS (SELECT page_id, url AS page_url, len(regexp_extract_all(html,{lit(U.LINK)},1)) AS n,
 regexp_extract(url,'^(https?:)',1) AS scheme, regexp_extract(url,'^(https?://[^/?#]+/(?:[^?#]*/)?)',1) AS folder FROM pages)
 SELECT page_id, "at", page_url, CASE WHEN starts_with(href,'/') THEN concat(base,href) ELSE href END AS target, anchor, 'link' AS kind FROM l
 UNION ALL SELECT page_id, n, page_url, concat(scheme,'//cdn.example.org/q'), 'cdn', 'link' FROM m
 UNION ALL SELECT page_id, n+1, page_url, concat(folder,'up.html'), 'up', 'link' FROM m
 UNION ALL SELECT page_id, n+2, page_url, concat(folder,'pic.png'), '', 'image' FROM m""")
def _(t):
    pages = t.pages.withColumn("html", F.concat("html", F.lit(MORE_LINKS)))
    return D.extract_links(pages, "page_id", "url", "html")


@query("d06_backlink_counts", f"""WITH {LINKS} SELECT href AS target, count(distinct page_id) AS pages,
 count(distinct base) AS hosts FROM l GROUP BY 1""")
def _(t):
    links = D.extract_links(t.pages, "page_id", "url", "html").select(
        F.regexp_extract("target", "^https?://[^/]+(.*)$", 1).alias("target"), "page_id",
        F.regexp_extract("page_url", "^(https?://[^/]+)", 1).alias("host"))
    return D.backlink_counts(links, "target", "page_id", "host")


LOADS = """SELECT src, dst FROM v_hops UNION ALL SELECT src, src-1 FROM v_hops WHERE src%10=3
 UNION ALL SELECT src, src*2 FROM v_hops WHERE src%50=7 UNION ALL SELECT -src, -src-1 FROM v_hops WHERE src<3 UNION ALL SELECT -3, -1 FROM v_hops"""


@query("d07_domain_call_tree", f"""WITH RECURSIVE l AS (SELECT DISTINCT src, dst FROM ({LOADS})),
 w AS (SELECT cast(0 as bigint) AS node, 0 AS depth UNION SELECT l.src, w.depth+1 FROM w JOIN l ON l.dst=w.node WHERE w.depth<40)
 SELECT node, cast(0 as bigint) AS root, min(depth)::BIGINT AS depth, (SELECT count(*) FROM l WHERE l.src=w.node) AS parents FROM w GROUP BY 1 HAVING min(depth)>0""")
def _(t):
    h = t.v_hops
    more = [h.where("src%10=3").selectExpr("src", "src-1"), h.where("src%50=7").selectExpr("src", "src*2"),
            h.where("src<3").selectExpr("-src", "-src-1"), h.selectExpr("cast(-3 as bigint)", "cast(-1 as bigint)")]
    return D.domain_call_tree(reduce(DataFrame.union, more, h.select("src", "dst")), "src", "dst", 0)


CHAIN = "SELECT src, CASE WHEN src%40=9 THEN src*2 ELSE dst END AS dst FROM v_hops"


@query("d08_redirect_chain", f"""WITH RECURSIVE c AS ({CHAIN}),
 w AS (SELECT src AS n, src, dst, 1 AS len, [src] AS path FROM c
 UNION ALL SELECT w.n, c.src, c.dst, w.len+1, list_append(w.path, c.src) FROM w JOIN c ON w.dst=c.src
 WHERE NOT list_contains(w.path, c.src)),
 e AS (SELECT n, max_by(dst,len) AS fin, max(len) AS length, max_by(list_contains(path,dst),len) AS loops FROM w GROUP BY 1)
 SELECT n AS src, CASE WHEN loops THEN -1 ELSE fin END AS final, CASE WHEN loops THEN -1 ELSE length END AS length, loops FROM e""")
def _(t):
    hops = t.v_hops.withColumn("dst", F.when(F.col("src") % 40 == 9, F.col("src") * 2).otherwise(F.col("dst")))
    return D.redirect_chain(hops, "src", "dst")


@query("d08_redirect_hops", f"""WITH RECURSIVE c AS ({CHAIN}),
 w AS (SELECT src AS n, src, dst, 1 AS len, [src] AS path FROM c
 UNION ALL SELECT w.n, c.src, c.dst, w.len+1, list_append(w.path, c.src) FROM w JOIN c ON w.dst=c.src
 WHERE NOT list_contains(w.path, c.src)),
 e AS (SELECT n, max_by(list_contains(path,dst),len) AS loops FROM w GROUP BY 1)
 SELECT n AS src, dst AS place, len AS hop FROM w WHERE n IN (SELECT n FROM e WHERE NOT loops)""")
def _(t):
    hops = t.v_hops.withColumn("dst", F.when(F.col("src") % 40 == 9, F.col("src") * 2).otherwise(F.col("dst")))
    return D.redirect_hops(hops, "src", "dst")


@query("d09_insecure_links", f"""SELECT {HOST} AS host, count(*) AS links, count(*) FILTER (starts_with(url,'http://')) AS on_http,
 count(*) FILTER (page_id%5=0) AS to_http, R4(count(*) FILTER (starts_with(url,'http://') OR page_id%5=0)/count(*)) AS share
 FROM pages GROUP BY 1""")
def _(t):
    target = F.when(F.col("page_id") % 5 == 0, "http://plain.example.org/a").otherwise("https://safe.example.org/a")
    return D.insecure_links(t.pages, "url", target)


@query("d10_broken_links", """WITH s AS (SELECT url, max_by(status, day) AS status FROM v_status GROUP BY 1),
 l AS (SELECT h.src AS page, CASE WHEN h.src%11=0 THEN concat(p.url,'/gone') ELSE p.url END AS url FROM v_hops h JOIN pages p ON p.page_id=h.dst)
 SELECT l.page, l.url, coalesce(s.status,0) AS status FROM l LEFT JOIN s ON l.url=s.url WHERE s.status IS NULL OR s.status>=400""")
def _(t):
    links = t.v_hops.join(t.pages, F.col("page_id") == F.col("dst")).select(
        F.col("src").alias("page"),
        F.when(F.col("src") % 11 == 0, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")).alias("url"))
    return D.broken_links(links, t.v_status, "url", "day", "status").select("page", "url", "status")


TECH = {"page-tracker": r"track\([0-9]+\)", "ad-slot": r"class=\"ad\"", "utf8": r"(?i)charset=\"utf-8\"",
        "inline-style": r"(?i)<style", "navigation": r"(?i)<nav>", "french": r"<html lang=\"fr\"", "token": r"(?i)token"}


@query("d11_detect_technologies", "SELECT technology, count(*) AS pages, count(distinct host) AS sites FROM ("
       + " UNION ALL ".join(f"SELECT '{n}' AS technology, {HOST} AS host FROM pages WHERE regexp_matches(html,{lit(p)})"
                            for n, p in TECH.items()) + ") GROUP BY 1")
def _(t):
    found = D.detect_technologies(t.pages.withColumn("host", U.host_of(F.col("url"))), "host", "html", TECH)
    return found.groupBy("technology").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("sites"))


FOUND = """SELECT page_id, concat('lib', cast(page_id%6 as varchar(9))) AS library,
 concat(cast(page_id%4 as varchar(9)),'.',cast(page_id%10 as varchar(9)),'.',cast(page_id%7 as varchar(9))) AS version FROM pages"""
ADVISORY = """SELECT concat('lib', cast(n_nationkey%6 as varchar(9))) AS library,
 concat(cast(n_nationkey%3 as varchar(9)),'.',cast(n_nationkey%7 as varchar(9)),'.0') AS first_bad,
 concat(cast(n_nationkey%3 as varchar(9)),'.',cast(n_nationkey%7+3 as varchar(9)),'.9') AS last_bad FROM nation"""
_ver = "(cast(string_split({0},'.')[1] as bigint)*1000000+cast(string_split({0},'.')[2] as bigint)*1000+cast(string_split({0},'.')[3] as bigint))"


@query("d12_outdated_libraries", f"""SELECT page_id, f.library, version, count(*) AS advisories FROM ({FOUND}) f JOIN ({ADVISORY}) a
 ON f.library=a.library AND {_ver.format('version')} BETWEEN {_ver.format('first_bad')} AND {_ver.format('last_bad')} GROUP BY 1,2,3""")
def _(t):
    return D.outdated_libraries(t.sql(FOUND), t.sql(ADVISORY), "page_id")


@query("d13_structured_metadata", """SELECT page_id, regexp_extract(html,'(?is)<title>(.*?)</title>',1) AS title,
 regexp_extract(html,'(?i)<html lang="([^"]*)"',1) AS lang, 'utf-8' AS charset,
 concat('a',cast(page_id%5 as varchar)) AS author, page_id AS ld_n FROM pages""")
def _(t):
    extra = F.expr("""concat(html, '<meta name="author" content="a', cast(page_id%5 as string), '"><meta name="x" content="">',
     '<script type="application/ld+json">{"@type":"Article","n":', cast(page_id as string), '}</script>')""")
    m = D.structured_metadata(t.pages.withColumn("html", extra), "page_id", "html")
    return m.select("page_id", "title", "lang", "charset", F.try_element_at("meta", F.lit("author")).alias("author"),
                    F.try_variant_get("ld", "$.n", "bigint").alias("ld_n"))


CLOUD = {"object-store-a": ".storage.example.com", "object-store-b": ".blob.example.net", "drive": "drive.example.org"}
CLOUD_URL = """CASE page_id%4 WHEN 0 THEN concat('https://b',cast(page_id as varchar(9)),'.storage.example.com/f')
 WHEN 1 THEN 'https://x.blob.example.net/c/f' WHEN 2 THEN 'https://drive.example.org/d' ELSE url END"""


@query("d14_classify_cloud_links", """SELECT CASE page_id%4 WHEN 0 THEN 'object-store-a' WHEN 1 THEN 'object-store-b'
 WHEN 2 THEN 'drive' ELSE 'other' END AS provider, count(*) AS links, count(distinct page_id) AS pages FROM pages GROUP BY 1""")
def _(t):
    return D.classify_cloud_links(t.pages.select("page_id", F.expr(CLOUD_URL).alias("link")), "page_id", "link", CLOUD)


@query("d15_shared_tracker_groups", rf"""WITH RECURSIVE e AS (SELECT DISTINCT {HOST} AS h,
 cast(floor(cast(regexp_extract(html,'track\(([0-9]+)\)',1) as bigint)/2) as bigint) AS t FROM pages),
 p AS (SELECT DISTINCT a.h AS a, b.h AS b FROM e a JOIN e b ON a.t=b.t),
 r AS (SELECT a AS x, a AS y FROM p UNION SELECT r.x, p.b FROM r JOIN p ON r.y=p.a),
 g AS (SELECT x, min(y) AS grp FROM r GROUP BY 1)
 SELECT x AS site, grp AS "group", count(*) OVER (PARTITION BY grp) AS sites FROM g""")
def _(t):
    ids = t.pages.select(U.host_of(F.col("url")).alias("host"),
                         F.floor(F.regexp_extract("html", r"track\(([0-9]+)\)", 1).cast("bigint") / 2).alias("tracker"))
    return D.shared_tracker_groups(ids, "host", "tracker")


@query("d16_lookalike_domains", rf"""WITH h AS (SELECT DISTINCT unnest(string_split({HOST},'.')) AS label FROM pages),
 b AS (SELECT unnest(['thern','ththin','cheap-pi11s','spam-farn','theran']) AS brand),
 f AS (SELECT label, brand, replace(translate(lower(label),'013457$@','oleastsa'),'rn','m') AS x,
  replace(translate(lower(brand),'013457$@','oleastsa'),'rn','m') AS y FROM h, b WHERE label<>brand)
 SELECT label, brand, levenshtein(x,y) AS distance FROM f WHERE levenshtein(x,y)<=2""")
def _(t):
    hosts = t.pages.select(F.explode(F.split(U.host_of(F.col("url")), r"\.")).alias("label"))
    brands = t.spark.createDataFrame([(b,) for b in ("thern", "ththin", "cheap-pi11s", "spam-farn", "theran")], "brand string")
    return D.lookalike_domains(hosts, "label", brands, "brand", 2)


@query("d17_blocklist_match", f"""SELECT page_id, {HOST} AS host FROM pages WHERE
 {HOST}='spam-farm.example.org' OR {HOST} LIKE '%.spam-farm.example.org' OR {HOST}='cheap-pills.example.com'
 OR {HOST} LIKE '%.cheap-pills.example.com' OR {HOST} LIKE '%example.net'""")
def _(t):
    feed = t.spark.createDataFrame([("spam-farm.example.org",), ("cheap-pills.example.com",), ("example.net",)], "entry string")
    pages = t.pages.select("page_id", U.host_of(F.col("url")).alias("host"))
    return D.blocklist_match(pages, "page_id", "host", feed, "entry")


@query("d18_page_fingerprint", r"""WITH c AS (SELECT page_id, regexp_replace(html,'(?s)^.*?</title>','') AS body FROM pages)
 SELECT md5(b) AS md5, sha1(b) AS sha1, sha256(b) AS sha256, count(*) AS pages, min(page_id) AS first FROM (
 SELECT page_id, body AS b FROM c) GROUP BY 1,2,3""")
def _(t):
    return D.page_fingerprint(t.pages, "page_id", F.regexp_replace("html", r"(?s)^.*?</title>", ""))


@query("d19_host_neighbours", """WITH p AS (SELECT host, ip_id, count(*) AS seen FROM v_dns GROUP BY 1,2)
 SELECT host, ip_id, seen, count(*) OVER (PARTITION BY ip_id)-1 AS neighbours FROM p""")
def _(t):
    return D.host_neighbours(t.v_dns, "host", "ip_id")


DNS = """i AS (SELECT host, ip_id, min(ts) AS valid_from, max(ts) AS last_seen, count(*) AS sightings FROM (
 SELECT *, sum(ch) OVER (PARTITION BY host ORDER BY ts, event_id) AS run FROM (
 SELECT *, CASE WHEN lag(ip_id) OVER (PARTITION BY host ORDER BY ts, event_id) = ip_id THEN 0 ELSE 1 END AS ch FROM v_dns))
 GROUP BY host, run, ip_id)"""


@query("d20_dns_history", f"""WITH {DNS} SELECT host, ip_id, strftime(valid_from,'%Y-%m-%d %H:%M:%S') AS valid_from,
 strftime(last_seen,'%Y-%m-%d %H:%M:%S') AS last_seen, sightings FROM i""")
def _(t):
    return D.dns_history(t.v_dns, "host", ["ts", "event_id"], "ip_id")


@query("d20_dns_as_of", f"""WITH {DNS} SELECT host, max_by(ip_id, valid_from) AS ip_id,
 strftime(max(valid_from),'%Y-%m-%d %H:%M:%S') AS valid_from FROM i WHERE valid_from<=timestamp '2024-01-15' GROUP BY 1""")
def _(t):
    h = D.dns_history(t.v_dns, "host", ["ts", "event_id"], "ip_id")
    return D.value_as_of(h, "host", "ip_id", F.lit("2024-01-15").cast("timestamp_ntz"))


@query("d21_expiring_domains", """SELECT page_id, url, cast(expires_on as varchar) AS expires_on,
 date_diff('day', date '2024-02-01', expires_on) AS days_left FROM v_expiry WHERE abs(date_diff('day', date '2024-02-01', expires_on))<=10""")
def _(t):
    return D.expiring_domains(t.v_expiry, "expires_on", F.lit("2024-02-01").cast("date"), 10)


@query("d22_registry_search", rf"""WITH r AS (SELECT unnest(string_split({HOST},'.')[1:-2]) AS name,
 regexp_extract({HOST},'[^.]+$') AS tld FROM pages) SELECT name, count(distinct tld) AS zones, min(tld) AS first_zone, count(*) AS rows
 FROM r WHERE contains(name,'th') OR contains(name,'farm') GROUP BY 1""")
def _(t):
    host = U.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    r = t.pages.select(F.explode(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))).alias("name"),
                       F.substring_index(host, ".", -1).alias("tld"))
    return D.registry_search(r, "name", "tld", ["th", "farm"])


_ipnum = "cast(string_split(s,'.')[1] as bigint)*16777216+cast(string_split(s,'.')[2] as bigint)*65536+cast(string_split(s,'.')[3] as bigint)*256+cast(string_split(s,'.')[4] as bigint)"
IPS = f"""n AS (SELECT DISTINCT {_ipnum} AS ip FROM (SELECT unnest(regexp_extract_all(text,{lit(IPV4)})) AS s FROM documents
 UNION ALL SELECT concat(cast(event_id%223 as varchar),'.',cast(user_id as varchar),'.',cast(floor(value)%250 as int),'.1') FROM events))"""


def _ips(t):
    found = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(IPV4), F.lit(0))).alias("s"))
    seen = t.events.selectExpr(
        "concat(cast(event_id%223 as string),'.',cast(user_id as string),'.',cast(cast(floor(value) as int)%250 as string),'.1') AS s")
    return found.union(seen).select(U.ipv4_number(F.col("s")).alias("ip"))


@query("d23_ip_prefix_lookup", f"""WITH {IPS} SELECT ip, arg_min(net, hi-lo) AS net FROM n LEFT JOIN v_nets ON ip BETWEEN lo AND hi WHERE ip IS NOT NULL GROUP BY 1""")
def _(t):
    return D.ip_prefix_lookup(_ips(t), "ip", t.v_nets, "lo", "hi", "net")


_V6 = 0x20010DB8 * 65536  # the first 48 bits of 2001:db8::


@query("d23_cidr_lookup", f"""WITH a AS (
 SELECT DISTINCT s AS ip, 32 AS w, {_ipnum} AS x FROM (SELECT concat(cast(event_id%223 as varchar),'.',cast(user_id as varchar),'.',cast(floor(value)%250 as int),'.1') AS s FROM events
  UNION ALL SELECT unnest(regexp_extract_all(text,{lit(IPV4)})) FROM documents) WHERE s IS NOT NULL
 UNION ALL SELECT DISTINCT concat('2001:db8:',lower(to_hex(user_id)),'::',lower(to_hex(event_id))), 48, {_V6}+user_id FROM events WHERE user_id IS NOT NULL),
 k AS (SELECT n_name AS owner, 48 AS w, 48 AS len, {_V6}+n_nationkey AS y FROM nation UNION ALL SELECT r_name, 48, 43, {_V6}+cast(32*r_regionkey as bigint) FROM region
 UNION ALL SELECT n_name, 32, 8, cast(n_nationkey as bigint)*9*16777216 FROM nation UNION ALL SELECT r_name, 32, 13, cast(r_regionkey as bigint)*18*16777216+8*65536 FROM region)
 SELECT ip, arg_max(owner, len) AS owner, max(len+CASE WHEN k.w=32 THEN 96 ELSE 0 END)::BIGINT AS prefix_len, count(len)>0 AS found
 FROM a LEFT JOIN k ON a.w=k.w AND (x>>(a.w-len))=(y>>(k.w-len)) GROUP BY 1""")
def _(t):
    six = t.events.where("user_id IS NOT NULL").selectExpr("concat('2001:db8:',lower(hex(user_id)),'::',lower(hex(event_id))) AS ip")
    four = t.events.selectExpr("concat(cast(event_id%223 as string),'.',cast(user_id as string),'.',cast(cast(floor(value) as int)%250 as string),'.1') AS ip")
    found = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(IPV4), F.lit(0))).alias("ip"))
    nets = t.nation.selectExpr("n_name AS owner", "concat('2001:DB8:',hex(n_nationkey),'::/48') AS cidr").union(
        t.region.selectExpr("r_name", "concat('2001:db8:',hex(32*r_regionkey),':0:0:0:0:0/43')")).union(
        t.nation.selectExpr("n_name", "concat(cast(n_nationkey*9 as string),'.0.0.0/8')")).union(
        t.region.selectExpr("r_name", "concat(cast(r_regionkey*18 as string),'.8.0.0/13')"))
    return D.cidr_lookup(four.union(found).union(six), "ip", nets, "cidr", "owner")


@query("d24_ip_geo_counts", f"""WITH {IPS}, f AS (SELECT ip, arg_min(net, hi-lo) AS net FROM n LEFT JOIN v_nets ON ip BETWEEN lo AND hi WHERE ip IS NOT NULL GROUP BY 1)
 SELECT net, count(*) AS addresses FROM f GROUP BY 1""")
def _(t):
    return D.ip_geo_counts(_ips(t), "ip", t.v_nets, "lo", "hi", "net")


ROBOTS = """SELECT concat('host',cast(page_id%9 as varchar(9))) AS host, page_id AS line_no, CASE page_id%4
 WHEN 0 THEN concat('User-agent: bot',cast(page_id%3 as varchar(9))) WHEN 1 THEN concat('Disallow: /p',cast(page_id as varchar(9)))
 WHEN 2 THEN 'Allow: /open # note' ELSE CASE WHEN page_id%5=0 THEN '# note' ELSE 'User-agent: both' END END AS line FROM pages"""


@query("d25_robots_rules", f"""WITH p AS (SELECT host, line_no, string_split(line,'#')[1] AS line FROM ({ROBOTS})),
 r AS (SELECT host, line_no, lower(trim(string_split(line,':')[1])) AS rule, trim(string_split(line,':')[2]) AS path FROM p WHERE contains(line,':')),
 b AS (SELECT *, CASE WHEN rule='user-agent' AND coalesce(lag(rule) OVER (PARTITION BY host ORDER BY line_no),'')<>'user-agent' THEN 1 ELSE 0 END AS st FROM r),
 g AS (SELECT *, sum(st) OVER (PARTITION BY host ORDER BY line_no) AS grp FROM b)
 SELECT x.host, y.path AS agent, x.rule, x.path FROM g x JOIN g y ON x.host=y.host AND x.grp=y.grp AND x.rule<>'user-agent' AND y.rule='user-agent'""")
def _(t):
    return D.robots_rules(t.sql(ROBOTS), "host", "line_no", "line")


COOKIE = """SELECT event_type, concat('sid=',cast(event_id as varchar(12)),CASE WHEN event_id%3>0 THEN concat('; Max-Age=',cast(user_id*100 as varchar(12))) ELSE '' END,
 CASE WHEN event_id%2=0 THEN '; Secure' ELSE '' END, CASE WHEN event_id%5=0 THEN '; HttpOnly' ELSE '' END) AS header FROM events"""


@query("d26_cookie_attributes", """SELECT event_type, count(*) AS cookies, count(*) FILTER (event_id%2<>0) AS not_secure,
 count(*) FILTER (event_id%5<>0) AS script_readable, count(*) FILTER (event_id%3>0 AND user_id*100>5000) AS long_lived,
 count(*) FILTER (event_id%3=0) AS session_only FROM events GROUP BY 1""")
def _(t):
    return D.cookie_attributes(t.sql(COOKIE), "event_type", "header", 5000)


@query("d27_snapshot_as_of", """SELECT url, cast(max(captured_on) as varchar) AS captured_on, max_by(digest, captured_on) AS digest
 FROM v_captures WHERE captured_on <= date '2024-02-10' GROUP BY 1""")
def _(t):
    return D.snapshot_as_of(t.v_captures, "url", "captured_on", ["digest"], F.lit("2024-02-10").cast("date"))


ASKED = "SELECT url, date '2024-01-05' + cast(page_id%80 AS int) AS asked_on FROM pages"


@query("d27_snapshots_for", f"""SELECT a.url, cast(a.asked_on as varchar) AS asked_on, cast(c.captured_on as varchar) AS as_of_time, c.digest
 FROM ({ASKED}) a ASOF LEFT JOIN v_captures c ON a.url=c.url AND a.asked_on>=c.captured_on""")
def _(t):
    return D.snapshots_for(t.sql(ASKED), t.v_captures, "url", "asked_on", "captured_on", ["digest"])


@query("d28_snapshot_changes", """SELECT page_id, url, cast(captured_on as varchar) AS captured_on, digest,
 cast(po as varchar) AS prev_captured_on, pd AS prev_digest FROM (SELECT *, lag(digest) OVER w AS pd, lag(captured_on) OVER w AS po FROM v_captures
 WINDOW w AS (PARTITION BY url ORDER BY captured_on)) WHERE pd<>digest""")
def _(t):
    return D.snapshot_changes(t.v_captures, "url", "captured_on", "digest")


RECORD = {"title": r"(?is)<title>(.*?)</title>", "heading": r"(?is)<h1>(.*?)</h1>", "tracker": r"track\(([0-9]+)\)",
          "owner": r"(?s)&copy; ([^ ]+)", "ad": r"(?is)<div class=\"ad\">(.*?)</div>"}


@query("d29_extract_records", "SELECT page_id, " + ", ".join(f"regexp_extract(html,{lit(p)},1) AS {f}" for f, p in RECORD.items()) + " FROM pages")
def _(t):
    return D.extract_records(t.pages, "page_id", "html", RECORD)


@query("d30_site_traffic", """WITH s AS (SELECT *, sum(st) OVER (PARTITION BY user_id, site ORDER BY ts, event_id) AS n FROM (
 SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts)-epoch(lag(ts) OVER w)>1800 THEN 1 ELSE 0 END AS st FROM v_visits
 WINDOW w AS (PARTITION BY user_id, site ORDER BY ts, event_id))),
 v AS (SELECT user_id, site, n, min(ts) AS started, count(*) AS hits, epoch(max(ts))-epoch(min(ts)) AS secs FROM s GROUP BY 1,2,3)
 SELECT site, cast(cast(started as date) as varchar) AS day, count(*) AS visits, count(distinct user_id) AS visitors,
 R4(avg(secs)) AS mean_seconds, R4(avg(hits)) AS pages_per_visit FROM v GROUP BY site, cast(started as date)""")
def _(t):
    return D.site_traffic(t.v_visits, "user_id", "site", ["ts", "event_id"], 1800)


KEY = "regexp_extract(props,'([0-9]+)',1)"


@query("d31_traffic_sources", f"""SELECT event_type, {KEY} AS keyword, count(*) AS visits,
 R4(count(*)/(SELECT count(*) FROM events)) AS share FROM events GROUP BY 1,2""")
def _(t):
    return D.traffic_sources(t.events, "event_type", F.get_json_object("props", "$.k"))


@query("d32_site_rank", f"""WITH c AS (SELECT {KEY} AS site, count(*) AS visits FROM events GROUP BY 1)
 SELECT site, visits, dense_rank() OVER (ORDER BY visits DESC) AS rank, R4(percent_rank() OVER (ORDER BY visits DESC)) AS percentile FROM c""")
def _(t):
    return D.site_rank(t.events, F.get_json_object("props", "$.k"))


@query("d33_visits_last_n_days", f"""SELECT {KEY} AS site, """ + ", ".join(
    f"count(*) FILTER (date_diff('day',cast(ts as date),(SELECT cast(max(ts) as date) FROM events))<{n}) AS last_{n}" for n in (10, 20, 50, 100))
    + " FROM events GROUP BY 1")
def _(t):
    return D.visits_last_n_days(t.events, F.get_json_object("props", "$.k"), "ts", [10, 20, 50, 100])


@query("d34_script_paths", """WITH p AS (SELECT page_id, concat('/js/v',cast(page_id%5 as varchar),'/m',cast(page_id%17 as varchar),'.js') AS path FROM pages
 UNION ALL SELECT page_id, '/api/x' FROM pages)
 SELECT regexp_replace(path,'[^/]*$','') AS folder, count(distinct path) AS paths, count(distinct page_id) AS pages FROM p GROUP BY 1""")
def _(t):
    html = F.expr("""concat(html,'<script>load("/js/v',cast(page_id%5 as string),'/m',cast(page_id%17 as string),'.js");get("/api/x")</script>')""")
    return D.script_paths(t.pages.withColumn("html", html), "page_id", "html")


@query("d35_page_checks", f"""SELECT {HOST} AS host, count(*) AS pages, count(*) FILTER (NOT regexp_matches(html,'(?is)<title>.+?</title>')) AS no_title,
 count(*) FILTER (NOT regexp_matches(html,'(?i)<meta charset=')) AS no_charset, count(*) FILTER (NOT regexp_matches(html,'(?i)<html lang=')) AS no_lang,
 count(*) FILTER (length(html)>5000) AS too_long, count(*) FILTER (len(regexp_extract_all(html,'(?i)<h1[ >]'))<>1) AS not_one_h1 FROM pages GROUP BY 1""")
def _(t):
    return D.page_checks(t.pages, "url", "html", 5000)


@query("d36_traffic_log_timeline", """SELECT host, ip_id, event_id, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS seq FROM v_dns""")
def _(t):
    return D.traffic_log_timeline(t.v_dns, "host", ["ts", "event_id"]).select("host", "ip_id", "event_id", "seq")

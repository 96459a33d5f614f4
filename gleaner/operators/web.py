"""URLs, pages, domains and network tables already held."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import webcols as U
from gleaner.functions.rows import each, each_at
from gleaner.operators.graph import connected_components
from gleaner.operators.stats import latest, session_measures, sessionise
from gleaner.plans.forest import ancestor_rows, resolve_parents
from gleaner.plans.scale import (
    cut_lineage,
    as_of_join,
    lag_within,
    running_sum_within,
    sized_chunks,
    value_ranks,
)


def parse_url_columns(df: DataFrame, url: str) -> DataFrame:
    """Add scheme, host, path, query and fragment."""
    parts = {"scheme": "PROTOCOL", "host": "HOST", "path": "PATH", "query": "QUERY", "fragment": "REF"}
    return df.select("*", *[F.try_parse_url(url, F.lit(p)).alias(n) for n, p in parts.items()])


def canonicalise_url(df: DataFrame, key: str, url: str) -> DataFrame:
    """One row per canonical URL with the first key and the number of spellings."""
    return df.groupBy(U.canonical_url(F.col(url)).alias("canonical")).agg(
        F.min(key).alias("first"), F.count_distinct(url).alias("spellings")
    )


def registered_domain(hosts: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Split hosts into subdomain, domain and public suffix.

    The longest rule of ``suffixes`` counts: a suffix, ``*.suffix`` for any label before
    one, or ``!name`` for an exception to such a rule. Hosts that no rule covers take
    their last label.
    """
    kinds = hosts.select(host).where(F.col(host).isNotNull()).distinct()
    tails = kinds.select(host, F.explode(U.host_suffixes(F.col(host))).alias("_tail"))
    parent = F.regexp_extract("_tail", r"^[^.]*\.(.*)$", 1)
    tail = F.col("_tail")
    forms = ((tail, tail, 0), (F.concat(F.lit("*."), parent), tail, 0), (F.concat(F.lit("!"), tail), parent, 1))
    asked = tails.select(host, F.inline(F.array(*[
        F.struct(rule.alias("rule"), suffix.alias("suffix"), F.lit(exception).alias("_exception"))
        for rule, suffix, exception in forms])))
    ruled = (
        asked.join(suffixes.select(F.col("suffix").alias("rule")).distinct(), "rule")
        .groupBy(host)
        .agg(F.max_by("suffix", F.struct("_exception", F.length("suffix"))).alias("suffix"))
    )
    best = kinds.join(ruled, host, "left").select(
        host, F.coalesce("suffix", F.substring_index(host, ".", -1)).alias("suffix"))
    head = F.when(
        F.length(host) > F.length("suffix"),
        F.substr(F.col(host), F.lit(1), F.length(host) - F.length("suffix") - 1),
    )
    label = F.substring_index(head, ".", -1)
    return best.select(
        host,
        "suffix",
        F.concat_ws(".", label, "suffix").alias("domain"),
        F.substr(head, F.lit(1), F.greatest(F.length(head) - F.length(label) - 1, F.lit(0))).alias("subdomain"),
    )


def registrations_per_tld_day(df: DataFrame, domain: str, tld: str, day: str) -> DataFrame:
    """New domains per TLD and day; days without any are zero."""
    first = df.groupBy(domain, tld).agg(F.min(day).alias("day"))
    counted = first.groupBy(tld, "day").agg(F.count("*").alias("n"))
    bounds = counted.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar())
    grid = counted.select(tld).distinct().select(tld, F.explode(days).alias("day"))
    return grid.join(counted, [tld, "day"], "left").fillna(0, ["n"])


def extract_links(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Links with anchor text, then images (``kind``), with targets resolved on the page URL."""
    links = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(U.LINK), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(U.LINK), F.lit(2)).alias("anchor"),
    )
    images = F.regexp_extract_all(html, F.lit(U.IMAGE), F.lit(1))
    found = F.concat(
        F.transform(links, lambda x: F.struct(x["href"].alias("href"), x["anchor"].alias("anchor"), F.lit("link").alias("kind"))),
        F.transform(images, lambda x: F.struct(x.alias("href"), F.lit("").alias("anchor"), F.lit("image").alias("kind"))),
    )
    rows = each_at(df, [key, url], found, "at", "_l")
    target = U.resolve_url(F.col(url), F.btrim("_l.href", F.lit("\"'")))
    return rows.select(key, "at", F.col(url).alias("page_url"), target.alias("target"),
                       F.col("_l.anchor").alias("anchor"), F.col("_l.kind").alias("kind"))


def backlink_counts(links: DataFrame, target: str, page: str, host: str) -> DataFrame:
    """Distinct pages and hosts that link to each target."""
    return links.groupBy(target).agg(
        F.count_distinct(page).alias("pages"), F.count_distinct(host).alias("hosts")
    )


def domain_call_tree(links: DataFrame, src: str, dst: str, root=None) -> DataFrame:
    """(node, root, depth, parents): every node that ``src`` names, once, with its least depth below a root.

    ``src`` is loaded by ``dst``; a node may have several parents, which are counted. Without ``root`` the
    roots are the nodes that nothing loads; of several at one depth the smallest counts. Nodes that no
    root reaches, such as loops of their own, are left out. Levels are found one after the other: only
    the newest level is joined with the links, and a level is written once and not touched again.
    """
    edges = links.select(F.col(src).alias("node"), F.col(dst).alias("parent")).where("node IS NOT NULL AND parent IS NOT NULL").distinct()
    edges = cut_lineage(edges)
    if root is None:
        front = edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    else:
        front = edges.limit(1).select(F.lit(root).cast(edges.schema["node"].dataType).alias("node"))
    front = cut_lineage(front.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth")))
    levels = [front]
    while True:
        nxt = edges.join(front.withColumnsRenamed({"node": "parent"}), "parent").groupBy("node").agg(
            F.min("root").alias("root"), (F.min("depth") + 1).alias("depth"))
        for level in levels:
            nxt = nxt.join(level.select("node"), "node", "left_anti")
        front = cut_lineage(nxt)
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) > 16:  # older levels as one table, so that plans stay short
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
    parents = edges.groupBy("node").agg(F.count("*").alias("parents"))
    return reduce(DataFrame.unionByName, levels).where("depth > 0").join(parents, "node")


def redirect_chain(hops: DataFrame, src: str, dst: str) -> DataFrame:
    """Final target and length for every start, and a flag where the chain loops."""
    out = resolve_parents(hops, [], src, dst)
    return out.select(
        src, F.coalesce("root", F.lit(-1)).alias("final"),
        F.coalesce("depth", F.lit(-1)).alias("length"), F.col("on_loop").alias("loops"),
    )


def redirect_hops(hops: DataFrame, src: str, dst: str) -> DataFrame:
    """Every hop of every chain that ends: start, number of the hop, place reached."""
    ends = resolve_parents(hops, [], src, dst).where(~F.col("on_loop")).select(src)
    return ancestor_rows(hops.join(ends, src, "left_semi"), src, dst)


def insecure_links(pages: DataFrame, url: str, target: Column) -> DataFrame:
    """Pages on, or linking to, plain http by host, with share."""
    on = F.col(url).startswith("http://")
    to = target.startswith("http://")
    return pages.groupBy(U.host_of(F.col(url)).alias("host")).agg(
        F.count("*").alias("links"), F.count_if(on).alias("on_http"), F.count_if(to).alias("to_http"),
        (F.count_if(on | to) / F.count("*")).alias("share"),
    )


def broken_links(links: DataFrame, statuses: DataFrame, url: str, day: str, status: str) -> DataFrame:
    """Links whose latest known status is an error, or that have none."""
    last = statuses.groupBy(url).agg(F.max_by(status, day).alias("status"))
    joined = links.join(last, url, "left").fillna(0, ["status"])
    return joined.where((F.col("status") == 0) | (F.col("status") >= 400))


def detect_technologies(df: DataFrame, key: str, html: str, rules: dict[str, str]) -> DataFrame:
    """Technologies per page by signature; rules are column tests, so nothing is joined."""
    found = F.array_compact(
        F.array(*[F.when(F.col(html).rlike(p), F.lit(name)) for name, p in rules.items()])
    )
    return each(df, [key], found, "technology")


def outdated_libraries(found: DataFrame, advisories: DataFrame, key: str) -> DataFrame:
    """Found versions inside a known-bad range, with the number of advisories.

    Each (library, version) is tested once, whatever number of pages uses it.
    """
    kinds = found.select("library", "version").distinct().withColumn("v", U.version_number(F.col("version")))
    bad = (
        kinds.join(advisories, "library")
        .where(
            (F.col("v") >= U.version_number(F.col("first_bad")))
            & (F.col("v") <= U.version_number(F.col("last_bad")))
        )
        .groupBy("library", "version")
        .agg(F.count("*").alias("advisories"))
    )
    return found.join(bad, ["library", "version"]).select(key, "library", "version", "advisories")


def structured_metadata(df: DataFrame, key: str, html: str) -> DataFrame:
    """Title, language, charset, meta tags as a map, and embedded JSON-LD as a variant.

    Of meta tags with one name the first counts.
    """
    meta = r"(?i)<meta name=\"([^\"]+)\" content=\"([^\"]*)\""
    names = F.regexp_extract_all(html, F.lit(meta), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(meta), F.lit(2))
    ld = F.regexp_extract(html, r"(?is)<script type=\"application/ld\+json\">(.*?)</script>", 1)
    return df.select(
        key,
        F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, r"(?i)<html lang=\"([^\"]*)\"", 1).alias("lang"),
        F.regexp_extract(html, r"(?i)<meta charset=\"([^\"]*)\"", 1).alias("charset"),
        F.map_from_entries(F.filter(
            F.arrays_zip(names.alias("k"), values.alias("v")),
            lambda p, i: F.array_position(names, p["k"]) == i + 1)).alias("meta"),
        F.try_parse_json(ld).alias("ld"),
    )


def classify_cloud_links(links: DataFrame, page: str, url: str, providers: dict[str, str]) -> DataFrame:
    """Links to cloud storage by provider, told by host suffix."""
    host = U.host_of(F.col(url))
    provider = F.coalesce(
        *[F.when(host.endswith(suffix), F.lit(name)) for name, suffix in providers.items()], F.lit("other")
    )
    return links.groupBy(provider.alias("provider")).agg(
        F.count("*").alias("links"), F.count_distinct(page).alias("pages")
    )


def shared_tracker_groups(df: DataFrame, site: str, tracker: str) -> DataFrame:
    """Sites joined through shared tracker ids: group label and size.

    Sites and trackers form one two-sided graph, so a tracker on very many sites
    adds one edge per site and never one per pair of sites.
    """
    edges = df.select(
        F.concat(F.lit("s:"), F.col(site)).alias("a"),
        F.concat(F.lit("t:"), F.col(tracker).cast("string")).alias("b"),
    ).distinct()
    comp = connected_components(edges, "a", "b").where(F.col("node").startswith("s:"))
    sized = comp.groupBy("component").agg(F.count("*").alias("sites"))
    return comp.join(sized, "component").select(
        F.substr("node", F.lit(3)).alias("site"), F.substr("component", F.lit(3)).alias("group"), "sites"
    )


def lookalike_domains(hosts: DataFrame, host: str, brands: DataFrame, brand: str, edits: int) -> DataFrame:
    """Host labels within ``edits`` changes of a protected name after look-alike folding.

    Protected names are cut into ``edits`` + 1 pieces, one of which a near label must hold, so only
    labels that share a piece at about its place ever meet.
    """
    left = hosts.select(host).distinct().select(
        host, U.fold_lookalikes(F.col(host)).alias("_h"))
    left = each(left, [host, "_h"], U.probes(F.col("_h"), edits), "_k")
    right = brands.select(brand).distinct().select(
        brand, U.fold_lookalikes(F.col(brand)).alias("_b"))
    right = each(right, [brand, "_b"], U.segments(F.col("_b"), edits), "_k")
    d = F.levenshtein("_h", "_b", edits)
    near = left.join(right, "_k").where(F.col(host) != F.col(brand)).select(host, brand, d.alias("distance"))
    return near.where("distance >= 0").distinct()


def blocklist_match(df: DataFrame, key: str, host: str, feed: DataFrame, entry: str) -> DataFrame:
    """Rows whose host or a parent domain of it is on the feed."""
    tails = each(df, [key, host], U.host_suffixes(F.col(host)), entry)
    return tails.join(feed.select(entry), entry, "left_semi").select(key, host).distinct()


def page_fingerprint(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Digests of page content with the number of pages sharing them."""
    return df.groupBy(
        F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256")
    ).agg(F.count("*").alias("pages"), F.min(key).alias("first"))


def host_neighbours(dns: DataFrame, host: str, ip: str) -> DataFrame:
    """Each host on each address with how many hosts share it."""
    pairs = dns.groupBy(ip, host).agg(F.count("*").alias("seen"))
    shared = pairs.groupBy(ip).agg((F.count("*") - 1).alias("neighbours"))
    return pairs.join(shared, ip)


def dns_history(obs: DataFrame, host: str, order: list[str], value: str) -> DataFrame:
    """Sightings merged to validity intervals of one value each."""
    day = F.col("_part")
    seq = lag_within(sized_chunks(obs, [host], order, F.to_date(order[0])), [host], order, [value], day)
    change = F.when(F.col(f"prev_{value}").eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = running_sum_within(seq, [host], order, change, "_run", day)
    return runs.groupBy(host, "_run", value).agg(
        F.min(order[0]).alias("valid_from"), F.max(order[0]).alias("last_seen"), F.count("*").alias("sightings")
    ).drop("_run")


def value_as_of(history: DataFrame, host: str, value: str, at: Column) -> DataFrame:
    """The value each host had at a time."""
    return (
        history.where(F.col("valid_from") <= at)
        .groupBy(host)
        .agg(F.max_by(value, "valid_from").alias(value), F.max("valid_from").alias("valid_from"))
    )


def expiring_domains(df: DataFrame, expires: str, today: Column, days: int) -> DataFrame:
    """Registrations that end within ``days`` or ended in the last ``days``."""
    left = F.date_diff(F.col(expires), today)
    return df.withColumn("days_left", left).where(F.abs("days_left") <= days)


def registry_search(df: DataFrame, name: str, tld: str, terms: list[str]) -> DataFrame:
    """Registry names holding a keyword, with the number of zones they are registered in."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(F.col(name), F.lit(term))
    return df.where(hit).groupBy(name).agg(
        F.count_distinct(tld).alias("zones"), F.min(tld).alias("first_zone"), F.count("*").alias("rows")
    )


def ip_prefix_lookup(ips: DataFrame, ip: str, nets: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """Most specific network of each distinct address (a number); null for an address in none.

    Networks are cut into aligned blocks and an address asks for its block at
    every size in use: equal keys only, so crowded address space costs no more.
    """
    blocks = nets.select(name, (F.col(hi) - F.col(lo)).alias("_width"),
                         F.inline(U.aligned_blocks(F.col(lo), F.col(hi))))
    sizes = blocks.agg(F.array_sort(F.collect_set("bits"))).scalar()  # at most 33 sizes
    asked = ips.select(ip).where(F.col(ip).isNotNull()).distinct().select(ip, F.explode_outer(sizes).alias("bits"))
    keyed = asked.withColumn("prefix", F.floor(F.col(ip) / F.pow(F.lit(2.0), "bits")).cast("bigint"))
    return (
        keyed.join(blocks, ["prefix", "bits"], "left")
        .groupBy(ip)
        .agg(F.min(F.when(F.col("_width").isNotNull(), F.struct("_width", name))).alias("_b"))
        .select(ip, F.col(f"_b.{name}").alias(name))
    )


def cidr_lookup(df: DataFrame, ip: str, nets: DataFrame, cidr: str, owner: str) -> DataFrame:
    """(ip, owner, prefix_len, found) of every distinct address text, IPv4 or IPv6, in networks such as `2001:db8::/32`.

    Addresses are 128 bits wide, IPv4 as the block ::ffff:0:0/96, in which ``prefix_len`` counts from
    96 on. An address asks for its prefix of every length in use, at most 129, by equal keys; the longest
    that is listed wins, of equal networks the first owner by name. An address that no network holds, or
    that is none, has a null owner and ``found`` false; a null one is not asked; networks that are none
    hold nothing.
    """
    at = F.substring_index(cidr, "/", 1)
    v4 = F.when(F.contains(F.col(cidr), F.lit(":")), 0).otherwise(96)
    length = F.when(F.contains(F.col(cidr), F.lit("/")), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(128 - v4) + v4
    listed = nets.select(U.address_hex(at).alias("_x"), length.alias("_n"), F.col(owner).alias(owner)).where(
        F.col("_x").isNotNull() & F.col("_n").between(0, 128))
    listed = listed.groupBy("_n", U.address_prefix(F.col("_x"), F.col("_n")).alias("_k")).agg(F.min(owner).alias(owner))
    sizes = listed.agg(F.collect_set("_n")).scalar()
    asked = df.select(ip).where(F.col(ip).isNotNull()).distinct().select(ip, U.address_hex(F.col(ip)).alias("_x"))
    keyed = asked.select(ip, "_x", F.explode_outer(sizes).alias("_n")).select(ip, "_n", U.address_prefix(F.col("_x"), F.col("_n")).alias("_k"))
    best = F.max(F.when(F.col(owner).isNotNull(), F.struct("_n", owner))).alias("_b")
    return keyed.join(listed, ["_n", "_k"], "left").groupBy(ip).agg(best).select(
        ip, F.col(f"_b.{owner}").alias(owner), F.col("_b._n").alias("prefix_len"), F.col("_b").isNotNull().alias("found"))


def ip_geo_counts(ips: DataFrame, ip: str, nets: DataFrame, lo: str, hi: str, place: str) -> DataFrame:
    """Addresses per country after lookup; a null place counts those in no network."""
    found = ip_prefix_lookup(ips, ip, nets, lo, hi, place)
    return found.groupBy(place).agg(F.count("*").alias("addresses"))


def robots_rules(lines: DataFrame, host: str, no: str, line: str) -> DataFrame:
    """Allowed and disallowed paths per agent from stored robots lines.

    Agent lines in a row share the rules that follow; what comes after ``#`` is no part of a line.
    """
    plain = F.regexp_replace(line, r"#.*$", "")
    kind = F.lower(F.trim(F.substring_index(plain, ":", 1)))
    value = F.trim(F.regexp_extract(plain, r"^[^:]*:(.*)$", 1))
    parsed = lines.select(host, no, kind.alias("kind"), value.alias("value")).where(
        F.col("kind").isin("user-agent", "allow", "disallow"))
    chunk = F.col("_part")
    seq = lag_within(sized_chunks(parsed, [host], [no], F.floor(F.col(no) / 1000)), [host], [no], ["kind"], chunk)
    is_agent = F.col("kind") == "user-agent"
    starts = F.when(is_agent & ~F.col("prev_kind").eqNullSafe("user-agent"), 1).otherwise(0)
    run = running_sum_within(seq, [host], [no], starts, "_group", chunk)
    agents = run.where(is_agent).select(host, "_group", F.col("value").alias("agent"))
    rules = run.where(~is_agent).select(host, "_group", F.col("kind").alias("rule"), F.col("value").alias("path"))
    return rules.join(agents, [host, "_group"]).select(host, "agent", "rule", "path")


def cookie_attributes(df: DataFrame, group: str, header: str, long_age: int) -> DataFrame:
    """Risk counts of stored cookie headers by group; of a repeated attribute the last counts."""
    pairs = F.transform(F.split(F.lower(F.col(header)), "; *"), lambda x: F.struct(
        F.substring_index(x, "=", 1).alias("k"),
        F.when(x.contains("="), F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    attrs = F.map_from_entries(last)
    rows = df.select(group, attrs.alias("a"))
    age = F.try_element_at("a", F.lit("max-age")).try_cast("bigint")
    return rows.groupBy(group).agg(
        F.count("*").alias("cookies"),
        F.count_if(~F.map_contains_key("a", F.lit("secure"))).alias("not_secure"),
        F.count_if(~F.map_contains_key("a", F.lit("httponly"))).alias("script_readable"),
        F.count_if(age > long_age).alias("long_lived"),
        F.count_if(age.isNull()).alias("session_only"),
    )


def snapshot_as_of(captures: DataFrame, url: str, on: str, cols: list[str], at: Column) -> DataFrame:
    """Last capture of each URL at or before a time."""
    return (
        captures.where(F.col(on) <= at)
        .groupBy(url)
        .agg(F.max_by(F.struct(on, *cols), on).alias("_c"))
        .select(url, "_c.*")
    )


def snapshots_for(requests: DataFrame, captures: DataFrame, url: str, asked: str, on: str, cols: list[str]) -> DataFrame:
    """Last capture at or before each of many asked times."""
    return as_of_join(requests, captures, [url], asked, on, cols, grain="month")


def snapshot_changes(captures: DataFrame, url: str, on: str, digest: str) -> DataFrame:
    """Captures that differ from the one before."""
    parts = sized_chunks(captures, [url], [on], F.date_trunc("month", F.col(on)))
    seq = lag_within(parts, [url], [on], [digest, on], F.col("_part")).drop("_part")
    return seq.where(F.col(f"prev_{digest}").isNotNull() & (F.col(f"prev_{digest}") != F.col(digest)))


def extract_records(df: DataFrame, key: str, html: str, rules: dict[str, str]) -> DataFrame:
    """Pages to rows by a rule table of field and pattern."""
    return df.select(key, *[F.regexp_extract(html, p, 1).alias(f) for f, p in rules.items()])


def site_traffic(visits: DataFrame, visitor: str, site: str, order: list[str], gap_s: int) -> DataFrame:
    """Visits, visitors, mean duration and pages per visit by site and day of start."""
    rows = visits.select(visitor, site, *order)
    s = session_measures(sessionise(rows, [visitor, site], order, gap_s), [visitor, site], order[0])
    return s.groupBy(site, F.to_date("started").alias("day")).agg(
        F.count("*").alias("visits"),
        F.count_distinct(visitor).alias("visitors"),
        F.avg("seconds").alias("mean_seconds"),
        F.avg("hits").alias("pages_per_visit"),
    )


def traffic_sources(visits: DataFrame, source: str, keyword: Column) -> DataFrame:
    """Share of all visits by source and keyword."""
    total = visits.agg(F.count("*")).scalar()
    return visits.groupBy(source, keyword.alias("keyword")).agg(
        F.count("*").alias("visits"), (F.count("*") / F.max(total)).alias("share")
    )


def site_rank(visits: DataFrame, site: Column) -> DataFrame:
    """Sites ranked by traffic with percentile; the ranking is range-partitioned."""
    counted = visits.groupBy(site.alias("site")).agg((-F.count("*")).alias("_neg"))
    r = value_ranks(counted, [], "_neg")
    pct = F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0)
    return counted.join(r, "_neg").select(
        "site", (-F.col("_neg")).alias("visits"), (F.col("distinct_before") + 1).alias("rank"), pct.alias("percentile")
    )


def visits_last_n_days(history: DataFrame, site: Column, ts: str, spans: list[int]) -> DataFrame:
    """Visits per site in the last n days for several n, in one pass."""
    age = F.date_diff(F.to_date(latest(history, ts)), F.to_date(ts))
    return history.select(site.alias("site"), age.alias("_age")).groupBy("site").agg(
        *[F.count_if(F.col("_age") < n).alias(f"last_{n}") for n in spans]
    )


def script_paths(df: DataFrame, key: str, html: str) -> DataFrame:
    """Distinct paths named in page scripts, by directory."""
    code = F.array_join(F.regexp_extract_all(html, F.lit(U.SCRIPT), F.lit(1)), "\n")
    paths = each(df, [key], F.regexp_extract_all(code, F.lit(r"\"(/[A-Za-z0-9_./-]+)\""), F.lit(1)), "path")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    return paths.groupBy(folder.alias("folder")).agg(
        F.count_distinct("path").alias("paths"), F.count_distinct(key).alias("pages"))


def page_checks(df: DataFrame, url: str, html: str, max_chars: int) -> DataFrame:
    """Rule results by host: pages failing title, charset, language, size and heading rules."""
    h = F.col(html)
    return df.groupBy(U.host_of(F.col(url)).alias("host")).agg(
        F.count("*").alias("pages"),
        F.count_if(~h.rlike(r"(?is)<title>.+?</title>")).alias("no_title"),
        F.count_if(~h.rlike(r"(?i)<meta charset=")).alias("no_charset"),
        F.count_if(~h.rlike(r"(?i)<html lang=")).alias("no_lang"),
        F.count_if(F.length(h) > max_chars).alias("too_long"),
        F.count_if(F.regexp_count(h, F.lit(r"(?i)<h1[ >]")) != 1).alias("not_one_h1"),
    )


def traffic_log_timeline(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Log rows numbered in time order per key, counted chunk by chunk."""
    parts = sized_chunks(log, [key], order, F.to_date(order[0]))
    return running_sum_within(parts, [key], order, F.lit(1), "seq", F.col("_part")).drop("_part")

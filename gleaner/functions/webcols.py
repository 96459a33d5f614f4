"""Column expressions over URLs, hosts, addresses and page source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, and look-alike letters.
TRACKING = r"([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
LOOKALIKE = ("013457$@", "oleastsa")
LINK = r"(?is)<a\s(?:[^>]*\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>(.*?)</a>"
IMAGE = r"(?is)<img\s(?:[^>]*\s)?src\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>"
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"


def host_of(url: Column) -> Column:
    """Host name in lower case, or null."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def canonical_url(url: Column) -> Column:
    """URL without fragment, tracking parameters and trailing slash."""
    c = F.regexp_replace(url, r"#.*$", "")
    c = F.regexp_replace(c, TRACKING, "$1")
    c = F.regexp_replace(c, r"([?&])&+", "$1")
    c = F.regexp_replace(c, r"[?&]+$", "")
    return F.regexp_replace(c, r"/+$", "")


def resolve_url(page: Column, href: Column) -> Column:
    """Target of a link on ``page``: absolute, or relative to its scheme, host, address or folder."""
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(page, r"^https?://[^/?#]+/((?:[^?#]*/)?)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    whole = F.regexp_replace(F.concat(folder, path), r"(^|/)(\.\.?)$", "$1$2/")
    steps = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(page, r"^([^?#]*)", 1), href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(page, r"^([^#]*)", 1), href))
        .otherwise(F.concat(origin, F.lit("/"), F.array_join(steps, "/"), F.substr(href, F.length(path) + 1)))
    )


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )


def fold_lookalikes(name: Column) -> Column:
    """Name with look-alike characters replaced by the letter they imitate."""
    return F.replace(F.translate(F.lower(name), *LOOKALIKE), F.lit("rn"), F.lit("m"))


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 address as a number; null when a part is over 255."""
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("bigint"))
    bad = F.exists(p, lambda x: x.isNull() | (x > 255)) | (F.size(p) != 4)
    value = F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    return F.when(~bad, value)


def address_hex(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hexadecimal digits (IPv4 behind ffff), or null if it is none."""
    v4 = F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0"))
    tail = F.regexp_extract(ip, r"^.*:([0-9]+\.[0-9.]+)$", 1)  # the last 32 bits may be written as IPv4
    low = F.lpad(F.lower(F.hex(ipv4_number(tail))), 8, "0")
    text = F.lower(F.when(tail == "", ip).otherwise(F.concat(
        F.substr(ip, F.lit(1), F.length(ip) - F.length(tail)), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4))))
    halves = F.split(text, "::")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    gap = 8 - F.size(left) - F.size(right)
    fits = F.when(F.size(halves) == 2, gap >= 1).otherwise((F.size(halves) == 1) & (gap == 0))
    clean = text.rlike(r"^[0-9a-f:]+$") & ~text.rlike(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$") & fits
    padded = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    v6 = F.concat(padded(left), F.repeat(F.lit("0000"), F.greatest(gap, F.lit(0))), padded(right))
    return F.when(F.contains(ip, F.lit(":")), F.when(clean, v6)).otherwise(v4)


def address_prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address in hexadecimal digits, as a key."""
    whole, more = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    part = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.floor(part / F.pow(F.lit(2.0), 4 - more)).cast("string")
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(more == 0, "").otherwise(F.concat(F.lit("/"), rest)))


def aligned_blocks(lo: Column, hi: Column) -> Column:
    """Power-of-two blocks (prefix, bits) that make up the number range lo to hi."""
    empty = F.array().cast("array<struct<prefix:bigint,bits:int>>")
    start = F.struct(lo.cast("bigint").alias("at"), empty.alias("blocks"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        low = F.when(at == 0, F.lit(32)).otherwise(
            F.length(F.bin(at.bitwiseAND(-at))) - 1
        )
        bits = F.least(low, F.length(F.bin(hi - at + 1)) - 1)
        block = F.struct(
            F.floor(at / F.pow(F.lit(2.0), bits)).cast("bigint").alias("prefix"),
            bits.cast("int").alias("bits"),
        )
        more = F.struct(
            (at + F.pow(F.lit(2.0), bits).cast("bigint")).alias("at"),
            F.concat(acc["blocks"], F.array(block)).alias("blocks"),
        )
        return F.when(at <= hi, more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda acc: acc["blocks"])


def version_number(version: Column) -> Column:
    """All parts of a dotted version as whole numbers, without zeros at the end, for comparison.

    A part that is no number counts as 0, and so does a null version. A leading v is no part, nor is
    what follows a plus sign. What follows a hyphen marks a version before the plain one: its
    parts compare as numbers, or else as text above any number.
    """
    none = F.array().cast("array<string>")
    bare = F.regexp_replace(version, r"^\s*[vV](?=[0-9])|\+.*$", "")
    before = F.regexp_extract(bare, r"-(.*)$", 1)
    parts = F.transform(F.coalesce(F.split(F.regexp_replace(bare, "-.*$", ""), r"\."), none), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    zeros = F.array_position(F.transform(F.reverse(parts), lambda x: x != 0), True)  # place of the last other part
    main = F.slice(parts, 1, F.when(zeros == 0, 0).otherwise(F.size(parts) - zeros + 1).cast("int"))
    one = lambda x: F.when(x.rlike("^[0-9]{1,18}$"), F.array(F.lit(0).cast("bigint"), x.try_cast("bigint"))).otherwise(
        F.concat(F.array(F.lit(1).cast("bigint")), F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")),
                 F.array(F.lit(0).cast("bigint"))))
    early = F.concat(F.array(F.lit(-1).cast("bigint")), F.flatten(F.transform(F.split(before, r"\."), one)))
    return F.concat(main, F.when(F.coalesce(before, F.lit("")) == "", F.array(F.lit(0).cast("bigint"))).otherwise(early))


def _piece(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """Start and size of piece ``i`` of a string cut into ``edits`` + 1 pieces of near equal size."""
    cut = lambda j: F.floor(length * j / (edits + 1)).cast("int")
    return cut(i), cut(i + 1) - cut(i)


def segments(name: Column, edits: int) -> Column:
    """The ``edits`` + 1 pieces a name is cut into, each with the length of the name and its number.

    Pass a plain column. Of a name within ``edits`` changes, ``probes`` holds at least one of them: fewer
    changes than pieces leave one piece as it is, moved by ``edits`` places at most.
    """
    def piece(i: Column) -> Column:
        at, size = _piece(F.length(name), i, edits)
        return F.struct(F.length(name).alias("length"), i.alias("i"), F.substr(name, at + 1, size).alias("piece"))

    return F.transform(F.array(*[F.lit(i) for i in range(edits + 1)]), piece)


def probes(name: Column, edits: int) -> Column:
    """The pieces that names of every length within ``edits`` changes may share with this one.

    Their number depends on ``edits`` alone, not on the length of the name: (2 ``edits`` + 1)^2 (``edits`` + 1).
    """
    span = range(-edits, edits + 1)
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(m).alias("m"))
                      for d in span for i in range(edits + 1) for m in span])

    def piece(s: Column) -> Column:
        length = F.length(name) + s["d"]
        start, size = _piece(length, s["i"], edits)
        at = start + s["m"]
        fits = (length >= 0) & (at >= 0) & (at + size <= F.length(name))
        return F.when(fits, F.struct(length.alias("length"), s["i"].alias("i"), F.substr(name, at + 1, size).alias("piece")))

    return F.array_distinct(F.filter(F.transform(steps, piece), lambda x: x.isNotNull()))

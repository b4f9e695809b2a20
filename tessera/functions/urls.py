"""Web addresses in the form that the URL standard gives them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stays of each part unescaped is all but controls, text beyond ASCII and these.
_PATH, _QUERY, _FRAGMENT = r""" "#<>?^`{}""", r""" "#<>'""", r""" "<>`"""
_FORBIDDEN_HOST = r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]"


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(x), use), 1)


def _escaped(c: Column, also: str) -> Column:
    """Percent signs and hex for what a part may not hold; escapes that stand there stay."""
    bad = r"[\x00-\x1f\x7f-\x{10FFFF}" + "".join(f"\\x{ord(x):02x}" for x in also) + "]"
    one = lambda x: F.when(x.rlike(bad), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    return F.when(c.rlike(bad), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), 0), one), "")).otherwise(c)


def _path(raw: Column) -> Column:
    """Segments without single dots, each double dot taking the one before it."""
    parts = F.split(F.regexp_replace(raw, r"^[/\\]", ""), r"[/\\]", -1)
    start = F.array().cast("array<string>")
    size = F.size(parts)
    numbered = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == size - 1).alias("last")))

    def step(a: Column, x: Column) -> Column:
        dots = F.regexp_replace(F.lower(x["s"]), "%2e", ".")
        end = F.when(x["last"], F.array(F.lit(""))).otherwise(start)
        return F.when(dots == "..", F.concat(F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a), end)).when(dots == ".", F.concat(a, end)).otherwise(F.concat(a, F.array(x["s"])))

    return F.concat(F.lit("/"), _escaped(F.array_join(F.aggregate(numbered, start, step), "/"), _PATH))


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal after 0, hex after 0x; null for other texts."""
    hexes = F.coalesce(F.conv(F.nullif(F.substr(part, F.lit(3)), F.lit("")), 16, 10), F.lit("0"))
    return F.when(part.rlike("^0[xX][0-9a-fA-F]{0,12}$"), hexes).when(part.rlike("^0[0-7]{0,15}$"), F.conv(part, 8, 10)).when(part.rlike("^[1-9][0-9]{0,14}$"), part).cast("decimal(20,0)").cast("long")


def _ipv4(host: Column) -> Column:
    """Four numbers of an address of one to four, the last of which fills what is left; null if it is none."""
    bare = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)
    numbers = F.transform(bare, _number)
    n = F.size(numbers)
    last = F.element_at(numbers, -1)
    head = F.aggregate(F.slice(numbers, 1, n - 1), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    rest = F.pow(F.lit(256.0), 5 - n).cast("long")
    good = (n <= 4) & F.forall(F.slice(numbers, 1, n - 1), lambda x: x <= 255) & (last < rest)
    whole = head * rest + last
    shown = F.concat_ws(".", *[F.floor(whole / F.lit(256**k)).cast("long").bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.coalesce(good, F.lit(False)), shown)


def _ipv6(inner: Column) -> Column:
    """Eight pieces of hex with the first of the longest runs of zeros left out, in brackets; null if it is none."""
    looks = inner.rlike("^[0-9a-fA-F:.]{2,45}$") & inner.contains(":")  # so that no name is ever looked up
    said = F.regexp_replace(F.try_reflect(F.lit("java.net.InetAddress"), F.lit("getByName"), F.when(looks, inner).otherwise("::")), "^.*/", "")
    four = F.transform(F.split(said, r"\."), lambda x: x.cast("long"))
    pair = lambda a, b: F.lower(F.hex(four[a] * 256 + four[b]))
    pieces = F.when(said.rlike(r"^[0-9.]+$"), F.concat(F.lit("0:0:0:0:0:ffff:"), pair(0, 1), F.lit(":"), pair(2, 3))).otherwise(F.regexp_replace(said, "%.*$", ""))

    def short(p: Column) -> Column:
        out = p
        for k in range(2, 9):
            run = rf"^(.*?)(?:^|(?<=:)|:)0(?::0){{{k - 1}}}(?::|$)"
            out = F.when(p.rlike(rf"(?:^|:)0(?::0){{{k - 1}}}(?:$|:)"), F.regexp_replace(p, run, "$1::")).otherwise(out)
        return F.regexp_replace(out, ":{3,}", "::")

    return F.when(looks & said.isNotNull(), F.concat(F.lit("["), _bound(pieces, short), F.lit("]")))


def _host(raw: Column) -> Column:
    """A name in ASCII and lower case, or an address; null for what a host may not hold."""
    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    plain = F.regexp_replace(F.translate(decoded, "。．｡", "..."), "\u00ad", "")
    name = F.lower(F.when(plain.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.lower(plain))))

    def told(h: Column) -> Column:
        numeric = F.regexp_replace(h, r"\.$", "").rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$")
        return F.when(h.isNull() | (h == "") | h.rlike(_FORBIDDEN_HOST), None).when(numeric, _ipv4(h)).otherwise(h)

    return F.when(raw.rlike(r"^\[.*\]$"), _ipv6(F.regexp_extract(raw, r"^\[(.*)\]$", 1))).otherwise(_bound(name, told))


def web_address(c: Column) -> Column:
    """An http or https address as the URL standard writes it; null for other schemes, credentials and what is no address.

    White space around it and line ends within it go; backslashes count as slashes. Scheme and host are in lower case, the host in ASCII,
    numbers as IPv4 and IPv6 addresses in their short forms; a default port goes, one above 65,535 is no address. Dot segments are
    resolved, and what a part may not hold is escaped. Names follow the older IDNA rules of the Java platform.
    """
    url = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    shape = r"(?is)^(https?):[/\\]*(?:([^/\\?#]*)@)?(\[[^\]/\\?#@]*\]|[^/\\?#@:]*)(?::([^/\\?#@:]*))?([/\\][^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"
    parts = F.regexp_extract_all(url, F.lit(shape), 0)
    get = lambda k: F.regexp_extract(url, shape, k)
    scheme, user, port = F.lower(get(1)), get(2), get(4)
    number = F.when(port.rlike("^0*[0-9]{1,5}$"), port.cast("long"))
    bad_port = (port != "") & (number.isNull() | (number > 65_535))
    default = F.when(scheme == "http", 80).otherwise(443)
    shown_port = F.when(number.isNotNull() & (number != default), F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    path = F.when(get(5) == "", "/").otherwise(_path(get(5)))
    before = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    query = F.when(before.contains("?"), F.concat(F.lit("?"), _escaped(get(6), _QUERY))).otherwise("")
    fragment = F.when(url.contains("#"), F.concat(F.lit("#"), _escaped(get(7), _FRAGMENT))).otherwise("")
    good = (F.size(parts) > 0) & ~bad_port & user.rlike("^:?$")
    return F.when(good, F.concat(scheme, F.lit("://"), _host(get(3)), shown_port, path, query, fragment))

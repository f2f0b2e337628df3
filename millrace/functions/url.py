"""Web addresses on columns: canonical forms, domains, and which hosts are public.

Native expressions over addresses of plain ASCII; an address that is not absolute http or https
gives null, so that callers can report it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import trimmed

#: Parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer")
#: Hosts that hand out the machine's own data.
METADATA_HOSTS = ("metadata.google.internal", "metadata.aws.internal", "instance-data.ec2.internal")
LONGEST = 2048
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^:/?#\[\]]*)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


_MARKED = "".join(f"\u0001${k}" for k in range(1, 7))


def part(url: Column, group: int) -> Column:
    """A part of an address; empty where the address lacks it or has another shape.

    One match writes out all parts, so that the parts of one address share it in a plan.
    """
    parts = F.split(F.regexp_replace(url, _SHAPE, _MARKED), "\u0001")
    return F.when(url.isNotNull(), F.coalesce(F.get(parts, F.lit(group)), F.lit("")))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Host in lower case; empty for what is no absolute address."""
    return F.lower(part(url, 3))


def is_web(url: Column) -> Column:
    """An absolute http or https address with a host and without credentials."""
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & (part(url, 2) == ""), F.lit(False))


def _query(url: Column, drop_tracking: bool) -> Column:
    pairs = F.filter(F.split(part(url, 6), "&"), lambda p: p != "")
    if drop_tracking:
        pairs = F.filter(pairs, lambda p: ~(F.lower(F.split_part(p, F.lit("="), F.lit(1))).startswith("utm_") | F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING)))
    # the sort is stable: equal names keep their order
    keyed = F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")


def canonical(url: Column, drop_tracking: bool = True) -> Column:
    """Canonical address: lower host, no default port, no fragment, parameters sorted (and tracking ones dropped)."""
    address = trimmed(url)
    kind, port, path, query = scheme(address), part(address, 4), part(address, 5), _query(address, drop_tracking)
    default = ((kind == "https") & (port == "443")) | ((kind == "http") & (port == "80")) | (port == "")
    text = F.concat(
        kind, F.lit("://"), host(address), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(without_dots(path)),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(is_web(address), text)


def domain(website: Column, source_url: Column) -> Column:
    """Host of the website, or of the source where there is none, without a leading www."""
    site = F.when(is_web(trimmed(website)), host(trimmed(website)))
    return F.regexp_replace(F.coalesce(site, host(trimmed(source_url))), r"^www\.", "")


def bare_host(column: Column) -> Column:
    """Lower case, without the brackets of an IPv6 address."""
    return F.regexp_replace(F.lower(column), r"^\[|\]$", "")


def _octets(name: Column) -> Column:
    return F.transform(F.split(name, r"\."), lambda o: o.try_cast("int"))


def is_ipv4(name: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return name.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def private_host(name: Column) -> Column:
    """Hosts that a public service must not call: local names, private and reserved ranges."""
    # an IPv4 address written as IPv6 is what it maps to
    name = F.regexp_replace(F.lower(name), r"^::ffff:(?=\d+\.)", "")
    o = _octets(name)
    first, second = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    v4 = is_ipv4(name) & (
        first.isin(0, 10, 127) | ((first == 169) & (second == 254)) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168))
        | ((first == 100) & second.between(64, 127)) | (first >= 224)
    )
    v6 = name.contains(":") & (name.isin("::", "::1") | name.rlike(r"^(?:f[cd]|fe[89ab])"))
    return F.coalesce((name == "localhost") | name.endswith(".localhost") | (name == "0.0.0.0") | name.isin(*METADATA_HOSTS) | v4 | v6, F.lit(False))


def without_dots(path: Column) -> Column:
    """A path without its "." and ".." segments."""
    def step(kept: Column, segment: Column) -> Column:
        return F.when(segment == "..", F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    segments = F.split(path, "/")
    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.lit(0), F.size(segments) - 1)), F.array(F.lit("")), step)
    # a path that ends in a dot segment names a folder
    folder = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), folder)).otherwise(path)


def absolute_link(link: Column, base: Column) -> Column:
    """A link of a page as a web address without fragment: absolute, from the site's root, or from the page's folder."""
    value = F.regexp_replace(trimmed(link), "#.*$", "")
    origin = F.concat(scheme(base), F.lit("://"), host(base), F.when(part(base, 4) != "", F.concat(F.lit(":"), part(base, 4))).otherwise(""))
    path, asked = F.regexp_extract(value, r"^([^?]*)", 1), F.regexp_extract(value, r"(\?.*)$", 1)
    folder = F.regexp_replace(F.coalesce(F.nullif(part(base, 5), F.lit("")), F.lit("/")), r"[^/]*$", "")
    near = F.concat(origin, without_dots(F.concat(folder, path)), asked)
    full = (
        F.when(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), value).when(value.startswith("//"), F.concat(scheme(base), F.lit(":"), value))
        .when(value.startswith("/"), F.concat(origin, without_dots(path), asked)).when(value != "", near)
    )
    return F.when(is_web(full), full)


def fetchable(url: Column) -> Column:
    """The canonical address of what may be fetched: up to LONGEST characters, on a public host; null for the rest."""
    return F.when((F.length(url) <= LONGEST) & ~private_host(host(trimmed(url))), canonical(url, drop_tracking=False))

"""Addresses, hosts and URLs as columns."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.functions.text import at_most, c

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^(?:{OCTET}\.){{3}}{OCTET}$"
# Names and top-level labels that must not be fetched.
METADATA_NAMES = ["metadata", "instance-data", "metadata.google.internal", "instance-data.ec2.internal"]
RESERVED_TLDS = ["localhost", "local", "localdomain", "internal", "intranet", "lan", "home", "corp", "test", "invalid", "example"]


def ipv4_number(ip) -> Column:
    """Strict dotted quad as a number; NULL for anything else, leading zeros included."""
    t = F.trim(c(ip))
    p = F.split(t, r"\.")
    part = lambda i: F.get(p, F.lit(i)).cast("bigint")
    return F.when(t.rlike(IPV4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def cidr_bounds(cidr) -> Column:
    """struct(lo, hi, prefix) of an IPv4 network or single address; NULL for anything else."""
    base = ipv4_number(F.substring_index(c(cidr), "/", 1))
    tail = F.regexp_extract(c(cidr), r"/(\d{1,2})$", 1)
    prefix = F.when(F.contains(c(cidr), F.lit("/")), tail.try_cast("int")).otherwise(32)
    size = F.pow(F.lit(2.0), (32 - prefix).cast("double")).cast("bigint")
    lo = base - base % size
    return F.when(base.isNotNull() & prefix.between(0, 32), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"), prefix.alias("prefix")))


def in_cidr(ip, cidr) -> Column:
    b = cidr_bounds(cidr)
    return ipv4_number(ip).between(b["lo"], b["hi"])


def ip_scope(ip) -> Column:
    """Scope of an address; only a literal can be PUBLIC, anything unreadable is UNKNOWN."""
    t = F.lower(F.trim(c(ip)))
    t = F.regexp_replace(t, r"^\[([^\]]*)\].*$", "$1")
    v4 = ipv4_number(t)
    masked = lambda bits: v4 - v4 % (1 << (32 - bits))
    quad = lambda s: sum(int(x) << (24 - 8 * i) for i, x in enumerate(s.split(".")))
    head = F.substring_index(t, ":", 1)
    hextet = F.when(head == "", 0).otherwise(F.conv(F.when(head.rlike("^[0-9a-f]{1,4}$"), head), 16, 10).cast("int"))
    both = lambda mask: hextet.bitwiseAND(F.lit(mask))
    v6 = (
        F.when(t.isin("::", "::0"), "UNSPECIFIED")
        .when(t == "::1", "LOOPBACK")
        .when(hextet.isNull(), "UNKNOWN")
        .when(both(0xFE00) == 0xFC00, "PRIVATE")
        .when(both(0xFFC0) == 0xFE80, "LINK_LOCAL")
        .when(both(0xFF00) == 0xFF00, "MULTICAST")
        .when(both(0xFFC0) == 0xFE00, "RESERVED")
        .when(t.startswith("2001:db8:") | t.startswith("100:"), "RESERVED")
        .when(both(0xE000) == 0x2000, "PUBLIC")
        .otherwise("RESERVED")
    )
    return (
        F.when(t.isNull() | (t == ""), "UNKNOWN")
        .when(F.contains(t, F.lit(":")), v6)
        .when(v4.isNull(), "UNKNOWN")
        .when(v4 == 0, "UNSPECIFIED")
        .when(v4 == 4294967295, "BROADCAST")
        .when(masked(8) == quad("127.0.0.0"), "LOOPBACK")
        .when((masked(8) == quad("10.0.0.0")) | (masked(12) == quad("172.16.0.0")) | (masked(16) == quad("192.168.0.0")), "PRIVATE")
        .when(masked(16) == quad("169.254.0.0"), "LINK_LOCAL")
        .when(masked(10) == quad("100.64.0.0"), "CARRIER_GRADE_NAT")
        .when(masked(24).isin(*[quad(x) for x in ("192.0.0.0", "192.0.2.0", "198.18.0.0", "198.51.100.0", "203.0.113.0")]), "RESERVED")
        .when(masked(4) == quad("224.0.0.0"), "MULTICAST")
        .when(masked(4) == quad("240.0.0.0"), "RESERVED")
        .otherwise("PUBLIC")
    )


@F.pandas_udf(T.StringType())
def _v6_verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    nets = [
        ("documentation", "2001:db8::/32"), ("teredo", "2001::/32"), ("6to4", "2002::/16"), ("nat64", "64:ff9b::/96"),
        ("unique_local", "fc00::/7"), ("link_local", "fe80::/10"), ("multicast", "ff00::/8"),
    ]
    table = [(r, ipaddress.ip_network(n)) for r, n in nets]

    def verdict(s):
        if s is None:
            return None
        if "%" in s:
            return "ipv6_zone_id"
        try:
            a = ipaddress.IPv6Address(s)
        except ValueError:
            return "malformed_ipv6"
        if a == ipaddress.IPv6Address("::"):
            return "unspecified"
        if a == ipaddress.IPv6Address("::1"):
            return "loopback"
        if a.ipv4_mapped:
            return "ipv4_mapped"
        if int(a) < 1 << 32:
            return "ipv4_compatible"
        return next((r for r, n in table if a in n), "allow")

    for s in batches:
        yield s.map(verdict)


def fetch_verdict(host) -> Column:
    """'allow', or the reason why a host must not be fetched. Only IPv6 literals go to Python."""
    h = F.trim(c(host))
    h = F.lower(F.when(h.rlike(r"^\[.+\]$"), F.regexp_replace(h, r"^\[|\]$", "")).otherwise(h))
    p = F.split(h, r"\.")
    o = lambda i: F.get(p, F.lit(i)).try_cast("int")
    a, b, d = o(0), o(1), o(2)
    literal = (
        F.when(F.size(p) != 4, "malformed_ipv4")
        .when(~h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (F.greatest(a, b, d, o(3)) > 255), "malformed_ipv4")
        .when(a == 0, "unspecified")
        .when(a == 127, "loopback")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 169) & (b == 254), "link_local")
        .when((a == 100) & b.between(64, 127), "cgnat")
        .when((a == 192) & (b == 0) & (d == 0), "ietf_protocol_assignment")
        .when(((a == 192) & (b == 0) & (d == 2)) | ((a == 198) & (b == 51) & (d == 100)) | ((a == 203) & (b == 0) & (d == 113)), "documentation")
        .when((a == 192) & (b == 88) & (d == 99), "6to4_relay")
        .when((a == 198) & b.isin(18, 19), "benchmarking")
        .when(a.between(224, 239), "multicast")
        .when(a >= 240, "reserved")
        .otherwise("allow")
    )
    hostname = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"
    return (
        F.when(h.isNull() | (h == ""), "empty_host")
        .when(F.length(h) > 253, "host_too_long")
        .when(h.isin(METADATA_NAMES), "cloud_metadata_name")
        .when(h.isin(RESERVED_TLDS), "reserved_hostname")
        .when(F.contains(h, F.lit(".")) & F.substring_index(h, ".", -1).isin(RESERVED_TLDS), "reserved_tld")
        .when(h.startswith("0x") | h.rlike(r"(^|\.)0[^.]"), "non_canonical_ip_literal")
        .when(h.rlike(r"^[0-9.]*\.[0-9.]*$"), literal)
        .when(F.contains(h, F.lit(":")), _v6_verdict(F.when(F.contains(h, F.lit(":")), h)))
        .when(~F.contains(h, F.lit(".")), "non_fqdn_hostname")
        .when(~h.rlike(hostname), "malformed_hostname")
        .otherwise("allow")
    )


def extract_ips(text, cap: int | None = None) -> Column:
    """Valid IPv4 literals of a text in order; a run of digits and dots counts only as a whole."""
    runs = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit("[0-9.]+"), F.lit(0))
    trimmed = F.transform(runs, lambda r: F.regexp_replace(r, r"^\.+|\.+$", ""))
    return at_most(F.filter(trimmed, lambda r: r.rlike(IPV4)), cap)


def urls_b(text, cap: int | None = None, longest: int | None = None) -> Column:
    """Links of a text, each once: until blank, quote or bracket, without closing punctuation, longer than 12; `longest`: characters read after the scheme."""
    raw = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(r"""(?i)https?://[^\s"'<>`)\]]""" + ("*" if longest is None else f"{{0,{longest}}}")), F.lit(0))
    return at_most(F.array_distinct(F.filter(F.transform(raw, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")), lambda u: F.length(u) > 12)), cap)


def urls_a(text, cap: int | None = None) -> Column:
    """Links as the scoring reads them: repeats kept, until blank, quote, angle, parenthesis or pipe, longer than 8."""
    raw = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(r"""(?i)https?://[^\s"'<>)|]*"""), F.lit(0))
    return at_most(F.filter(F.transform(raw, lambda u: F.regexp_replace(u, r"[.,;:!]+$", "")), lambda u: F.length(u) > 8), cap)


def url_host_b(url) -> Column:
    """Host after the last at-sign of the authority, lower case."""
    authority = F.regexp_extract(c(url), r"://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.substring_index(authority, "@", -1), r":.*$", ""))


def url_host_a(url) -> Column:
    """Host as the scoring reads it: with an at-sign it is the part before it; [v6] is unwrapped."""
    rest = F.regexp_extract(c(url), r"://([^/?#]*)", 1)
    host = F.when(F.contains(rest, F.lit("@")), F.substring_index(rest, "@", 1)).otherwise(rest)
    return F.lower(F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, r":.*$", "")))

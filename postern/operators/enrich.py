"""Enrichment of addresses: longest-prefix lookup, ordered providers, registry texts."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import net

FIELDS = ("country", "hostname", "organization", "isp", "asn")


def clean_field(v) -> Column:
    """Trimmed value; '-', empty, unknown and n/a are NULL."""
    t = F.trim(F.col(v) if isinstance(v, str) else v)
    return F.when(~F.lower(t).isin("", "-", "unknown", "n/a"), t)


def prefixes(dataset: DataFrame) -> DataFrame:
    """Adds lo, hi, prefix and row order to (net, ...); rows whose network can't be read are dropped."""
    b = dataset.withColumn("_b", net.cidr_bounds("net")).filter("_b is not null")
    return b.select("*", "_b.lo", "_b.hi", "_b.prefix").drop("_b")


def longest_prefix(ips: DataFrame, dataset: DataFrame, order: str = "row_no") -> DataFrame:
    """Every (ip) with its best network: exact before ranges, then the longest prefix, then the first row.

    Instead of a range join, each address is keyed by its network at every prefix length the dataset
    has (33 at most), so the join is on equality. The best match is an aggregate per address, which
    is taken over distinct addresses, so an address that fills a third of the rows is one row.
    """
    nets = prefixes(dataset)
    lengths = F.array_sort(F.collect_set("prefix"))
    have = nets.agg(lengths.alias("lengths"))  # one row of at most 33 numbers
    keyed = ips.select("ip").distinct().withColumn("n", net.ipv4_number("ip")).filter("n is not null").crossJoin(F.broadcast(have))
    keyed = keyed.select("ip", "n", F.explode("lengths").alias("prefix"))
    size = F.pow(F.lit(2.0), (32 - F.col("prefix")).cast("double")).cast("bigint")
    keyed = keyed.withColumn("lo", F.col("n") - F.col("n") % size)
    keep = [c for c in nets.columns if c not in ("lo", "hi", "prefix")]
    hit = keyed.join(nets, ["prefix", "lo"])
    best = hit.groupBy("ip").agg(F.min(F.struct((-F.col("prefix")).alias("p"), F.col(order).alias("o"), F.struct(*keep).alias("row"))).alias("b"))
    return best.select("ip", (-F.col("b.p")).alias("prefix"), "b.row.*")


def provider_join(ips: DataFrame, providers: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """(ip, then value, status and provenance of every field): the first provider that knows a field wins.

    Each provider is (name, DataFrame(ip, fields...), available). A field nobody knows is UNAVAILABLE
    if some provider was not available, else UNKNOWN. Provider rows are unique per ip.
    """
    df = ips.select("ip").distinct()
    for i, (_, p, up) in enumerate(providers):
        cols = [clean_field(f).alias(f"{f}_{i}") if f in p.columns else F.lit(None).cast("string").alias(f"{f}_{i}") for f in FIELDS]
        df = df.join(p.select("ip", *cols), "ip", "left") if up else df.withColumns({f"{f}_{i}": F.lit(None).cast("string") for f in FIELDS})
    some_down = any(not up for _, _, up in providers)
    missing = "UNAVAILABLE" if some_down else "UNKNOWN"
    out = []
    for f in FIELDS:
        value = F.coalesce(*[F.col(f"{f}_{i}") for i in range(len(providers))]) if providers else F.lit(None).cast("string")
        source = reduce(lambda acc, i: acc.when(F.col(f"{f}_{i}").isNotNull(), providers[i][0]), range(len(providers)), F.when(F.lit(False), ""))
        out += [value.alias(f), F.when(value.isNotNull(), "KNOWN").otherwise(missing).alias(f"{f}_status"), source.alias(f"{f}_source")]
    reason = "no provider configured" if not providers else "a provider was not available" if some_down else "no provider had data"
    known = F.coalesce(*[F.col(f) for f in FIELDS])
    return df.select("ip", *out).withColumn("reason", F.when(known.isNull(), reason))


def _card(entity: dict, *labels: str) -> str | None:
    """A property of an entity's card: rows of [key, parameters, type, value], or a list of keys beside a map of values."""

    def value(v, place: bool) -> str | None:
        if place and isinstance(v, list):
            v = v[-1] if v else None
        return v.strip() if isinstance(v, str) and v.strip() else None

    card = entity.get("vcardArray")
    if not isinstance(card, list) or len(card) < 2:
        return None
    if isinstance(card[1], list):
        for row in card[1]:
            if isinstance(row, list) and len(row) >= 4 and isinstance(row[0], str) and row[0].lower() in labels and (v := value(row[3], row[0].lower() == "adr")):
                return v
    if isinstance(card[0], list) and isinstance(card[1], dict):
        for want in labels:
            for k in card[0]:
                if isinstance(k, str) and k.lower() == want and (v := value(card[1].get(k), want == "adr")):
                    return v
    return None


def rdap_record(text: str | None) -> dict[str, str | None]:
    """country, hostname, organization, isp and asn of one registry answer; what can't be read is None."""
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    try:
        root = json.loads(text or "null")
    except ValueError:
        return out
    if not isinstance(root, dict):
        return out
    maps = lambda v: [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []
    word = lambda v: v.strip() if isinstance(v, str) and v.strip() else None

    def role(node: dict, name: str) -> str | None:
        for e in maps(node.get("entities")):
            if isinstance(e.get("roles"), list) and any(isinstance(r, str) and r.lower() == name for r in e["roles"]):
                return _card(e, "fn") or word(e.get("handle"))
        return None

    def remark(node: dict) -> str | None:
        lines = (x for r in maps(node.get("remarks")) for x in (r.get("description") if isinstance(r.get("description"), list) else []))
        return next((w for x in lines if (w := word(x))), None) or word(node.get("name"))

    def country(node: dict) -> str | None:
        own = word(node.get("country")) or next((v for e in maps(node.get("entities")) if (v := _card(e, "adr", "country"))), None)
        return own.upper() if own else None

    nodes = root.get("networks")
    for node in maps(nodes) if nodes and isinstance(nodes, list) else [root]:
        for k, v in (("country", country(node)), ("hostname", remark(node)), ("organization", role(node, "registrant")), ("isp", role(node, "administrative"))):
            out[k] = out[k] or v
    if not (isinstance(nodes, list) and nodes) and (h := word(root.get("handle"))) and h.upper().startswith("AS"):
        out["asn"] = h
    return out


def parse_rdap(text: Column) -> Column:
    """struct(country, hostname, organization, isp, asn) of a registry answer; text that isn't JSON gives NULLs.

    The answers are trees of optional lists, so they are read in Arrow batches.
    """

    @F.pandas_udf(", ".join(f"{f} string" for f in FIELDS))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rdap_record(t) for t in s], columns=list(FIELDS))

    return run(text)


def parse_whois(text: Column) -> Column:
    """struct(country, netname, organization, asn, hostname): the first line of each key wins; comments are skipped."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    pairs = F.filter(lines, lambda x: ~x.startswith("%") & ~x.startswith("#") & F.contains(x, F.lit(":")))

    def first(*keys: str) -> Column:
        hit = F.filter(pairs, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))).isin(*keys))
        return F.trim(F.regexp_replace(F.get(hit, F.lit(0)), r"^[^:]*:", ""))

    return F.struct(
        F.upper(first("country")).alias("country"), first("netname").alias("netname"), first("orgname", "org-name", "organization", "organisation", "org").alias("organization"),
        F.upper(F.regexp_extract(F.upper(first("origin", "originas", "aut-num")), r"(AS\d+)", 1)).alias("asn"), first("hostname").alias("hostname"),
    )

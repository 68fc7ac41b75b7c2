"""Observable relay infrastructure: hop order, primary address, confidence factors.

Hops come in long form (one row per hop) and are folded into one row per message by one
aggregation; a message's chain is bounded by the message. Dimensions (hints) are joined before
that, on host or network, and are broadcast only where their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions import net
from postern.functions.scoring import attribution_band, geometric_confidence
from postern.operators.enrich import FIELDS, clean_field

# Fixed value: the statement that accompanies every attribution.
DISCLAIMER = (
    "This result identifies technically observable infrastructure and does not establish the physical identity or intent of the sender. "
    "IP addresses may represent shared infrastructure, NAT, VPNs, proxies, cloud systems, compromised hosts, or other intermediaries."
)


def chains(hops: DataFrame) -> DataFrame:
    """(msg_no, hops): array of (hopindex, hop_no, ip, scope, ts, via) newest first, from (msg_no, hopindex, ip, ts, protocol)."""
    h = hops.select("msg_no", F.struct("hopindex", "hop_no", "ip", net.ip_scope("ip").alias("scope"), "ts", F.lower("protocol").alias("via"), "host").alias("h"))
    return h.groupBy("msg_no").agg(F.array_sort(F.collect_list("h")).alias("hops"))


def ordered(chain: Column) -> Column:
    """Earliest first: by time where every hop has one, else deepest header first."""
    dated = F.forall(chain, lambda h: h["ts"].isNotNull())
    key = lambda h: F.struct(F.when(dated, h["ts"]).alias("t"), (-h["hopindex"]).alias("d"), h.alias("h"))
    return F.transform(F.array_sort(F.transform(chain, key)), lambda s: s["h"])


def ordering_basis(chain: Column) -> Column:
    return F.when(F.size(chain) <= 1, "TRIVIAL").when(F.forall(chain, lambda h: h["ts"].isNotNull()), "TIMESTAMP").otherwise("HEADER_DEPTH")


def contradicted(chain: Column) -> Column:
    """A newer hop dated before the next older one."""
    pairs = F.arrays_zip(F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0))).alias("a"), F.slice(chain, F.lit(2), F.greatest(F.size(chain), F.lit(1))).alias("b"))
    return F.exists(pairs, lambda p: F.coalesce(p["a"]["ts"] < p["b"]["ts"], F.lit(False)))


def indicators(hops: DataFrame) -> DataFrame:
    """One row per hop and intermediary token its protocol contains: (msg_no, hop_no, token)."""
    toks = F.filter(F.array(*[F.lit(t) for t in L.PROXY_TOKENS]), lambda t: F.contains(F.lower("protocol"), t))
    return hops.filter("protocol is not null").select("msg_no", "hop_no", F.explode(toks).alias("token"))


def domain_hints(entries: DataFrame, order: str = "row_no") -> DataFrame:
    """(domain, age_days, mx), one row per domain, from an analyst's entries in order.

    Names are compared in lower case without blanks around them; a later entry that states a field
    supersedes an earlier one; a negative age is an error.
    """
    bad = F.col("age_days") < 0
    age = F.when(bad, F.raise_error(F.lit("an age can't be negative"))).otherwise(F.col("age_days"))
    e = entries.select(F.lower(F.trim("domain")).alias("domain"), age.cast("int").alias("age_days"), "mx", order).filter("domain <> ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return e.groupBy("domain").agg(last("age_days").alias("age_days"), last("mx").alias("mx"))


def attribute(
    hops: DataFrame, enrichment: DataFrame | None = None, domains: DataFrame | None = None, anonymiser_asns: tuple[str, ...] = (), anonymiser_orgs: tuple[str, ...] = (), proxy_hosts: tuple[str, ...] = ()
) -> DataFrame:
    """One row per message with hops: primary address, counts, factors T S A X, value, band, factors reported.

    `enrichment`: optional (ip, organization, isp, asn), one row per address. `domains`: optional
    (domain, age_days, mx), lower case, one row per host. The last three are an analyst's own lists;
    proxy hosts are parts of names. S is the mean of its observed parts, none observed gives 0.
    No public address gives confidence exactly 0.
    """
    c = chains(hops).withColumn("path", ordered(F.col("hops")))
    public = F.filter("path", lambda h: h["scope"] == "PUBLIC")
    c = c.withColumn("primary", F.get(public, F.lit(0)))
    n = F.size("hops")
    private = F.size(F.filter("hops", lambda h: h["scope"] == "PRIVATE"))
    reserved = F.size(F.filter("hops", lambda h: h["ip"].isNotNull() & ~h["scope"].isin("PUBLIC", "PRIVATE")))
    words = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    count = lambda xs, part: F.aggregate("hops", F.lit(0), lambda acc, h: acc + F.size(F.filter(words(xs), lambda t: F.coalesce(F.contains(part(h), t), F.lit(False)))))
    proxies = [p.strip().lower() for p in proxy_hosts if p.strip()]
    c = c.select(
        "msg_no", F.col("primary.ip").alias("primary_ip"), F.col("primary.hopindex").alias("primary_index"), n.alias("n_hops"), ordering_basis(F.col("hops")).alias("basis"),
        contradicted(F.col("hops")).alias("contradicted"), F.size(F.array_distinct(F.transform(public, lambda h: h["ip"]))).alias("n_public"),
        count(L.PROXY_TOKENS, lambda h: h["via"]).alias("_tokens"), count(proxies, lambda h: F.lower(h["host"])).alias("_proxies"), ((n - private - reserved) / n).alias("t"),
        (F.col("primary.hopindex") == F.array_max(F.transform("hops", lambda h: h["hopindex"]))).alias("originating"), F.lower(F.trim("primary.host")).alias("_host"),
    )
    if enrichment is not None:
        known = [clean_field(f).alias(f) if f in enrichment.columns else F.lit(None).cast("string").alias(f) for f in FIELDS]
        c = c.join(enrichment.select(F.col("ip").alias("primary_ip"), *known), "primary_ip", "left")
    else:
        c = c.withColumns({f: F.lit(None).cast("string") for f in FIELDS})
    if domains is not None:
        c = c.join(domains.select(F.col("domain").alias("_host"), "age_days", "mx"), "_host", "left")
    else:
        c = c.withColumns({"age_days": F.lit(None).cast("int"), "mx": F.lit(None).cast("boolean")})
    anonymous_asn = F.coalesce(F.array_contains(words([x.strip().upper() for x in anonymiser_asns]), F.upper("asn")), F.lit(False))
    anonymous_org = F.array_contains(words([x.strip().lower() for x in anonymiser_orgs]), F.lower(F.coalesce("organization", "isp")))
    host_known = F.coalesce(F.length("_host") > 0, F.lit(False))
    signals = F.array_compact(F.array(F.when(anonymous_org, 0.0).when(~anonymous_org, 1.0), F.when(F.col("age_days") >= 0, F.least(F.col("age_days") / 365.0, F.lit(1.0))), F.when(F.col("mx"), 1.0).when(~F.col("mx"), 0.0)))
    agreed = [F.col("primary_ip").isNotNull(), F.col("asn").isNotNull(), F.col("organization").isNotNull(), host_known]
    c = c.withColumns({
        "anonymiser": anonymous_asn, "operator_hidden": F.coalesce(anonymous_org, F.lit(False)), "network_known": F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull(), "host_known": host_known,
        "indicators": F.col("_tokens") + F.col("_proxies") + anonymous_asn.cast("int"),
        "s": F.when(F.size(signals) > 0, F.aggregate(signals, F.lit(0.0), lambda a, v: a + v) / F.size(signals)).otherwise(0.0),
        "a": F.when(anonymous_asn, 1.0).when(F.col("_proxies") > 0, 0.75).otherwise(F.least(F.lit(0.5), 0.25 * F.col("_tokens"))),
        "x": sum((v.cast("int") for v in agreed), F.lit(0)) / 4.0,
    })
    value = F.when(F.col("primary_ip").isNull(), 0.0).otherwise(geometric_confidence("t", "s", "a", "x"))
    f = lambda name, w: F.struct(F.lit(name).alias("factor"), F.lit(w).alias("weight"))
    factors = F.array_compact(
        F.array(
            f("base", 0.30),
            F.when(F.col("n_public") == 1, f("single_candidate", 0.20)).when(F.col("n_public") > 1, f("multiple_candidates", -0.10)),
            F.when(F.col("contradicted"), f("timestamp_contradiction", -0.15)).when(F.col("basis") == "TIMESTAMP", f("timestamps_consistent", 0.15)),
            F.when(F.col("originating"), f("originating_hop", 0.10)).otherwise(f("relayed", -0.05)),
            f("enrichment_not_configured", -0.05) if enrichment is None else F.when(F.col("network_known"), f("network_record", 0.10)).otherwise(f("no_network_record", -0.05)),
            F.when(F.col("anonymiser"), f("anonymiser_network", -0.20)),
            F.when(F.col("indicators") > 0, f("intermediary", -0.20)),
            F.when(~F.col("host_known"), f("no_hostname", -0.05)),
        )
    )
    c = c.withColumn("value", value).withColumn("band", attribution_band("value")).withColumn("factors", F.when(F.col("primary_ip").isNotNull(), factors))
    return c.drop("_tokens", "_proxies", "_host", "age_days", "mx", *FIELDS)


def uncertainty(df: DataFrame) -> Column:
    """Messages about what limits an attribution."""
    return F.array_compact(
        F.array(
            F.when(F.col("primary_ip").isNull(), "no public address was observed"),
            F.when(F.col("n_hops") == 1, "one hop only"),
            F.when(F.col("basis") == "HEADER_DEPTH", "some hops carry no usable time"),
            F.when(F.col("contradicted"), "hop times contradict the header order"),
            F.when(F.col("n_public") > 1, "several public addresses were observed"),
            F.when(F.col("indicators") > 0, "a relay names an intermediary protocol, or it or its network is on a list of intermediaries"),
            F.when(F.col("primary_ip").isNotNull() & ~F.col("network_known"), "the network of the primary address is not known"),
            F.when(F.col("operator_hidden"), "the registered operator is an anonymiser"),
        )
    )


def summary(df: DataFrame) -> DataFrame:
    """(msg_no, summary): one line of text per message, with the disclaimer."""
    head = F.concat_ws(" ", F.lit("primary"), F.coalesce("primary_ip", F.lit("none")), F.lit("confidence"), F.format_string("%.4f", F.col("value")), F.col("band"))
    return df.select("msg_no", F.concat_ws("; ", head, F.array_join(uncertainty(df), ", ")).alias("summary"), F.lit(DISCLAIMER).alias("disclaimer"))

"""String, network, header and scoring columns against literal vectors."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from postern.functions import headers, lexicons, net, scoring, text


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def values(spark, fn, items, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {type_}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_ip_scope(spark):
    closed = "10.0.0.5 172.16.4.9 192.168.1.10 127.0.0.1 169.254.7.7 100.64.0.1 ::1 fd00::1 fe80::1 ff02::1 192.0.2.1 198.51.100.5 203.0.113.9 0.0.0.0 224.0.0.1 255.255.255.255 240.0.1.1 2001:db8::1 100::1".split()
    public = "8.8.8.8 1.1.1.1 9.9.9.9 208.67.222.222 2606:4700:4700::1111".split()
    assert "PUBLIC" not in values(spark, net.ip_scope, closed)
    assert set(values(spark, net.ip_scope, public)) == {"PUBLIC"}
    assert values(spark, net.ip_scope, [None, "", "x", "01.2.3.4", "1.2.3"]) == ["UNKNOWN"] * 5


def test_extract_ips(spark):
    assert values(spark, net.extract_ips, ["999.1.1.1 1.2.3.4.5 8.8.8.8.8 1..2..3 8.8.8", "1.2.3.4.5 and 8.8.8.8 and 1.2.3.4.6", None]) == [[], ["8.8.8.8"], []]


def test_fetch_verdict(spark):
    denied = "127.0.0.1 10.1.1.1 169.254.169.254 localhost metadata.google.internal 0x7f.1 127.1 010.0.0.1 [::1] fe80::1%eth0 64:ff9b::1 a.local single ::ffff:10.0.0.1".split()
    assert "allow" not in values(spark, net.fetch_verdict, [*denied, None, " "])
    assert set(values(spark, net.fetch_verdict, ["mail.kit.org", "8.8.8.8", "2606:4700::1"])) == {"allow"}


def test_hosts(spark):
    u = ["http://user@evil.test/x", "https://a.test:8080/p?q", "http://[2001:db8::1]/x"]
    assert values(spark, net.url_host_a, u) == ["user", "a.test", "2001:db8::1"]
    assert values(spark, net.url_host_b, u)[:2] == ["evil.test", "a.test"]


def test_osa_and_prefilter(spark):
    pairs = [("ca", "abc", 3), ("ab", "ba", 1), ("", "abc", 3), ("same", "same", 0), ("paypal", "paypa1", 1)]
    assert [text.osa(a, b) for a, b, _ in pairs] == [d for *_, d in pairs]
    df = spark.createDataFrame([p[:2] for p in pairs] + [(None, "x"), ("abcdefgh", "zzzzzzzz")], "a string, b string")
    assert [r[0] for r in df.select(text.osa_distance("a", "b", 3)).collect()] == [3, 1, 3, 0, 1, None, None]


def test_uuid5_matches_the_library(spark):
    ns = "00abedb4-aa42-466c-9c01-fed23315a9b7"
    names = ["a", "domain-name:x.test", "é", ""]
    assert values(spark, lambda c: text.uuid5(ns, c), names) == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]


def test_skeleton_is_idempotent(spark):
    table = {"а": "a", "ы": "bl"}
    once = values(spark, lambda c: text.skeleton(c, table), ["Pаy​Pal", "ｆｕｌｌ ы", None, ""])
    assert once == ["paypal", "full bl", None, ""] and values(spark, lambda c: text.skeleton(c, table), once) == once


def test_weighted_hits_consume(spark):
    got = values(spark, lambda c: text.weighted_hits(c, lexicons.AUTHORITY), ["official notice", "an official audit", "", None])
    assert [None if g is None else round(g, 6) for g in got] == [0.6, 0.7, 0.0, None] or got[3] in (None, 0.0)


def test_header_dates(spark):
    got = values(spark, lambda c: F.unix_seconds(headers.header_date(c)), ["Mon, 30 Dec 2024 23:58:26 +0900", "30 Dec 2024 14:58 GMT", "x", None, "31 Feb 2024 00:00:00 +0000"])
    assert got[0] == 1735570706 and got[1] == 1735570680 and got[2:] == [None, None, None]
    assert values(spark, headers.military_offset, list("AINVKZY")) == ["-0100", "-0900", "+0100", "+0900", None, "+0000", None]


def score_row(spark, fired):
    x = F.array(*[F.lit(1.0 if f in fired else None).cast("double") for f in lexicons.FEATURES])
    df = spark.range(1).select(x.alias("x")).withColumn("p", scoring.softmax(scoring.logits("x"))).withColumn("bec", scoring.bec_score("x"))
    return df.select(scoring.risk("p").alias("risk"), scoring.risk_final("p", "bec").alias("rf"), scoring.model_confidence("p").alias("c"), F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("sum"), scoring.band("risk").alias("band")).first()


def test_golden_scores(spark):
    r = score_row(spark, [])
    assert r["risk"] == pytest.approx(7.944271, abs=1e-6) and r["rf"] == pytest.approx(9.206171, abs=1e-6) and r["c"] == pytest.approx(0.8566139933, abs=1e-9)
    r = score_row(spark, ["spf_none", "dkim_absent", "dmarc_absent", "messageid_anomaly", "domain_age_unknown"])
    assert r["risk"] == pytest.approx(24.328719, abs=1e-6) and r["rf"] == pytest.approx(25.36602115, abs=1e-7) and r["c"] == pytest.approx(0.6434493872, abs=1e-9)
    assert r["sum"] == pytest.approx(1.0) and r["band"] == "LOW"


def test_softmax_bounds(spark):
    for z in ([0.0] * 8, [1e4] * 8, [-1e4] * 8):
        assert one(spark, p=scoring.softmax(F.array(*[F.lit(v) for v in z])))["p"] == [pytest.approx(1 / 8)] * 8
    assert one(spark, p=scoring.softmax(F.array(F.lit(1e4), *[F.lit(-1e4)] * 7)))["p"][0] == pytest.approx(1.0)


def test_noisy_or_and_quarantine(spark):
    n = lambda *v: one(spark, o=scoring.noisy_or(F.array(*[F.lit(x).cast("double") for x in v]).cast("array<double>")))["o"]
    assert n() == 0 and n(0.3) == pytest.approx(0.3) and n(0.5, 0.5) == pytest.approx(0.75) and n(0.9, 0.5) == pytest.approx(0.95) and n(1.4) == 1 and n(-0.2) == 0
    assert n(math.nan) is None
    assert values(spark, scoring.quarantine, [0.0, 1.0, 1.5, -0.1, math.nan, None], "double") == [0.0, 1.0, None, None, None, None]


def test_geometric_confidence(spark):
    g = lambda *v: one(spark, o=scoring.geometric_confidence(*[F.lit(float(x)) for x in v]))["o"]
    assert g(0, 1, 0, 1) == g(1, 0, 0, 1) == g(1, 1, 1, 1) == g(1, 1, 0, 0) == 0 and g(1, 1, 0, 1) == pytest.approx(0.85)
    assert values(spark, scoring.attribution_band, [0.7, 0.45, 0.25, 0.2], "double") == ["STRONG", "MODERATE", "WEAK", "INSUFFICIENT"]

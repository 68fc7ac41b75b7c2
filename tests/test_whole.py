"""Queries over small tables whose rows need the whole job."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from postern.functions import net, text
from postern.operators import correlate, evaluate
from postern.plans import analysis, catalog
from postern.plans.textual import LOOKALIKES


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_campaigns_join_by_sender_domain(spark, tmp_path):
    d = write(
        spark, tmp_path,
        messages=([(1, "<a@m>", "x@kit.test"), (2, "<b@m>", "Y <y@KIT.test>"), (3, "<c@m>", "z@else.test"), (4, "<d@m>", "w@third.test"), (5, "<e@m>", None)], "msg_no bigint, messageid string, fromaddr string"),
        hops=([(1, 0, "1.1.1.1"), (3, 0, "2.2.2.2"), (4, 0, "2.2.2.2"), (4, 1, "1.1.1.1"), (5, 0, "3.3.3.3")], "msg_no bigint, hopindex int, ip string"),
    )
    assert {tuple(r) for r in catalog.QUERIES["z01_campaigns"](spark, d).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_every_subject_is_normalised_and_rated(spark, tmp_path):
    subjects = ["plain", "ｆｕｌｌ ①", "ﬁne e\u0301", "раураl", "а\u200bb", "日本 ⑩", "", None, "x1\u00adо"]
    d = write(spark, tmp_path, cases=(list(enumerate(subjects)), "case_no bigint, subject string"))
    normal = [None if s is None else unicodedata.normalize("NFKC", s) for s in subjects]
    assert dict(map(tuple, catalog.QUERIES["x01_nfkc"](spark, d).collect())) == dict(enumerate(normal))
    invisible = {chr(i) for i in (*range(0x200B, 0x200E), *range(0x2060, 0x2065), 0x180E, 0xFEFF, 0xAD)}
    seen = [s and [ch for ch in s if ch not in invisible] for s in normal]
    want = [None if s is None else round(sum(ch in LOOKALIKES for ch in s) / len(s), 6) if s else 0.0 for s in seen]
    got = dict(map(tuple, catalog.QUERIES["x05_homoglyph_ratio"](spark, d).collect()))
    assert [got[i] for i in range(len(want))] == pytest.approx(want) and got[3] > 0.8


def test_every_header_date_is_tried(spark, tmp_path):
    noon = 1735560000000  # 30 Dec 2024 12:00:00 UTC
    dates = {
        "Mon, 30 Dec 2024 12:00:00 +0000": noon, "Mon, 30 Dec 2024 12:00:00 GMT": noon, "Mon, 30 Dec 2024 17:30 +0530": noon, "Mon, 30 Dec 2024 07:00 EST": noon,
        "30 Dec 2024 04:00:00 -0800": noon, "30 Dec 2024 08:00:00 EDT": noon, "30 Dec 2024 12:00 +0000": noon, "30 Dec 2024 12:00 UT": noon,
        "Mon, 30 Dec 2024 12:00:00 Z": noon, "Monday, 30 Dec 2024 05:00:00 MST": noon, "Mon, 30 Dec 2024 06:00:00 MDT": noon, "30 Dec 2024 06:00:00 CST": noon, "30 Dec 2024 07:00:00 CDT": noon,
        "30 Dec 2024 04:00:00 PST": noon, "30 Dec 2024 05:00:00 PDT": noon, "Mon, 30 Dec 2024  12:00:00 +0000 (local time)": noon,
        "32 Dec 2025 08:00:00 +0000": None, "Sat, Oct 2024": None, "n/a": None, "": None, "30 Dec 2024 12:00:00": None, None: None,
    }
    d = write(spark, tmp_path, messages=(list(enumerate(dates)), "msg_no bigint, dateheader string"))
    assert dict(map(tuple, catalog.QUERIES["p10_header_date_all"](spark, d).collect())) == dict(enumerate(dates.values()))


def test_attribution_with_hints(spark, tmp_path):
    rows = [
        (1, 1, 0, "198.19.4.4", "smtp4.wendelwick.test", "ESMTP"), (2, 2, 0, "198.18.7.9", "a.test", "ESMTP"), (3, 3, 0, "198.19.4.4", "EDGE8.x.test", "ESMTP"),
        (4, 4, 0, "8.8.8.8", "edge7.talsen.example", "HTTP"), (5, 5, 0, "8.8.8.8", "a.test", "ESMTP"), (6, 6, 0, "10.0.0.1", "a.test", "ESMTP"), (7, 7, 0, "198.18.9.9", None, "ESMTP"),
    ]
    d = write(spark, tmp_path, hops=([(*r, None) for r in rows], "msg_no bigint, hop_no bigint, hopindex int, ip string, host string, protocol string, timestampraw string"))
    got = {r["msg_no"]: r for r in catalog.QUERIES["t07_attribution"](spark, d).collect()}
    s4 = (41 / 365 + 1) / 2  # no operator is known: age and MX only; values are capped at .85
    want = {1: 0.85, 2: 0.0, 3: 0.25**0.25, 4: s4**0.25 * 0.75**0.25 * 0.5**0.15, 5: 0.0, 6: 0.0, 7: 0.85}
    assert {k: r["value"] for k, r in got.items()} == pytest.approx(want, abs=1e-6)
    assert [got[i]["indicators"] for i in range(1, 8)] == [0, 1, 1, 1, 0, 0, 0]
    said = {r["msg_no"]: r["summary"] for r in catalog.QUERIES["t12_summary"](spark, d).collect()}
    assert "STRONG" in said[1] and "anonymiser" in said[2] and "not known" in said[5]


def test_weakest_pair_of_a_chain(spark, tmp_path):
    schema = "case_no bigint, subject string, domains array<string>, addresses array<string>, hopaddresses array<string>, attachmenthashes array<string>, urls array<string>, risk double, confidence double, observedat bigint"
    rows = [(i, "pay now", ["hot.test"], [str(i + k) for k in range(3)], None, ["h"], None, 10.0, 0.5, 1) for i in range(4)]
    d = write(spark, tmp_path, cases=(rows, schema))
    r = catalog.QUERIES["c09_campaigns"](spark, d).first()
    assert (r["size"], r["links"]) == (4, 3) and r["cohesion"] == pytest.approx(0.65) and r["weakest"] == pytest.approx(0.55)


def test_long_texts_are_read_to_the_end(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(5000)) + "  " + "- " * 500_000 + "last"
    links = " ".join(f"http://a.test/{i:05d}" for i in range(1200)) + " http://b.test/" + "x" * 3000 + "1 http://b.test/" + "x" * 3000 + "2"
    ips = " ".join(f"9.9.{i}.1" for i in range(100))
    d = write(spark, tmp_path, documents=([(1, words, None), (2, links, 1)], "doc_id bigint, text string, parent_id bigint"), parts=([(1, ips)], "part_no bigint, body string"))
    q = lambda n: catalog.QUERIES[n](spark, d)
    assert q("x08_tokens").filter("doc_id = 1").first()["n_tokens"] == 5001
    for n in ("a01_document_frequency", "a02_idf", "a03_tfidf"):
        assert q(n).filter("term in ('w4999', 'last')").count() == 2
    assert [q(n).filter("doc_id = 2").first()["n"] for n in ("p22_urls_b", "p23_urls_a")] == [1202, 1202] and q("p26_extract_ips").first()["n"] == 100
    df = spark.createDataFrame([(words, links, [str(i) for i in range(600)])], "w string, l string, s array<string>")
    r = df.select(F.size(correlate.clean_set("s")), F.size(correlate.clean_set("s", cap=512)), F.size(text.tokens("w", 4000, 1_000_000)), F.size(net.urls_b("l", 1000, 2040))).first()
    assert tuple(r) == (600, 512, 4000, 1000)


def test_bootstrap_has_a_thousand_rounds(spark, sf):
    x = analysis.labelled(spark, sf)
    got, want, few = catalog.QUERIES["d13_bootstrap"](spark, sf).first(), evaluate.bootstrap_mean(x, "k", "y", 1000).first(), evaluate.bootstrap_mean(x, "k", "y", 100).first()
    assert tuple(got) == pytest.approx(tuple(want)) and tuple(got) != pytest.approx(tuple(few))

"""Correlation, graph, attribution, enrichment, audit, cases, parsing, sources, streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from postern.functions import mailparse
from postern.functions.lexicons import GENESIS
from postern.operators import attribution, audit, cases, correlate, enrich, evaluate, graph, report
from postern.sources import files
from postern.streaming import stateful

DOC = "id string, subject string, body string, domains array<string>, addresses array<string>, header_names array<string>, attachment_hashes array<string>, urls array<string>, file_types array<string>, risk double, confidence double, observed_ms bigint"


def docs(spark, rows):
    full = [(i, s, b, d, a, h, x, [], [], r, 0.7, t) for i, s, b, d, a, h, x, r, t in rows]
    return spark.createDataFrame(full, DOC)


def test_pair_scores_and_clusters(spark):
    same = ("invoice overdue", "please pay the overdue invoice now", ["kit.example"], ["1.1.1.1"])
    d = docs(spark, [("a", *same, ["x-mailer"], [], 50.0, 1), ("b", *same, ["x-mailer"], [], 50.0, 5), ("c", "other", "nothing alike", ["z.example"], ["9.9.9.9"], [], [], None, None)])
    p = correlate.pair_scores(d)
    r = p.first()
    assert p.count() == 1 and r["combined"] == pytest.approx(0.95) and r["infrastructure"] == 1.0
    m = correlate.clusters(p.filter("combined >= 0.62").select("a", "b"))
    assert {tuple(x) for x in m.collect()} == {("a", "a"), ("b", "a")}
    c = correlate.campaigns(d, m, p).first()
    assert c["size"] == 2 and c["risk"] == pytest.approx(75.0) and (c["first_ms"], c["last_ms"]) == (1, 5) and c["cohesion"] == pytest.approx(0.95) and c["dominant"] == "infrastructure"
    assert [r["id"] for r in correlate.unclustered(d, m).collect()] == ["c"]


def test_blocking_without_headers_loses_no_link(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((f"{i:02d}", rnd.choice(["pay now", "hello there", "old news"]), "", rnd.sample(["a.x", "b.x", "c.x"], rnd.randint(0, 2)), rnd.sample(["1", "2", "3"], rnd.randint(0, 2)), [], rnd.sample(["h"], rnd.randint(0, 1)), 1.0, 1))
    d = docs(spark, rows)
    ids = d.select(F.col("id").alias("a")).crossJoin(d.select(F.col("id").alias("b"))).filter("a < b")
    link = lambda p: {(r["a"], r["b"]) for r in p.filter("combined >= 0.62").collect()}
    assert link(correlate.pair_scores(d, ids)) == link(correlate.pair_scores(d, with_headers=False)) == link(correlate.pair_scores(d))
    assert link(correlate.pair_scores(d, ids)) == link(correlate.pair_scores(d, with_headers=False, tau=0.62))


def test_jaccard_and_idf(spark):
    j = lambda a, b: spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(correlate.jaccard("a", "b")).first()[0]
    assert j([], []) == 0 and j([], [1]) == 0 and j(None, [1]) == 0 and j([1, 2, 3], [2, 3, 4]) == 0.5 and j([1, 2], [1, 2, 3]) == pytest.approx(2 / 3)
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "a"])], "id int, tokens array<string>")
    got = {r["term"]: r["idf"] for r in correlate.idf(t).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(1.6931471805599454)
    assert correlate.tfidf(t.filter("id > 9")).count() == 0


def test_components_shapes(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (None, 3), (101, 100)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_campaign_risk(spark):
    def r(*v):
        return spark.createDataFrame([(x,) for x in v], "r double").agg(correlate.campaign_risk(F.col("r"))).first()[0]

    assert r(*[50.0] * 5) == pytest.approx(96.875) and r(100.0, 10.0) == 100 and r(0.0, 0.0) == 0 and r(None) is None and r(50.0, None) == pytest.approx(50)


HOPS = "msg_no int, hop_no int, hopindex int, ip string, host string, protocol string, ts timestamp"


def test_attribution(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        (1, 1, 0, "8.8.8.8", "a", "ESMTP", t(5)), (1, 2, 1, "9.9.9.9", "b", "HTTP", t(3)),
        (2, 3, 0, "10.0.0.1", "a", "SMTP", None), (3, 4, 0, "8.8.8.8", None, None, t(1)), (3, 5, 1, "1.1.1.1", "c", "SMTP", t(4)),
    ]
    got = {r["msg_no"]: r for r in attribution.attribute(spark.createDataFrame(rows, HOPS)).collect()}
    assert got[1]["primary_ip"] == "9.9.9.9" and got[1]["basis"] == "TIMESTAMP" and got[1]["originating"] and not got[1]["contradicted"] and got[1]["indicators"] == 1
    assert got[2]["primary_ip"] is None and got[2]["value"] == 0 and got[2]["band"] == "INSUFFICIENT"
    assert got[3]["contradicted"] and got[3]["n_public"] == 2
    assert attribution.attribute(spark.createDataFrame([], HOPS)).count() == 0


def test_longest_prefix_and_providers(spark):
    nets = spark.createDataFrame([(1, "10.0.0.0/8", "A"), (2, "10.1.0.0/16", "B"), (3, "10.1.0.0/16", "C"), (4, "10.1.2.3", "D"), (5, "x/1", "E")], "row_no int, net string, country string")
    ips = spark.createDataFrame([(x,) for x in ("10.1.2.3", "10.1.9.9", "10.9.9.9", "11.0.0.1", None, "zz")], "ip string")
    assert {r["ip"]: r["country"] for r in enrich.longest_prefix(ips, nets).collect()} == {"10.1.2.3": "D", "10.1.9.9": "B", "10.9.9.9": "A"}
    one = spark.createDataFrame([("10.1.2.3", "-", "org")], "ip string, country string, organization string")
    two = spark.createDataFrame([("10.1.2.3", "SE")], "ip string, country string")
    r = {x["ip"]: x for x in enrich.provider_join(ips, [("p", one, True), ("q", two, True)]).collect()}
    assert (r["10.1.2.3"]["country"], r["10.1.2.3"]["country_source"], r["10.1.2.3"]["organization_source"]) == ("SE", "q", "p") and r["zz"]["asn_status"] == "UNKNOWN"
    down = enrich.provider_join(ips, [("p", one, True), ("q", two, False)]).filter("ip = 'zz'").first()
    assert down["country_status"] == "UNAVAILABLE"


def test_audit_chain(spark):
    ev = [{"event": "e", "subject": str(i), "ts": "2024-01-01T00:00:00Z"} for i in range(5)]
    lines = audit.chain_records(ev)
    log = lambda ls: spark.createDataFrame(list(enumerate(ls)), "pos bigint, line string")
    v = audit.verify_chain(log(lines)).first()
    assert v["ok"] and v["records"] == 5 and v["head"] == json.loads(lines[-1])["hash"]
    bad = [*lines[:3], lines[3].replace('"subject":"3"', '"subject":"9"'), lines[4]]
    v = audit.verify_chain(log(bad)).first()
    assert (v["ok"], v["divergence"], v["reason"]) == (False, 3, "hash mismatch")
    with pytest.raises(ValueError):
        audit.append(spark, log(bad), ev)
    empty = audit.verify_chain(spark.createDataFrame([], "pos bigint, line string")).first()
    assert empty["ok"] and empty["head"] == GENESIS
    more = audit.append(spark, log(lines), ev[:1])
    assert audit.verify_chain(log(lines + more)).first()["ok"]
    assert audit.verify_chain(log([*lines[:2], "{broken", *lines[3:]])).first()["reason"] == "not valid JSON"


def test_case_pages(spark):
    s = "case_no bigint, id string, title string, status string, subject string, messageid string, observedat bigint, domains array<string>, urls array<string>, attachmenthashes array<string>, risk double"
    rows = [(i, f"c{i}", None, "open", "Pay ME" if i % 2 else None, None, -1 if i == 3 else i, ["x.test", None], None, None, None) for i in range(6)]
    df = spark.createDataFrame(rows, s)
    assert [r["case_no"] for r in cases.search(df, "pay me").collect()] == [5, 1, 3]
    assert cases.search(df, "X.TEST", page=2).count() == 0 and cases.search(df, "", "closed").count() == 0
    for bad in ({"page": 0}, {"page_size": 0}, {"page": 100_001}, {"status": "odd"}):
        with pytest.raises(ValueError):
            cases.search(df, **bad)


RAW = b"Received: from a.test (a.test [9.9.9.9]) by b.test with ESMTP id 7 for <x@y.test>; Mon, 1 Jan 2024 00:00:00 +0000\r\nReceived: from ([8.8.8.8]) by c.test\r\nFrom: \"Doe, J\" <j@X.test>, grp: a@b.test;\r\nSubject: one\r\n two\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\npre\r\n--B\r\nContent-Type: text/html\r\n\r\n<b>h</b>\r\n--B\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\na=3Db=\r\nc\r\n--B--\r\n"


def test_mail_parser(spark):
    m = mailparse.parse("1", RAW)
    assert m["subject"] == "one two" and m["body"] == "a=bc" and [p["content_type"] for p in m["parts"]] == ["multipart/mixed", "text/html", "text/plain"]
    assert m["hops"][0]["host"] == "a.test" and m["hops"][0]["ip"] == "9.9.9.9" and m["hops"][0]["date"].startswith("Mon") and m["hops"][0]["for"] == "<x@y.test>"
    assert m["hops"][1]["host"] is None
    assert (m["from_addr"][0]["display"], m["from_addr"][0]["domain"]) == ("Doe, J", "x.test")
    deep = b"".join(b"Content-Type: multipart/mixed; boundary=b%d\r\n\r\n--b%d\r\n" % (i, i) for i in range(12)) + b"x"
    assert "MIME_DEPTH_EXCEEDED" in mailparse.parse("2", deep)["warnings"]
    assert "HEADER_COUNT_EXCEEDED" in mailparse.parse("3", b"A: 1\r\n" * 600)["warnings"]
    for hostile in (b"", None, b"\x00" * 100, b":::\r\n\r\n", b"\r\n", os.urandom(5000), b"A" * 100_000):
        mailparse.parse("h", hostile)
    df = spark.createDataFrame([("1", RAW), ("2", None)], "msg_id string, content binary")
    p = mailparse.parse_messages(df)
    assert p.count() == 2 and mailparse.hop_rows(p).count() == 2 and mailparse.part_rows(p).count() == 4


def test_sources(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(RAW)
    assert files.read_mail(spark, str(tmp_path)).count() == 1
    (tmp_path / "c.ndjson").write_text('{"id":"a","risk":1.0,"observedAt":-1}\nnot json\n{"id":"b","domains":["x"]}\n')
    good, bad = files.read_cases(spark, str(tmp_path / "c.ndjson"))
    assert good.count() == 2 and bad.count() == 1 and good.filter("id = 'a'").first()["observedAt"] is None
    (tmp_path / "n.tsv").write_text("# c\nip\tcountry\tasn\torg\tisp\thost\n10.0.0.0/8\tSE\t-\tunknown\tx\ty\nbad\tSE\t1\t1\t1\t1\n")
    rows = files.read_networks(spark, str(tmp_path / "n.tsv")).collect()
    assert len(rows) == 1 and rows[0]["asn"] is None
    (tmp_path / "f.tsv").write_text("U+0430\ta\tCyrl\tn\n")
    assert files.read_confusables(spark, str(tmp_path / "f.tsv")) == {"а": "a"}
    (tmp_path / "g.tsv").write_text("U+0430\ta\tCyrl\tn\nа\tb\tCyrl\tn\n")
    with pytest.raises(ValueError):
        files.read_confusables(spark, str(tmp_path / "g.tsv"))
    files.write_model(str(tmp_path / "m.json"))
    assert len(files.read_model(str(tmp_path / "m.json")).beta) == 8
    j = spark.createDataFrame([('{"a":1}',), ('{"a":1} x',), ("[" * 80 + "]" * 80,), (None,), ('"\n"',)], "v string")
    assert [r["valid"] for r in files.strict_json(j, "v").collect()] == [True, False, False, None, False]
    assert files.read_profile(spark, None)["brands"] == []
    (tmp_path / "x.mbox").write_text("From a\nSubject: 1\n\nx\n\nFrom b\nSubject: 2\n\n>From y\n")
    assert files.read_mbox(spark, str(tmp_path / "x.mbox")).count() == 2


def test_lockout_batch_equals_stream(spark, tmp_path):
    minute = 60_000
    rows = [("a", i * minute, False, i) for i in range(6)] + [("a", 19 * minute, True, 7), ("a", 21 * minute, False, 8), ("b", 0, False, 9), ("b", 1, True, 10)]
    df = spark.createDataFrame(rows, "account string, ts_ms bigint, ok boolean, seq bigint")
    batch = {r["seq"]: (r["failures"], r["locked"]) for r in stateful.lockout_batch(df).collect()}
    assert batch[4] == (5, True) and batch[5][1] and batch[7] == (0, False) and batch[8] == (1, False) and batch[10] == (0, False)
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.lockout_stream(s).writeStream.format("memory").queryName("locks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60  # the stream goes on by itself, to let state time out
    while spark.table("locks").count() < len(rows) and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert {r["seq"]: (r["failures"], r["locked"]) for r in spark.table("locks").collect()} == batch


def test_batch_campaigns(spark):
    e = spark.createDataFrame([(1, "1", "x"), (2, None, "x"), (3, "2", "y"), (4, None, None)], "msg bigint, ip string, domain string")
    assert {tuple(r) for r in stateful.campaigns_batch(e).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_evaluation(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first()[0] == pytest.approx(4.5 / 6)
    assert evaluate.threshold_for_fpr(df, "s", "y", 0.0).first()["tau"] == pytest.approx(0.8)
    assert evaluate.calibration_error(df, "s", "y").first()["brier"] == pytest.approx((0.01 + 0.16 + 0.4225 + 0.04 + 0.36) / 5)


def test_pdf():
    out = report.pdf(["a (b)", "é"])
    assert out.startswith(b"%PDF-1.4") and out.count(b" obj") == 6 + 0 and out.rstrip().endswith(b"%%EOF")

"""Parser, dates, features, models, documents, reports and evaluation on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from postern.functions import headers, mailparse, scoring, text
from postern.functions import lexicons as L
from postern.operators import attribution, correlate, documents, enrich, evaluate, features, fitting, report, stix
from postern.sources import files


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("o")).collect())]


def parse(raw, mode="features"):
    return mailparse.parse("m", raw.replace("\n", "\r\n").encode(), mode)


NESTED = """Return-Path: <bounce@[192.0.2.7]>
Received: from a.test (a.test [10.0.0.1]) by b.test with ESMTP id 1; Mon, 30 Dec 2024 12:00:00 +0000
Authentication-Results: edge; arc=none
Authentication-Results: mx; spf=softfail x; dkim=pass; dmarc=fail(p=reject)
DKIM-Signature: v=1; d=Other.Test; s=k
From: Support Team <me@kit.test>
Reply-To: x@gmail.com
Subject: URGENT
 folded
Date: Mon, 30 Dec 2024 14:00:00 +0000
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=bb

--bb
Content-Type: multipart/alternative; boundary="cc"

--cc
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: quoted-printable

<b>=C3=A9</b>
--cc--
--bb
Content-Type: text/plain; charset=utf-8

see http://user@evil.test/ and sign in
--bb
Content-Type: application/zip
Content-Disposition: attachment; filename="a.pdf.exe"

PK
--bb--
"""


def vector(spark, raw, **k):
    p = mailparse.parse_messages(spark.createDataFrame([("1", bytearray(raw.replace("\n", "\r\n").encode()))], "msg_id string, content binary"), "features")
    row = features.vectors(features.mail_columns(p), {"0": "o"}, **k).first()
    return dict(zip(L.FEATURES, row["x"], strict=True))


def test_bodies_of_both_rule_sets():
    assert parse(NESTED)["body"] == "see http://user@evil.test/ and sign in" and parse(NESTED, "evidence")["body"] == "see http://user@evil.test/ and sign in"
    single = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nw6k="
    assert parse(single)["body"] == "w6k=" and parse(single, "evidence")["body"] == "é"  # the scoring reads a lone body as it stands
    only_inner = NESTED.split("--bb\nContent-Type: text/plain")[0] + "--bb--\n"
    assert parse(only_inner)["body"] == "<b>=C3=A9</b>" and parse(only_inner, "evidence")["body"] == "<b>é</b>"
    many = "".join(f"Received: from h{i} by x; d\n" for i in range(40)) + "Subject: s\n\nb"
    assert parse(many)["warnings"] == ["RECEIVED_COUNT_EXCEEDED", "PARSE_TRUNCATED"] and sum(h["name"] == "received" for h in parse(many)["headers"]) == 25 and parse(many)["subject"] == "s"
    assert len(parse(many, "evidence")["hops"]) == 40 and parse(many, "evidence")["warnings"] == []


def test_what_is_cut_is_said():
    lines = "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + "QUJD\n" * 2100
    mixed = "Content-Type: multipart/mixed; boundary=b\n\n--b\n" + lines + "--b--\n"
    assert parse(mixed)["warnings"] == ["BASE64_LINE_LIMIT_EXCEEDED", "PARSE_TRUNCATED"] and parse(mixed, "evidence")["warnings"] == []
    assert len(parse(mixed, "evidence")["body"]) == 6300 and len(parse(mixed)["body"]) == 6003
    links = "Subject: s\n\n" + "http://a.test/x " * 1001
    assert parse(links)["warnings"] == ["URL_LIMIT_EXCEEDED", "PARSE_TRUNCATED"] and parse(links, "evidence")["warnings"] == []
    long = "Subject: " + "x" * 9000 + "\n\nb"
    assert parse(long)["warnings"] == ["HEADER_LINE_TRUNCATED", "PARSE_TRUNCATED"] and parse(long, "evidence")["warnings"] == ["HEADER_LINE_EXCEEDED", "PARSE_TRUNCATED"]
    parts = "Content-Type: multipart/mixed; boundary=b\n\n" + "--b\nContent-Type: text/plain\n\nx\n" * 300 + "--b--\n"
    assert parse(parts, "evidence")["warnings"] == ["MIME_PART_LIMIT", "PARSE_TRUNCATED"] and parse(parts)["warnings"][0] == "MIME_PART_LIMIT_EXCEEDED"


def test_registry_answers(spark):
    import json

    card = lambda name: ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", name], ["adr", {}, "text", ["", "", "", "de"]]]]
    docs = [
        {"networks": [None, {"name": "N1"}, {"country": "at", "entities": [{"roles": ["Registrant"], "vcardArray": card("Org One")}, {"roles": ["administrative"], "handle": "H-1"}]}]},
        {"handle": "AS64500", "name": "root", "entities": [{"roles": ["registrant"], "vcardArray": [["fn", "adr"], {"fn": "Flat Org", "adr": ["a", "b", "c", "se"]}]}]},
        {"name": "x", "remarks": [{"description": [" ", "host.test"]}]}, [], "text",
    ]
    rows = [json.dumps(d) for d in docs] + ["{", "", None]
    got = values(spark, enrich.parse_rdap, rows)
    keys = ("country", "hostname", "organization", "isp", "asn")
    assert [tuple(g[k] for k in keys) for g in got[:3]] == [("AT", "N1", "Org One", "H-1", None), ("SE", "root", "Flat Org", None, "AS64500"), (None, "host.test", None, None, None)]
    assert all(all(g[k] is None for k in keys) for g in got[3:])


def test_files_that_are_missing_or_long(spark, tmp_path):
    assert files.read_profile(spark, str(tmp_path / "none.json"))["brands"] == []
    (tmp_path / "c.ndjson").write_text('{"id": "a", "risk": 1.0}\n\nnot json\n{"id": "b"}\n{"id": "c"}\n')
    whole = files.scan_cases(spark, str(tmp_path / "c.ndjson"))
    part = files.scan_cases(spark, str(tmp_path / "c.ndjson"), records=2)
    assert ([r["id"] for r in whole[0].collect()], whole[1]) == (["a", "b", "c"], False) and ([r["id"] for r in part[0].collect()], part[1]) == (["a", "b"], True)
    small = files.scan_cases(spark, str(tmp_path / "c.ndjson"), size=30)
    assert ([r["id"] for r in small[0].collect()], small[1]) == (["a"], True)


def test_features_of_a_message(spark):
    x = vector(spark, NESTED, brands=["kits"], executives=["Ann Lee"])
    want = {
        "spf_fail": 1, "spf_none": 0, "dkim_fail": 0, "dkim_absent": 0, "dmarc_fail": 0, "dmarc_policy_strict": 1, "alignment_from_spf": 1, "alignment_from_dkim": 1, "replyto_mismatch": 1, "replyto_free_mail": 1, "messageid_anomaly": None,
        "received_count_n": 0.125, "received_private_hop": 1, "received_missing_from": 0, "date_skew": 2 / 1440, "domain_age_unknown": 1, "domain_age_inv": None, "lookalike_strong": 1, "urgency": 0.4 / 1.5, "exec_impersonation": 0,
        "credential_form_host": 1, "at_in_url": 1, "attachment_dangerous": 1, "attachment_double_ext": 1, "attachment_count_n": 0.25, "helo_mismatch": None, "ip_in_blacklist": None, "tone_incongruence": 0.4 / 3,
    }
    assert {k: x[k] for k in want} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_an_empty_message_has_a_vector(spark):
    x = vector(spark, "")
    assert x["spf_none"] == 1 and x["received_count_n"] == 0 and x["lookalike_strong"] is None and x["subdomain_depth"] is None and x["urgency"] == 0


def test_link_texts(spark):
    got = values(spark, features.anchor_mismatch, ['<a href="https://real.test/x">fake</a> <a href="https://real.test/y">at real.test</a>', "<a href=//a.b.test/>B</a>", "<a name=x>y</a>", "<a href='x'", "none", "", None])
    assert got[:6] == [0.5, 0.0, 0.0, 0.0, 0.0, 0.0] and got[6] in (None, 0.0)


def test_dates_of_both_rule_sets(spark):
    noon = 1735560000
    sec = lambda f: lambda c: F.unix_seconds(f(c))
    exact = values(spark, sec(lambda c: headers.header_date(c, tolerant=False)), ["Mon, 30 Dec 2024 12:00:00 +0000", "Sun, 30 Dec 2024 12:00:00 +0000", "30 Dec 2024 07:00 EST", "30 Dec 2024 13:00 CET", "30 dec 2024 12:00:00 +0000", "30 Dec 2024 12:00:00 +0000 (x)", "31 Nov 2024 12:00:00 +0000", "30 Dec 24 12:00:00 GMT", "", None])
    assert exact == [noon, noon, noon, noon, None, None, noon - 30 * 86400, None, None, None]
    scored = values(spark, sec(headers.scoring_date), ["Mon, 30 Dec 2024 12:00:00 +0000", "Sun, 30 Dec 2024 12:00:00 +0000", "30 Dec 2024  12:00 ut", "30 Dec 2024 11:00:00 A", "30 Dec 2024 13:00:00 N", "30 Dec 2024 12:00 K", "30 Dec 2024 12:00 EST", "30 Dec 2024 12:00:00 +0000 (x)", "x", "", None])
    assert scored == [noon, None, noon, noon, noon, None, None, None, None, None, None]


def test_numbers(spark):
    rows = [123456.789012345, 1e-12, 1e300, -0.0, 100.0, 24.328719, 1e10, 1e-4, None]
    assert values(spark, text.canonical_number, rows, "double") == ["123456.789", "1.000000000e-12", "1.000000000e+300", "0", "100", "24.328719", "1.000000000e+10", "0.0001", None]
    with pytest.raises(Exception, match="finite"):
        values(spark, text.canonical_number, [float("nan")], "double")


def test_score_equals_array_form_and_takes_any_model(spark, tmp_path):
    x = [None if i % 4 == 0 else (i % 11) / 10 for i in range(60)]
    df = spark.createDataFrame([(1, x), (2, [None] * 60), (3, None)], "id int, x array<double>")
    s = {r["id"]: r for r in scoring.score(df).collect()}
    z = df.select("id", scoring.logits("x").alias("z")).collect()
    assert s[1]["z"] == pytest.approx(z[0]["z"]) and sum(s[1]["p"]) == pytest.approx(1) and s[2]["z"] == L.INTERCEPTS and s[3]["p"] is None and s[3]["band"] is None
    odd = scoring.Model(beta=[[9.0 if i == 1 else 0.01 * i for i in range(60)] for _ in range(8)], temperature=2.0, weights_source="fitted")
    files.write_model(str(tmp_path / "m.json"), "fitted", odd)
    assert files.read_model(str(tmp_path / "m.json")) == odd and odd.family_weights() is None and scoring.Model().family_weights() is not None
    r = scoring.score(df, model=odd).filter("id = 1").first()
    want = [b + sum(max(-2.5, min(2.5, w * (v or 0))) for w, v in zip(row, x, strict=True)) for b, row in zip(odd.b0, odd.beta, strict=True)]
    assert r["z"] == pytest.approx(want)
    with pytest.raises(Exception, match="60 features"):
        scoring.score(spark.createDataFrame([([1.0],)], "x array<double>")).collect()


def test_fit_learns_and_is_calibrated(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, (k := i % 3), [1.0 if j == k * 10 and rnd.random() < 0.9 else (None if j % 7 == 0 and j != k * 10 else 0.1 * rnd.random()) for j in range(60)]) for i in range(600)]
    m, figures = fitting.fit(spark.createDataFrame(rows, "id int, label int, x array<double>"))
    assert m.weights_source == "fitted" and figures["test_accuracy"] > 0.85 and len(m.beta) == 8


def test_value_sets(spark):
    p = mailparse.parse_messages(spark.createDataFrame([("1", bytearray(NESTED.replace("\n", "\r\n").encode())), ("2", None)], "msg_id string, content binary"))
    r = {x["msg_id"]: x for x in documents.message_sets(p).collect()}
    assert r["1"]["mailboxes"] == ["me@kit.test"] and r["1"]["hop_ips"] == ["10.0.0.1"] and r["1"]["candidate_ips"] == ["10.0.0.1", "192.0.2.7"] and r["1"]["domains"] == ["a.test", "kit.test"]
    assert r["1"]["reply_domains"] == ["[192.0.2.7]", "gmail.com", "kit.test"] and r["1"]["file_types"] == ["application/zip", "text/html", "text/plain"] and len(r["1"]["attachment_hashes"]) == 1
    assert r["2"]["header_names"] == [] and r["2"]["domains"] == []
    assert documents.production_documents(p).filter("id = '1'").first()["observed_ms"] == 1735560000000 == documents.library_documents(p).filter("id = '1'").first()["observed_ms"]


def test_hints_supersede(spark):
    rows = [(1, "A.test ", 5, None), (2, "a.test", None, True), (3, "a.test", 9, False), (4, "", 1, True)]
    got = attribution.domain_hints(spark.createDataFrame(rows, "row_no int, domain string, age_days int, mx boolean")).collect()
    assert [tuple(r) for r in got] == [("a.test", 9, False)]
    with pytest.raises(Exception, match="negative"):
        attribution.domain_hints(spark.createDataFrame([(1, "a", -1, None)], "row_no int, domain string, age_days int, mx boolean")).collect()


def test_single_pairs(spark):
    df = spark.createDataFrame([(1, 2, ["a", "a", "b"], ["a", "c"]), (3, 4, [], ["x"]), (5, 6, ["q"], ["q"])], "a int, b int, tokens_a array<string>, tokens_b array<string>")
    import math

    i = 1 + math.log(1.5)
    want = (1 + math.log(2)) / math.sqrt((1 + math.log(2)) ** 2 + i * i) / math.sqrt(1 + i * i)
    assert {(r["a"], round(r["cosine"], 9)) for r in correlate.single_pairs(df).collect()} == {(1, round(want, 9)), (3, 0.0), (5, 1.0)}


def test_pdf_has_all_lines_on_pages():
    body = report.pdf([f"line {i} (x)" for i in range(150)] + ["w" * 50 + " " + "v" * 90])
    assert body.startswith(b"%PDF-") and body.count(b"/Type /Page /Parent") == 3 and all(f"line {i} ".encode() in body for i in range(150)) and b"v" * 90 in body
    assert report.pdf([]).count(b"/Type /Page /Parent") == 1


def test_bundles_say_what_is_left_out(spark):
    objects = spark.createDataFrame([(1, "url", f"http://a/{i}", f"id{i}") for i in range(5)], "case_no int, type string, value string, stix_id string")
    assert [(r["n_objects"], r["left_out"]) for r in [stix.bundles(objects).first(), stix.bundles(objects, 3).first()]] == [(5, 0), (3, 2)]


def test_curve_areas_equal_plain_sums(spark):
    import random

    rnd = random.Random(4)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(400)]
    got = evaluate.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    t = f = roc = pr = 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        t1, f1 = t + sum(y for v, y in rows if v == s), f + sum(1 - y for v, y in rows if v == s)
        now = t1 / (t1 + f1)
        roc, pr = roc + (f1 - f) * (t + t1) / 2, pr + (t1 - t) * (now + (t / (t + f) if t + f else now)) / 2
        t, f = t1, f1
    assert got["roc_auc"] == pytest.approx(roc / pos / neg) and got["pr_auc"] == pytest.approx(pr / pos)


def test_mcnemar_and_retention(spark):
    df = spark.createDataFrame([("a", "a", "b")] * 12 + [("a", "b", "a")] * 3 + [("a", "a", "a")] * 5, "t string, x string, y string")
    r = evaluate.mcnemar(df, "t", "x", "y").first()
    assert (r["only_first"], r["only_second"], r["chi2"]) == (12, 3, pytest.approx(5.4)) and r["p"] == pytest.approx(0.0201, abs=1e-4)
    cases = spark.createDataFrame([(1, "c1", 0, "call 555-123-4567", None), (2, "c2", 90 * 86_400_000, "x", "a@b.test"), (3, "c3", None, None, None)], "case_no int, id string, createdat bigint, title string, subject string")
    kept, gone = evaluate.retention(cases, 100 * 86_400_000, 30)
    assert {(r["case_no"], r["subject"]) for r in kept.collect()} == {(2, "[EMAIL_REDACTED]"), (3, None)} and [tuple(r) for r in gone.collect()] == [(1, "c1", 100, "older than 30 days")]


def test_thread_hijack(spark):
    rows = [(1, 1, "Delivery", ["a"], "1"), (2, 2, "Re: delivery", ["a"], "1"), (3, 3, "RE: Fwd: Delivery", ["a"], "2"), (4, 1, "Invoice", ["b"], "1"), (5, 2, "re: invoice", ["b"], "9"), (6, 3, "Re: invoice", ["b"], None), (7, 1, None, None, "1")]
    got = {r["id"]: r["hijack"] for r in evaluate.thread_hijack(spark.createDataFrame(rows, "id int, seq int, subject string, domains array<string>, origin string")).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False}


def test_folding_of_one_string_is_the_columns(spark):
    table = {"а": "a", "0": "o", "ы": "bl"}
    rows = ["Pаy0​", "ｆｕｌｌ ы", "é­"]
    assert values(spark, lambda c: text.skeleton(c, table), rows) == [text.fold_text(r, table) for r in rows]


def test_evaluation_without_rows_or_with_one_class(spark):
    none = spark.createDataFrame([], "s double, y int, t string, x string, z string")
    ones = spark.createDataFrame([(0.5, 1, "a", "a", "b"), (0.7, 1, "a", "b", "b")], "s double, y int, t string, x string, z string")
    for df, pr in ((none, None), (ones, 1.0)):
        assert tuple(evaluate.roc_auc(df, "s", "y").first()) == (None, pr)
        assert evaluate.recall_at_fpr(df, "s", "y").first()["recall"] == (1.0 if pr else 0.0)
    assert tuple(evaluate.overall(none, "t", "x").first()) == (None, None, None) and evaluate.mcnemar(none, "t", "x", "z").first()["p"] == 1.0
    assert tuple(evaluate.calibration_error(none, "s", "y").first()) == (None, None, None) and tuple(evaluate.bootstrap_mean(none, "t", "s", 5).first()) == (None, None, None)
    with pytest.raises(ValueError, match="no labelled rows"):
        fitting.fit(spark.createDataFrame([], "id int, label int, x array<double>"))


def test_empty_tables_and_clashing_names(spark):
    empty = spark.createDataFrame([], "msg_id string, content binary")
    assert features.vectors(features.mail_columns(mailparse.parse_messages(empty, "features")), {}).count() == 0 and documents.message_sets(mailparse.parse_messages(empty)).count() == 0
    docs = spark.createDataFrame([], "id string, domains array<string>, addresses array<string>")
    assert correlate.candidates(docs, False, 0.62).count() == 0 and correlate.single_pairs(spark.createDataFrame([], "a int, b int, tokens_a array<string>, tokens_b array<string>")).count() == 0
    odd = spark.createDataFrame([(1, [0.5] * 60, "kept", 3)], "id int, x array<double>, z0 string, score int")
    assert scoring.score(odd).first()["z0"] == "kept"
    assert evaluate.thread_hijack(spark.createDataFrame([], "id int, seq int, subject string, domains array<string>, origin string")).count() == 0
    assert attribution.domain_hints(spark.createDataFrame([], "row_no int, domain string, age_days int, mx boolean")).count() == 0

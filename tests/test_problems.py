"""Repeated deliveries, nested records, timestamps."""

import datetime as dt
import json

import pytest

from postern.operators import instants, nested, upsert

CASES = "case_no bigint, messageid string, evidencehash string, ingestedat timestamp, batch_id string, ident string, arrival string"


def t(h):
    return dt.datetime(2024, 1, 1, h)


def dropped(spark, rows, schema=CASES, **k):
    return sorted(r[0] for r in upsert.duplicate_deliveries(spark.createDataFrame(rows, schema), **k).collect())


def test_copies_collapse_across_batches_ties_and_spelling(spark):
    rows = [
        (1, "<A@x>", "FF", t(3), "b1", None, None),
        (2, " a@X ", "ff", t(2), "b2", None, None),  # earliest copy stays
        (3, "a@x", "ff", t(2), "b1", None, None),  # tie in time: lower number stays
        (4, None, "ee", t(1), None, None, None),
        (5, "  ", "EE", t(1), "b9", None, None),  # blank and null ids are equal
        (6, "a@x", None, t(1), "b1", None, None),  # no hash: never a copy
        (7, "a@x", None, t(1), "b1", None, None),
        (8, "z", "dd", None, "b1", None, None),  # no time: latest
        (9, "z", "dd", t(9), "b1", None, None),
        (10, "z", "dd", t(9), "b1", None, None),
    ]
    assert dropped(spark, rows) == [1, 3, 5, 8, 10]
    assert dropped(spark, rows, runs=1) == [1, 3, 5, 8, 10]
    assert dropped(spark, rows[::-1], runs=5) == [1, 3, 5, 8, 10]
    assert dropped(spark, []) == []


def test_upsert_is_idempotent(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), ("m", 5)], "key string, n bigint")
    s = upsert.UpsertStore(spark, buckets=4)
    for _ in range(2):
        s.upsert(df, "a", "key", ["n"])
    s.upsert(df, "b", "key", ["n"])
    assert {(r["ident"], r["arrival"]["n"]) for r in s.compact().collect()} == {("k", 1), ("m", 5)}
    assert s.compact().count() == 2
    with pytest.raises(ValueError):
        upsert.UpsertStore(spark).compact()


def test_compaction_has_no_exchange(spark):
    df = spark.range(100).selectExpr("cast(id % 7 as string) key", "id n")
    s = upsert.UpsertStore(spark, buckets=4)
    s.upsert(df, "a", "key", ["n"])
    s.upsert(df, "b", "key", ["n"])
    spark.conf.set(upsert.ORDERED, "true")
    plan = s.merged("a", "b")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(upsert.ORDERED, "false")
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Sort [" not in plan
    assert s.compact().count() == 7 and len(s.runs) == 1


def test_store_opens_again_and_survives_a_lost_write(spark):
    df = spark.range(60).selectExpr("concat('k', id % 9) key", "id n")
    s = upsert.UpsertStore(spark, buckets=4)
    s.upsert(df.filter("n < 30"), "a", "key", ["n"])
    s._write(df.selectExpr("key AS ident", "struct(false AS n_unset, n) AS arrival").limit(1).repartition(4, "ident"))  # written, never named
    again = upsert.UpsertStore(spark, path=s.path)
    assert again.buckets == 4 and again.runs == s.runs
    again.upsert(df.filter("n >= 30"), "b", "key", ["n"])
    for folder in again.runs.values():
        spark.sql(f"DROP TABLE {folder}")  # as in a new session
    third = upsert.UpsertStore(spark, path=s.path)
    assert {(r["ident"], r["arrival"]["n"]) for r in third.compact().collect()} == {(f"k{i}", i) for i in range(9)}
    assert upsert.UpsertStore(spark, path=s.path).runs == third.runs and len(third.runs) == 1


ATTR = "struct<candidates:array<struct<ip:string,scope:string,origin:string,isprimary:boolean,sightings:array<struct<feed:string,seenat:bigint,tags:array<string>>>>>>"
NEST = f"case_no bigint, attribution {ATTR}, attributionraw string, members array<string>, nodes string, pos int"


def children(spark, rows):
    return sorted(tuple(r) for r in nested.case_children(spark.createDataFrame(rows, NEST)).collect())


def test_children_of_structs_keep_places(spark):
    s = lambda f: (f, 1, None)
    a = ([("1.1.1.1", "P", None, True, [s("f1"), None, s("f2")]), None, (None, None, None, None, None)],)
    got = children(spark, [(1, a, None, ["m", None, "n"], "x", 9), (2, None, None, None, None, None), (3, ([],), None, [], None, 1)])
    assert got == [(1, "candidate", 0, -1, "1.1.1.1"), (1, "candidate", 2, -1, ""), (1, "member", 0, -1, "m"), (1, "member", 2, -1, "n"), (1, "sighting", 0, 0, "f1"), (1, "sighting", 0, 2, "f2")]
    assert children(spark, []) == []


@pytest.mark.parametrize(
    "wrap",
    [lambda c: {"candidates": c}, lambda c: {"attribution": {"candidates": c}}, lambda c: {"candidates": json.dumps(c)}, lambda c: {"attribution": json.dumps({"candidates": c})}],
)
def test_children_of_json_text_of_any_shape(spark, wrap):
    one = {"ip": "9.9.9.9", "sightings": [{"feed": "f"}]}
    assert children(spark, [(1, None, json.dumps(wrap(one)), None, None, None)]) == [(1, "candidate", 0, -1, "9.9.9.9"), (1, "sighting", 0, 0, "f")]
    many = children(spark, [(1, None, json.dumps(wrap([None, one])), None, None, None)])
    assert many == [(1, "candidate", 1, -1, "9.9.9.9"), (1, "sighting", 1, 0, "f")]


def test_unreadable_json_has_no_children(spark):
    for raw in ("", "{", "[1, 2", "null", '"text"', "[]", '{"candidates": 5}', "x" * 100_000):
        assert children(spark, [(1, None, raw, None, None, None)]) == []


def test_interval_labels_nest(spark):
    a = ([("1.1.1.1", "P", None, True, [("f1", 1, None), ("f2", 1, None)]), ("2.2.2.2", None, None, None, [])],)
    nodes = nested.case_tree(spark.createDataFrame([(1, a, None, ["m"], None, None)], NEST)).first()["nodes"]
    assert [n["pre"] for n in nodes] == [1, 2, 3, 4, 5]
    assert [(n["kind"], n["post"]) for n in nodes] == [("candidate", 2), ("sighting", 0), ("sighting", 1), ("candidate", 3), ("member", 4)]


VALUES = "src string, rec_no bigint, host string, value string"


def read(spark, values, sites=(("h", "America/New_York", "mdy"), ("d", "Europe/Berlin", "dmy"))):
    s = spark.createDataFrame(list(sites), "byhost string, clockzone string, dayorder string")
    rows = [("t", i, *((v if isinstance(v, tuple) else ("d", v)))) for i, v in enumerate(values)]
    out = instants.normalise(spark.createDataFrame(rows, VALUES), s).collect()
    return {r["rec_no"]: r for r in out}


def ms(*a, off=0):
    return int(dt.datetime(*a, tzinfo=dt.timezone(dt.timedelta(minutes=off))).timestamp() * 1000)


def test_notations(spark):
    cases = [
        ("Mon, 30 Dec 2024 23:58:26 +0900", ms(2024, 12, 30, 23, 58, 26, off=540)),
        ("Tue, 30 Dec 2024 23:58 -0000 (a comment)", ms(2024, 12, 30, 23, 58)),
        ("25 Jul 24 15:06:27 GMT", ms(2024, 7, 25, 15, 6, 27)),
        ("Thu, 25 Jul 2024 17:07:54 CEST", ms(2024, 7, 25, 17, 7, 54, off=120)),
        ("Sun, 02 Nov 2025 02:58:41 EST", ms(2025, 11, 2, 2, 58, 41, off=-300)),
        ("2024-09-10T09:21:59.3+05:30", ms(2024, 9, 10, 9, 21, 59, 300000, off=330)),
        ("2024-11-26T03:35:49.836720+01:00", ms(2024, 11, 26, 3, 35, 49, 836000, off=60)),
        ("2025-08-25 17:04:33 UTC", ms(2025, 8, 25, 17, 4, 33)),
        ("20240421T191016Z", ms(2024, 4, 21, 19, 10, 16)),
        ("20250125035808-0330", ms(2025, 1, 25, 3, 58, 8, off=-210)),
        ("2024-03-04T08:20:58[Europe/Berlin]", ms(2024, 3, 4, 8, 20, 58, off=60)),
        ("1737060174", 1737060174000),
        ("1716821130324", 1716821130324),
        ("1763765756935917", 1763765756935),
        ("15.01.2025 08:12:43", ms(2025, 1, 15, 8, 12, 43, off=60)),
        ("Sun Mar  9 03:54:42 2025", ms(2025, 3, 9, 3, 54, 42, off=60)),
        ("2024-10-27 02:30:00", ms(2024, 10, 27, 2, 30, off=120)),  # repeated hour: first pass
        (("h", "08/05/2025 03:37:36 PM"), ms(2025, 8, 5, 15, 37, 36, off=-240)),
        (("h", "12/01/2025 12:00:00 AM"), ms(2025, 12, 1, 0, 0, 0, off=-300)),
        (("d", "04/08/2024 19:49:10"), ms(2024, 8, 4, 19, 49, 10, off=120)),
    ]
    got = read(spark, [c[0] for c in cases])
    for i, (v, want) in enumerate(cases):
        assert i in got and got[i]["utc_ms"] == want, v


def test_nothing_is_stated(spark):
    bad = [None, "", "n/a", "-1", "32 Jan 2025 08:00:00 +0000", "Sun, 31 Feb 2024 10:00:00 +0000", "2024-13-04T00:00:00Z", "Sat, Oct 2024", "2024-01-01T00:00:00XYZ", ("none", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), "x" * 50_000, "2024-01-01T25:00:00Z", "2024-01-01T00:00:00[No/Where]"]
    assert read(spark, bad) == {}


def test_mixture_decides_and_marks_ambiguity(spark):
    sites = [("m", "UTC", None), ("e", "UTC", None)]
    seen = [("m", f"01/{d}/2024 00:00:00") for d in range(13, 29)] + [("m", "02/03/2024 00:00:00"), ("e", "02/03/2024 00:00:00"), ("e", "05/05/2024 00:00:00")]
    got = read(spark, seen, sites)
    assert got[16]["utc_ms"] == ms(2024, 2, 3) and got[16]["family"] == "slash_mdy"
    assert got[17]["ambiguous"] and not got[18]["ambiguous"] and not got[0]["ambiguous"]


def test_repeated_and_skipped_local_times_are_marked(spark):
    got = read(spark, ["2024-10-27 02:30:00", "2024-03-31 02:30:00", "2024-10-27 02:30:00 CET", "2024-10-27 01:59:59", "2024-10-27 03:00:00"])
    assert [got[i]["reason"] for i in range(5)] == ["repeated", "skipped", None, None, None] and got[1]["ambiguous"]


def test_bare_numbers_are_components(spark):
    got = read(spark, ["1737060174", "1716821130324", "1763765756935917", "20240910035127", "99999999999999"])
    assert [got[i]["family"] for i in sorted(got)] == ["epoch_s", "epoch_ms", "epoch_us", "compact"] and min(r["posterior"] for r in got.values()) > 0.99


def test_mixture_equals_a_plain_fit(spark):
    """The posterior of open dates against expectation-maximisation written out for two components."""
    seen = [("m", f"{d:02d}/01/2024 00:00:00") for d in range(13, 20)] + [("m", f"01/{d}/2024 00:00:00") for d in range(13, 29)] + [("m", f"{a:02d}/0{b}/2024 00:00:00") for a in range(1, 9) for b in range(1, 9) if a != b]
    got = read(spark, seen, [("m", "UTC", None)])
    n_dmy, n_mdy, n_both, p, q = 7, 16, 56, 0.1, 0.1
    for _ in range(25):
        share = p / (p + q)
        p, q = (1 + n_dmy + n_both * share) / (10 + len(seen)), (1 + n_mdy + n_both * (1 - share)) / (10 + len(seen))
    want = q / (p + q)
    assert got[len(seen) - 1]["family"] == "slash_mdy" and abs(got[len(seen) - 1]["posterior"] - want) < 1e-9

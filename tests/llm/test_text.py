"""Text operators: personal data, characters, set joins, packing, leaks, languages."""

import itertools
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from postern.llm import langid, leakage, packing, pii, queries, setjoin, unify
from tools.compare import connect, rows

NAMES = ["Corwen", "Hedda", "Zelma", "Yorick"]


def test_pii_bootstraps_unseen_layouts(spark):
    rows = []
    for i in range(40):
        n = NAMES[i % 4]
        rows += [
            f"Tel: +34 5{i:02d} 111 222\nDear Ms {n} Torb{'a' * (i % 5)}rford, hello", f"Tel: 030/2312{i % 10} 8{i:02d}\nSigned: {n} Ost{'e' * (i % 5)}lin", f"Tel: 030/2312{i % 10} 7{i:02d}",
            f"Write to a{i}@x.test soon", f"Write to b{i} [at] y [dot] test soon", f"Ticket 867-97-58{i:02d} is closed.", f"My insurance number is QQ18{i:02d}93C.", f"My insurance number is 984-27-19{i:02d}.",
            f"Address: {i + 1} Holham Road", f"Address: {i + 1} Varnau Close", "Our Support Team is away until Monday Morning.",
        ]
    rows += [None, "", "x" * 200_000, "984-27-1999"]
    df = spark.createDataFrame([("t", i, r, "clash") for i, r in enumerate(rows)], "src string, rec_no bigint, text string, val string")
    got = {(r["rec_no"], r["kind"], r["val"]) for r in pii.found(df).collect()}
    vals = {(k, v) for _, k, v in got}
    assert ("phone", "030/23121 801") in vals and ("email", "b3 [at] y [dot] test") in vals and ("idnum", "984-27-1907") in vals and ("street", "2 Varnau Close") in vals
    assert ("person", "Hedda Ostelin") in vals and ("person", "Corwen Torbrford") in vals
    assert not any("867-97" in v or "Support" in v or "Monday" in v for _, v in vals)
    m = {r["rec_no"]: r for r in pii.masked(df.filter("rec_no < 12 or rec_no >= 440")).collect()}
    assert len(m) == 16 and m[440]["text"] is None and m[441]["text"] == ""
    assert pii.found(df.limit(0)).count() == 0


def test_mask_keeps_the_rest(spark):
    df = spark.createDataFrame([("t", 1, "é mail a@b.test or c@d.test.")], "src string, rec_no bigint, text string")
    r = pii.masked(df).first()
    assert r["text"] == "é mail [EMAIL] or [EMAIL]." and r["n_masked"] == 2


def test_transducer():
    look, conflicts = unify.compile_lookalikes([(1, "U+0430", "a"), (2, "о", "o"), (3, "U+043Ｅ", "q"), (4, "U+0030", "o"), (5, None, "x")])
    assert look == {"а": "a", "о": "o"} and conflicts == [("о", "q", 3)]
    t = unify.Transducer(look)
    cases = [
        ("ｆｕｌｌ", "full"), ("pаypal", "paypal"), ("почта о", "почта о"), ("Béta", "Béta"), ("a​b c　d", "ab c d"), ("👨‍👩‍👧 ok", "👨‍👩‍👧 ok"), ("“x” – y", "“x” – y"), ("ofﬁce", "office"), ("0оl", "0ol"), ("", ""),
    ]
    for raw, want in cases:
        assert t.apply(raw) == want
        assert t.apply(t.apply(raw)) == t.apply(raw)


def test_changed_values(spark):
    cases = spark.createDataFrame([(1, "pаy", ["а.tеst", None, "plain"], "c"), (2, None, None, "c"), (3, "A ", [], "c"), (None, "ﬁ", [""], "c")], "case_no bigint, subject string, domains array<string>, value string")
    conf = spark.createDataFrame([(1, "U+0430", "a"), (2, "о", "o"), (3, "u+04３5", "e"), (4, None, None)], "row_no int, c0 string, c1 string")
    got = {tuple(r) for r in unify.changed_values(cases, conf).collect()}
    assert got == {("subject", 1, -1, "pay"), ("domains", 1, 0, "а.test"), ("subject", None, -1, "fi"), ("c0", 3, -1, "u+0435")}
    assert unify.changed_values(cases.limit(0), conf.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_set_join_equals_brute_force(spark, hot):
    rnd = random.Random(5)
    sets = [rnd.sample([f"i{k}" for k in range(9)] + ["hot"] * 1, rnd.randint(0, 6)) + (["hot"] if rnd.random() < 0.6 else []) for _ in range(90)] + [None, [None, " ", ""], ["HOT "], ["hot"]]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sets)], "id bigint, v array<string>, cid string")
    clean = [{x.strip().lower() for x in (s or []) if x and x.strip()} for s in sets]
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if clean[a] and clean[b] and len(clean[a] & clean[b]) >= 0.6 * len(clean[a] | clean[b]) - 1e-9}
    got = [tuple(r) for r in setjoin.similar_pairs(df, "id", setjoin.item_set("v"), 0.6, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_set_join_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, v array<string>")
    assert setjoin.similar_pairs(df, "id", setjoin.item_set("v")).count() == 0


def test_classes_are_cut_into_parts(spark):
    rows = [(i, ["same", "set"], "x") for i in range(40)] + [(100, ["same", "set", "more"], "x"), (101, ["z"], "x"), (102, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, v array<string>, part string")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40)} | {(a, 100) for a in range(40)}
    for block in (3, 2000):
        got = setjoin.similar_pairs(df, "id", setjoin.item_set("v"), block=block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_links_hold_on_items(spark):
    classes = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1", "2", "3"]), ("c", ["8", "9"])], "cid string, items array<string>")
    links = spark.createDataFrame([("a", "b"), ("a", "c")], "cid_a string, cid_b string")  # the second as if hashes had collided
    assert [tuple(r) for r in setjoin.confirmed(links, classes, 0.6).collect()] == [("a", "b")]


def test_packing(spark):
    docs = [(i, "word " * (37 * i % 400)) for i in range(120)] + [(500, "word " * 3000), (501, None), (502, ""), (503, "a"), (503, "a")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, length string")
    rows = packing.pack(df, 512).collect()
    load, seen = {}, {}
    for r in rows:
        load[r["seq_id"]] = load.get(r["seq_id"], 0) + r["length"]
        seen.setdefault(r["seq_id"], []).append((r["pos_tokens"], r["length"]))
    assert max(load.values()) <= 512 and sum(load.values()) / (512 * len(load)) > 0.9
    for s in seen.values():
        s.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    counts = {}
    for r in packing.token_counts(df).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["n_tokens"]
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {k: v for k, v in counts.items() if v}
    assert all(r["length"] == 512 or r["piece"] == max(x["piece"] for x in rows if x["doc_id"] == r["doc_id"]) for r in rows)
    assert packing.pack(df.limit(0), 512).count() == 0


def first_fit(lengths, demand, capacity):
    free = []
    for n in np.repeat(lengths, demand)[::-1]:
        at = next((i for i, f in enumerate(free) if f >= n), None)
        if at is None:
            free.append(capacity - n)
        else:
            free[at] -= n
    return len(free)


def test_plan_is_exact():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 300, 60))
    demand = rng.integers(1, 40, len(lengths))
    plan, report = packing.solve(lengths, demand, 300)
    assert (sum(c * k for c, k in plan) == demand).all() and all(c @ lengths <= 300 for c, _ in plan)
    # The dual bound is a proof that no packing has fewer sequences; first fit by falling length is the rival.
    assert report["kept"] > 0.9 and report["bound"] <= report["sequences"] <= first_fit(lengths, demand, 300)
    many = np.unique(rng.geometric(0.02, 400).clip(1, 300))
    _, report = packing.solve(many, rng.integers(5, 60, len(many)), 300)
    assert report["kept"] > 0.9 and report["sequences"] <= 1.01 * report["bound"] + 1
    assert packing.solve(np.array([7]), np.array([3]), 10)[0][0][1] == 3


def test_slots_are_few_and_cover():
    rng = np.random.default_rng(3)
    lengths, demand = np.arange(1, 2049), rng.integers(1, 90, 2048)
    slot = packing.slots(lengths, demand, 64)
    assert slot.max() < 64 and (np.diff(slot) <= 0).all() and (packing.slots(lengths[:5], demand[:5], 64) == [4, 3, 2, 1, 0]).all()
    slack = sum(((lengths[slot == k].max() - lengths[slot == k]) * demand[slot == k]).sum() for k in range(64))
    assert slack < 0.03 * (lengths * demand).sum()


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(3, 30)))) for i in range(25)] + [(99, None), (98, "")]
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60)))) for i in range(60)] + [(200, None), (201, ""), (202, "<b>" + items[3][1].upper().replace(" ", "&nbsp;[/b] ") + "</b>")]
    w = 5
    grams = lambda t: {tuple(x[i : i + w]) for x in [leakage.words(t)] for i in range(len(x) - w + 1)}
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    df, it = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1, 40, 10_000):
        assert {tuple(r) for r in leakage.leaked(df, it, w, block).collect()} == want
    assert leakage.leaked(df, it.limit(0), w).count() == 0 and leakage.leaked(df.limit(0), it, w).count() == 0


TEXT = {
    "en": "the old router has quietly broken the wooden frame with a blunt knife", "de": "der alte Router verdeckt völlig den Holzrahmen mit einem stumpfen Messer", "nl": "de oude router vernielt langzaam het houten frame met een bot mes",
    "fr": "le vieux routeur a complètement abîmé le cadre en bois avec un couteau émoussé", "es": "el viejo enrutador estropeó del todo el marco de madera con un cuchillo sin filo", "pt": "o velho roteador nunca quis o quadro de madeira com uma faca cega",
}


def test_languages(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        lang = list(TEXT)[i % 6]
        words = TEXT[lang].split()
        rows.append((i, ". ".join(" ".join(rnd.sample(words, 9)) for _ in range(3)) + ".", lang.upper()))
    rows += [(900, TEXT["de"] + ".\n> " + TEXT["fr"] + ".", "de_DE"), (901, TEXT["nl"], None), (902, TEXT["es"], "Spanish"), (903, "[deleted]", "en"), (904, None, None), (905, "", ""), (906, TEXT["pt"] * 3000, "??")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, label string")
    got = {tuple(r) for r in langid.mislabelled(df).collect()}
    assert got == {(900, "de"), (900, "fr"), (901, "nl"), (906, "pt")}
    assert langid.mislabelled(df.limit(0)).count() == 0


def test_label_notations(spark):
    v = ["en-GB", "EN", "eng", "English", "pt_BR", "Dutch", "", None, "??", "und"]
    df = spark.createDataFrame([(x,) for x in v], "v string")
    assert [r[0] for r in df.select(langid.label_language(F.col("v"))).collect()] == ["en", "en", "en", "en", "pt", "nl", None, None, None, None]


def test_transducer_equals_normalisation():
    """Random texts without look-alikes: the compiled transitions give what normalising them gives."""
    rnd = random.Random(5)
    pool = [chr(i) for i in (*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x1E00, 0x1F00), *range(0x30AB, 0x30C0), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0xFF66, 0xFFA0))]
    t = unify.Transducer({})
    for _ in range(3000):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 8)))
        assert t.apply(s) == unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) for c in s))


def test_conflicts_are_rows(spark):
    conf = spark.createDataFrame([(1, "U+0430", "a"), (2, "а", "o"), (3, "ｂ", "d"), (4, None, None)], "row_no int, c0 string, c1 string")
    assert {tuple(r) for r in unify.conflict_rows(conf).collect()} == {(2, "а", "o", "a"), (3, "ｂ", "d", "b")}
    assert unify.conflict_rows(conf.limit(0)).count() == 0


def test_names_of_other_latin_alphabets():
    got = [t[o[0] : o[1]] for t in ["Dear Mr Łukasz Żeleński, hello", "Signed: Šárka Dvořáková"] for o in pii.candidates(t) if o[2] == "name"]
    assert "Łukasz Żeleński" in got and "Šárka Dvořáková" in got


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, sf, name):
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, sf)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    r = connect(sf).execute(queries.SQL[name])
    want, wcols = rows([x[0] for x in r.description], r.fetchall())
    assert cols == wcols and got == want

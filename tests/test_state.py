"""Online campaigns with state, audit logs of streams, signatures."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from postern.functions import ed25519, scoring
from postern.operators import audit
from postern.streaming import stateful

EVENT = "msg string, seq bigint, ip string, domain string"


def in_order(events):
    """Plain assignment in order of arrival."""
    of, out = {}, {}
    for msg, seq, ip, domain in sorted(events, key=lambda e: (e[1], e[0])):
        c = of.get(("i", ip)) if ip is not None else None
        c = c or (of.get(("d", domain)) if domain is not None else None) or f"CMP-{msg}"
        for k in (("i", ip), ("d", domain)):
            if k[1] is not None:
                of[k] = c
        out[msg] = c
    return out


def events(n, seed=1):
    rnd = random.Random(seed)
    pick = lambda k: rnd.choice([None, "hot", *[f"k{i}" for i in range(k)]])
    return [(f"{i:03d}", rnd.randrange(n), pick(40), pick(60)) for i in range(n)]


def test_online_campaigns_equal_a_fold(spark):
    e = events(300)
    got = dict((r["msg"], r["campaign"]) for r in stateful.campaigns_online(spark.createDataFrame(e, EVENT)).collect())
    assert got == in_order(e)
    assert stateful.campaigns_online(spark.createDataFrame([], EVENT)).count() == 0
    few = [("1", 1, "1", "x"), ("2", 2, None, "x"), ("3", 3, "2", "y"), ("4", 4, "1", "y"), ("5", 5, None, None)]
    assert [r["campaign"] for r in stateful.campaigns_online(spark.createDataFrame(few, EVENT)).orderBy("msg").collect()] == ["CMP-1", "CMP-1", "CMP-3", "CMP-1", "CMP-5"]


def test_campaign_state_spans_batches(spark, tmp_path):
    e = sorted(events(120, 2), key=lambda x: (x[1], x[0]))
    e = [(m, i, ip, d) for i, (m, _, ip, d) in enumerate(e)]
    state, got = stateful.CampaignState(spark, f"file://{tmp_path}/state"), {}
    for n, at in enumerate(range(0, 120, 40)):
        batch = spark.createDataFrame(e[at : at + 40], EVENT)
        got |= {r["msg"]: r["campaign"] for r in state.assign(batch, n).collect()}
        got |= {r["msg"]: r["campaign"] for r in state.assign(batch, n).collect()}  # delivered again
    assert got == in_order(e)


def test_ed25519_vectors(spark):
    # The first two test vectors published with the algorithm.
    for seed, key, msg, sig in [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]:
        seed, key, msg, sig = map(bytes.fromhex, (seed, key, msg, sig))
        assert ed25519.public_key(seed) == key and ed25519.sign(seed, msg) == sig and ed25519.verify(key, msg, sig)
        assert not ed25519.verify(key, msg + b"x", sig) and not ed25519.verify(key, msg, bytes(64)) and not ed25519.verify(key, msg, b"") and not ed25519.verify(bytes(31) + b"\xff", msg, sig)
    seed = bytes(range(32))
    df = spark.createDataFrame([("a",), ("é" * 1000,), (None,)], "m string").withColumn("s", ed25519.signature_column(seed, F.col("m")))
    ok = df.select(ed25519.verified_column(ed25519.public_key(seed), F.col("m"), F.col("s")), ed25519.verified_column(ed25519.public_key(seed), F.lit("b"), F.col("s"))).collect()
    assert [tuple(r) for r in ok] == [(True, False), (True, False), (False, False)]


def test_ed25519_blocks_are_the_single_ones(spark):
    rnd = random.Random(3)
    seed = bytes(range(32))
    key = ed25519.public_key(seed)
    base = ed25519._powers()[0][:2]
    numbers = [0, 1, 2, ed25519.ORDER - 1, ed25519.ORDER, 2**253 - 1, *(rnd.randrange(2**253) for _ in range(20))]
    assert ed25519._packed((numbers, base)) == [ed25519._pack(ed25519._times(k)) for k in numbers]
    msgs = [rnd.randbytes(i % 90) for i in range(ed25519.BLOCK + 5)]
    sigs = ed25519.sign_all(seed, msgs)
    assert sigs[:9] == [ed25519.sign(seed, m) for m in msgs[:9]] and ed25519.sign_all(seed, []) == []
    assert all(ed25519.verify_all(key, msgs, sigs)) and ed25519.verify_all(key, [], []) == []
    # Broken in every part: also a number too large, points that are none or not in their one form, and other keys.
    m, s = msgs[5], sigs[5]
    bad = [s[:i] + bytes([s[i] ^ 1]) + s[i + 1 :] for i in (0, 31, 32, 63)] + [s[:32] + (int.from_bytes(s[32:], "little") + ed25519.ORDER).to_bytes(32, "little")]
    bad += [b"", s[:63], s + b"x", bytes(64), b"\xff" * 32 + s[32:], ed25519.FIELD.to_bytes(32, "little") + s[32:], (1).to_bytes(32, "little") + bytes(32), (1 | 1 << 255).to_bytes(32, "little") + bytes(32)]
    for k in (key, ed25519.public_key(bytes(32)), b"", b"\xff" * 32, bytes(32), (1).to_bytes(32, "little"), (ed25519.FIELD - 1).to_bytes(32, "little")):
        assert ed25519.verify_all(k, [m] * (len(bad) + 1), [*bad, s]) == [ed25519.verify(k, m, x) for x in [*bad, s]]


def test_signing_is_spread_and_in_blocks(spark):
    # One file of a few bytes a row: it was one task, and about 12 ms a signature.
    n = 20_000
    lines = spark.range(n).coalesce(1).select((F.col("id") * 2 + 1).alias("pos"), F.concat(F.lit('{"hash":"'), F.sha2(F.col("id").cast("string"), 256), F.lit('"}')).alias("line"))
    signed = audit.sign_heads(lines, bytes(32), 2)
    parts = signed.select(F.spark_partition_id().alias("p")).distinct().count()
    at = time.time()
    assert signed.filter("length(signature) = 88").count() == n and time.time() - at < 40
    assert parts > 1


def test_chains_over_many_spans(spark):
    events = [{"event": "e", "ts": str(i), "detail": "caf\u00e9" if i % 7 == 0 else 'a "quoted" one' if i % 11 == 0 else "x"} for i in range(300)]
    chain = list(enumerate(audit.chain_records(events)))
    cases = [(chain, (True, 300, None, None))]
    for at in (0, 63, 64, 65, 128, 299):
        line = chain[at][1]
        forms = {
            line.replace('"e"', '"f"', 1): "hash mismatch", "": "not valid JSON", line.replace('"event":"e",', ""): "missing field", line.replace(f'"index":{at},', f'"index":0{at},'): "not valid JSON", line.replace(f'"index":{at},', f'"index":{at + 1},'): "index gap",
            line.replace('"prev_hash":"', '"prev_hash":"0'): "prev_hash mismatch", line.replace('"subject":""', '"subject":"","subject":""'): "not valid JSON", line.replace('{"event"', '{ "event"'): "hash mismatch",
        }
        cases += [([*chain[:at], (at, other), *chain[at + 1 :]], (False, 300, at, why)) for other, why in forms.items()]
        if at < 299:
            cases.append(([*chain[:at], *chain[at + 1 :]], (False, 299, at + 1, "prev_hash mismatch")))
    rows = spark.createDataFrame([(k, *r) for k, (c, _) in enumerate(cases) for r in c], "k int, " + LINES)
    got = {r["k"]: (r["ok"], r["records"], r["divergence"], r["reason"]) for r in audit.verify_chain(rows.repartition(5), ["k"]).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    last = audit.verify_chain(spark.createDataFrame(chain, LINES).repartition(3)).first()
    assert (last["ok"], last["records"], last["head"]) == (True, 300, json.loads(chain[-1][1])["hash"])
    # Signatures count at their index only, also beyond one span; one past the end of a cut log doesn't.
    seed, all_ = bytes(32), spark.createDataFrame(chain, LINES)
    s, level = audit.sign_heads(all_, seed, 50), lambda rows: audit.status(rows, s, ed25519.public_key(seed), 50).select("last_signed", "head_signed", "forged", "assurance").first()
    assert tuple(level(all_)) == (299, True, False, "SIGNED") and tuple(level(all_.filter("pos < 280"))) == (249, False, False, "SIGNED")
    assert tuple(level(all_.withColumn("line", F.when(F.col("pos") == 299, F.replace("line", F.lit('"hash":"'), F.lit('"hash":"0'))).otherwise(F.col("line"))))) == (249, False, True, "TAMPERED")


LINES = "pos bigint, line string"


def test_status_has_all_outcomes(spark):
    seed = bytes(32)
    key = ed25519.public_key(seed)
    lines = lambda n: spark.createDataFrame(list(enumerate(audit.chain_records([{"event": "e", "ts": str(i)} for i in range(n)]))), LINES)
    level = lambda df, s=None, k=key: audit.status(df, s, k, 2).first()["assurance"]
    none = audit.sign_heads(lines(0), seed, 2)
    assert level(lines(0), none) == "EMPTY" and level(lines(1), none) == "UNSIGNED" and level(lines(3), none, None) == "UNSIGNED"
    signed = audit.sign_heads(lines(3), seed, 2)
    assert signed.count() == 1 and level(lines(3), signed) == "SIGNED" and level(lines(2), signed) == "SIGNED"
    assert level(lines(3), none) == "TAMPERED"  # a checkpoint was due
    assert level(lines(2), audit.sign_heads(lines(2), bytes([1] * 32), 2)) == "TAMPERED"  # another key
    assert level(lines(3).withColumn("line", F.replace("line", F.lit('"e"'), F.lit('"f"'))), signed) == "TAMPERED"


def test_stream_batches_are_appended_once(spark, tmp_path):
    log = audit.LogWriter(spark, f"file://{tmp_path}/log", most=10)
    for n in range(3):
        rows = spark.createDataFrame([(f"e{i}", f"t{n}{i}", "me" if i else None, i) for i in range(4)], "event string, ts string, actor string, seq int")
        log.append(rows, n)
        log.append(rows, n)
    v = audit.verify_chain(log.lines().select("pos", "line")).first()
    assert v["ok"] and v["records"] == 12
    assert audit.numbered(log.lines().select("pos", "line"), ["pos"]).filter("line is null").count() == 0
    with pytest.raises(ValueError, match="more than"):
        log.append(spark.range(11).selectExpr("'e' AS event", "'t' AS ts"), 9)
    spark.createDataFrame([(12, "broken")], LINES).write.parquet(f"file://{tmp_path}/log/batch=7")
    with pytest.raises(ValueError, match="broken at 12"):
        log.append(spark.range(1).selectExpr("'e' AS event", "'t' AS ts"), 8)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id AS k", "concat('l', id) AS line").repartition(7)
    assert {(r["pos"], r["line"]) for r in audit.numbered(df, ["k"]).collect()} == {(i, f"l{i}") for i in range(1000)}


def stream_of(spark, df, folder):
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def drained(spark, stream, name, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/cp").start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_lookups_are_answered_once_in_their_lifetime(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 05:00:00"), ("b", "2024-01-01 06:00:00"), ("a", "2024-01-01 07:00:00")], "key string, ts string").selectExpr("key", "cast(ts as timestamp) ts").coalesce(1)
    got = drained(spark, stateful.cached_lookups(stream_of(spark, df, tmp_path)), "lookups", tmp_path)
    assert sorted(r["key"] for r in got) == ["a", "b"]


def test_scores_of_a_stream_are_the_batch(spark, tmp_path):
    x = [[(i * k % 11) / 10 if i % 3 else None for i in range(60)] for k in range(5)]
    df = spark.createDataFrame([(k, v, "2024-01-01 00:00:00") for k, v in enumerate(x)], "id int, x array<double>, at string").selectExpr("id", "x", "cast(at as timestamp) arrived")
    got = drained(spark, stateful.score_stream(stream_of(spark, df, tmp_path), scoring.score).select("id", "risk_final", "band"), "scores", tmp_path)
    assert {tuple(r) for r in got} == {tuple(r) for r in scoring.score(df).select("id", "risk_final", "band").collect()} and len(got) == 5


def test_lockout_is_cut_at_pauses_only(spark):
    rnd = random.Random(9)
    rows, ts = [], 0
    for i in range(400):
        ts += rnd.choice([1, 30_000, 200_000, 899_999, 900_000, 5_000_000])
        rows.append(("hot" if rnd.random() < 0.8 else f"a{i % 3}", ts, rnd.random() < 0.1, i))
    want, state = {}, {}
    for a, t, ok, seq in rows:
        failures, until = state.get(a, ([], 0))
        failures, until, now = stateful.lock_step(failures, until, t, ok)
        state[a], want[seq] = (failures, until), (len(failures), now)
    got = stateful.lockout_batch(spark.createDataFrame(rows, "account string, ts_ms bigint, ok boolean, seq bigint")).collect()
    locked = {r["seq"]: r["locked"] for r in got}
    assert locked == {k: v[1] for k, v in want.items()} and any(locked.values())
    assert {r["seq"]: r["failures"] for r in got} == {k: v[0] for k, v in want.items()}

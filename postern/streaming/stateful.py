"""Stateful streams: account lockout, sessions, campaign assignment, lookups with a lifetime."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postern.operators.graph import components

MAX_FAILURES, WINDOW_MS, LOCK_MS = 5, 15 * 60_000, 15 * 60_000
LOCK_OUT = "account string, ts_ms bigint, ok boolean, failures int, locked boolean, seq bigint"
LOCK_STATE = "failures array<bigint>, locked_until bigint"


def lock_step(failures: list[int], until: int, ts: int, ok: bool) -> tuple[list[int], int, bool]:
    """Next (recent failures, locked until, locked now) of one attempt.

    While locked nothing counts; an expired lock clears the counter; a success clears it; the fifth
    failure within the window locks.
    """
    if until and ts >= until:
        failures, until = [], 0
    if until:
        return failures, until, True
    if ok:
        return [], 0, False
    failures = [f for f in failures if f > ts - WINDOW_MS] + [ts]
    return (failures, ts + LOCK_MS, True) if len(failures) >= MAX_FAILURES else (failures, 0, False)


def _fold(pdf: pd.DataFrame, failures: list[int], until: int) -> tuple[pd.DataFrame, list[int], int]:
    n, locked = [], []
    pdf = pdf.sort_values(["ts_ms", "seq"])
    for ts, ok in zip(pdf["ts_ms"], pdf["ok"], strict=True):
        failures, until, now = lock_step(failures, until, int(ts), bool(ok))
        n.append(len(failures))
        locked.append(now)
    return pdf.assign(failures=pd.Series(n, index=pdf.index, dtype="int32"), locked=locked)[["account", "ts_ms", "ok", "failures", "locked", "seq"]], failures, until


def lockout_batch(attempts: DataFrame) -> DataFrame:
    """Every attempt (account, ts_ms, ok, seq) with the failures counted and whether the account is locked after it.

    The machine is serial per account, but a pause as long as the window and the lock leaves nothing
    behind: the next attempt meets an empty machine. So an account's attempts are cut at such pauses
    into stretches, which many tasks share. Pauses lie between blocks of that length, so they are found
    in one row per account and block, of which an account has a bounded number however many attempts
    it has. A stretch is ordered by the shuffle and streamed in Arrow batches with the state carried
    along, so an account that never pauses is one stream, but never held in memory at once.
    """
    pause = max(WINDOW_MS, LOCK_MS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, failures, until = None, [], 0
        for b in batches:
            n, locked = [], []
            for a, stretch, ts, ok in zip(b["account"], b["stretch"], b["ts_ms"], b["ok"], strict=True):
                if (a, stretch) != account:
                    account, failures, until = (a, stretch), [], 0
                failures, until, now = lock_step(failures, until, int(ts), bool(ok))
                n.append(len(failures))
                locked.append(now)
            yield b.assign(failures=pd.Series(n, index=b.index, dtype="int32"), locked=locked)[["account", "ts_ms", "ok", "failures", "locked", "seq"]]

    rows = attempts.filter("account is not null and ts_ms is not null and ok is not null").select("account", "ts_ms", "ok", "seq", F.floor(F.col("ts_ms") / pause).alias("block"))
    w = Window.partitionBy("account").orderBy("block")
    blocks = rows.groupBy("account", "block").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    fresh = F.coalesce(F.col("first") - F.lag("last").over(w) >= pause, F.lit(True))
    stretches = blocks.withColumn("fresh", fresh.cast("long")).select("account", "block", F.sum("fresh").over(w).alias("stretch"))
    j = rows.join(stretches, ["account", "block"]).drop("block")
    return j.repartition("account", "stretch").sortWithinPartitions("account", "stretch", "ts_ms", "seq").mapInPandas(run, LOCK_OUT)


def lockout_stream(attempts: DataFrame) -> DataFrame:
    """The same machine over a stream: state per account, dropped an hour after its last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = state.get if state.exists else ([], 0)
        frame = pd.concat(list(batches))
        out, failures, until = _fold(frame, list(failures), until)
        state.update((failures, until))
        state.setTimeoutDuration(60 * 60_000)
        yield out

    return attempts.groupBy("account").applyInPandasWithState(step, LOCK_OUT, LOCK_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(logins: DataFrame, requests: DataFrame, hours: int = 8) -> DataFrame:
    """Requests with whether a login of the same account within the last `hours` covers them.

    Time is cut into blocks of that length, so the last login before a request lies in its own block
    or is the latest of the block before; groups are an account's rows of one block.
    """
    span = hours * 3_600_000
    block = F.floor(F.col("ts_ms") / span)
    cols = requests.columns
    rest = [c for c in cols if c not in ("account", "ts_ms")]
    none = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in rest]
    rows = logins.select("account", "ts_ms", *none, F.lit(0).alias("_kind"), F.col("ts_ms").alias("_login")).unionByName(
        requests.select("account", "ts_ms", *rest, F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_login"))
    )
    rows = rows.withColumn("_b", block)
    before = logins.groupBy("account", (block + 1).alias("_b")).agg(F.max("ts_ms").alias("_prev"))
    w = Window.partitionBy("account", "_b").orderBy("ts_ms", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("_last", F.max("_login").over(w)).filter("_kind = 1").join(before, ["account", "_b"], "left")
    last = F.coalesce("_last", "_prev")
    return x.select(*cols, F.coalesce(F.col("ts_ms") < last + span, F.lit(False)).alias("active"))


def campaigns_batch(events: DataFrame) -> DataFrame:
    """(msg, campaign): messages that share an address or a sender domain, directly or through others.

    This is the order-free form of online assignment: components of the graph of messages, addresses
    and domains, named by their least message.
    """
    ip = events.filter("ip is not null").select(F.concat(F.lit("m"), F.lpad(F.col("msg").cast("string"), 20, "0")).alias("a"), F.concat(F.lit("z:i:"), "ip").alias("b"))
    dom = events.filter("domain is not null").select(F.concat(F.lit("m"), F.lpad(F.col("msg").cast("string"), 20, "0")).alias("a"), F.concat(F.lit("z:d:"), "domain").alias("b"))
    c = components(ip.unionByName(dom))
    return c.filter(F.col("id").startswith("m")).select(F.substring("id", 2, 20).cast("bigint").alias("msg"), F.substring("root", 2, 20).cast("bigint").alias("campaign"))


def _online(events: DataFrame) -> DataFrame:
    """(msg, seq, campaign) of (group, seq, msg, ip, domain, known): events of a group in order of seq, with the keys' campaigns carried along.

    `known` is set on rows that only tell a key's campaign. Groups share no key. They are brought
    together and ordered by the shuffle and streamed in Arrow batches, so no group is held in memory;
    what is held are the campaigns of a group's keys.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, of_ip, of_domain = None, {}, {}
        for b in batches:
            rows = []
            for g, seq, msg, ip, domain, known in zip(b["grp"], b["seq"], b["msg"], b["ip"], b["domain"], b["known"], strict=True):
                if g != group:
                    group, of_ip, of_domain = g, {}, {}
                if known is not None:
                    cid = known
                else:
                    cid = (of_ip.get(ip) if ip is not None else None) or (of_domain.get(domain) if domain is not None else None) or f"CMP-{msg}"
                    rows.append((msg, seq, cid))
                if ip is not None:
                    of_ip[ip] = cid
                if domain is not None:
                    of_domain[domain] = cid
            yield pd.DataFrame(rows, columns=["msg", "seq", "campaign"])

    rows = events.select("grp", "seq", "msg", "ip", "domain", "known")
    return rows.repartition("grp").sortWithinPartitions("grp", "seq", "msg").mapInPandas(run, "msg string, seq bigint, campaign string")


def _grouped(events: DataFrame) -> DataFrame:
    """Adds grp: rows that share an address or a domain, directly or through others, have the same."""
    node = F.concat(F.lit("m:"), "msg")
    keys = [events.filter(F.col(k).isNotNull()).select(node.alias("a"), F.concat(F.lit(f"{k}:"), F.col(k)).alias("b")) for k in ("ip", "domain")]
    c = components(keys[0].unionByName(keys[1]).unionByName(events.select(node.alias("a"), node.alias("b"))))
    return events.join(c.filter(F.col("id").startswith("m:")).select(F.substring("id", 3, 1_000_000).alias("msg"), F.col("root").alias("grp")), "msg")


def campaigns_online(events: DataFrame) -> DataFrame:
    """(msg, seq, campaign): exact arrival-order assignment of (msg string, seq bigint, ip, domain).

    In order of seq an event joins the campaign of its address, else of its domain, else a new one,
    and both keys follow it. Only events connected by keys can meet, so each component of the graph
    of events and keys is assigned on its own. Campaigns are named by their first event; equal seq
    are ordered by msg; events without keys are campaigns of their own; msg is unique.
    """
    return _online(_grouped(events.select("msg", "seq", "ip", "domain")).withColumn("known", F.lit(None).cast("string")))


class CampaignState:
    """Online assignment over micro-batches: the campaigns of all keys lie in a folder, one run per batch.

    A batch reads only the state of its own keys. A batch that is delivered again writes the same
    runs again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.batches: set[int] = set()

    def _state(self, before: int) -> DataFrame | None:
        done = sorted(b for b in self.batches if b < before)
        if not done:
            return None
        runs = self.spark.read.option("basePath", f"{self.path}/keys").parquet(*[f"{self.path}/keys/batch={b}" for b in done])
        return runs.groupBy("kind", "key").agg(F.max_by("campaign", F.struct("batch", "seq")).alias("known"))

    def assign(self, events: DataFrame, batch: int) -> DataFrame:
        """Assign a batch of (msg, seq, ip, domain), store what its keys became, and return (msg, seq, campaign)."""
        e = events.select("msg", "seq", "ip", "domain").withColumn("known", F.lit(None).cast("string"))
        state = self._state(batch)
        if state is not None:
            for k in ("ip", "domain"):
                other = "domain" if k == "ip" else "ip"
                mine = state.filter(F.col("kind") == k).join(events.select(F.col(k).alias("key")).filter("key is not null").distinct(), "key", "left_semi")
                e = e.unionByName(mine.select(F.concat(F.lit(f"#{k}:"), "key").alias("msg"), F.lit(-(1 << 62)).cast("bigint").alias("seq"), F.col("key").alias(k), F.lit(None).cast("string").alias(other), "known"))
        out = _online(_grouped(e))
        out.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch}")
        got = self.spark.read.schema("msg string, seq bigint, campaign string").parquet(f"{self.path}/events/batch={batch}")
        keyed = got.join(events.select("msg", "ip", "domain"), "msg")
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("ip", "domain")])
        keys = keyed.select("seq", "msg", "campaign", F.explode(pairs).alias("x")).filter("x.key is not null")
        keys.groupBy("x.kind", "x.key").agg(F.max(F.struct("seq", "msg", "campaign")).alias("m")).select("kind", "key", "m.seq", "m.campaign").write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        self.batches.add(batch)
        return got


def cached_lookups(requests: DataFrame, lifetime: str = "24 hours") -> DataFrame:
    """First request per key within its lifetime; later ones are answered from it (streams with event time `ts`)."""
    return requests.withWatermark("ts", lifetime).dropDuplicatesWithinWatermark(["key"])


def score_stream(parsed: DataFrame, score) -> DataFrame:
    """Continuous scoring: the batch plan over a stream of parsed messages, late ones bounded by a watermark."""
    return score(parsed.withWatermark("arrived", "1 day"))

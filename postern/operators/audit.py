"""Hash-chained audit log: read, verify, append, signatures, assurance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postern.functions import ed25519
from postern.functions.lexicons import GENESIS
from postern.session import materialize


def canonical(line) -> Column:
    """The record without its own hash; lines on disk already have sorted keys."""
    c = F.col(line) if isinstance(line, str) else line
    return F.regexp_replace(c, r'"hash":"[0-9a-f]{64}",?', "")


# Reasons in order of precedence; a record's code is the place of its reason.
REASONS = ["not valid JSON", "missing field", "index gap", "prev_hash mismatch", "hash mismatch"]
# A record as `chain_records` writes it, in plain ASCII without escapes: nothing in it but its fields can look like one.
_TEXT = r'"[ !#-\[\]-~]*+"'
_PLAIN = rf'^\{{"event":{_TEXT},"hash":"[0-9a-f]{{64}}","index":(?:0|[1-9][0-9]{{0,17}}),"payload":\{{(?:"action":{_TEXT},"actor":{_TEXT},"detail":{_TEXT},"outcome":{_TEXT},"subject":{_TEXT},"ts":{_TEXT}|"subject":{_TEXT})\}},"prev_hash":"[0-9a-f]{{64}}","ts":{_TEXT}\}}\z'
# Positions of a chain that are checked together.
SPAN = 64


def _read(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., pos, hash, prev_hash, code): what each record says, and what is wrong with it by itself.

    Plain records are cut at known places; all others are parsed.
    """
    line = F.col("line")
    at = lambda text: F.locate(text, line)
    r = lines.select(*keys, "pos", "line", F.coalesce(line.rlike(_PLAIN), F.lit(False)).alias("plain"), at('"hash":"').alias("h"), at('"prev_hash":"').alias("p"), at(',"payload":').alias("q"))
    either = lambda plain, k: F.when(F.col("plain"), plain).otherwise(F.get_json_object("line", f"$.{k}"))
    h, start = F.col("h"), F.col("h") + 82
    r = r.select(
        *keys, "pos", "plain", "line", either(F.substring(line, h + 8, F.lit(64)), "hash").alias("hash"), either(F.substring(line, F.col("p") + 13, F.lit(64)), "prev_hash").alias("prev_hash"),
        either(F.substring(line, start, F.col("q") - start), "index").alias("idx"), F.when(F.col("plain"), F.concat(F.substring(line, F.lit(1), h - 1), F.substring(line, h + 74, F.length(line)))).otherwise(canonical(line)).alias("body"),
    )
    missing = lambda k: F.get_json_object("line", f"$.{k}").isNull()
    code = (
        F.when(~F.col("plain") & F.try_parse_json("line").isNull(), 1)
        .when(~F.col("plain") & (F.col("hash").isNull() | F.col("prev_hash").isNull() | F.col("idx").isNull() | missing("event") | missing("payload") | missing("ts")), 2)
        .when(~F.col("idx").rlike(r"^\d+$") | (F.col("idx").try_cast("bigint") != F.col("pos")), 3)
        .when(F.sha2(F.concat("prev_hash", "body"), 256) != F.col("hash"), 5)
    )
    return r.select(*keys, "pos", "hash", "prev_hash", code.alias("code"))


def _linked(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., span, pos, hash, code): every record, checked by itself and against the one before it.

    The last record of a span is also put before the first of the next, so that spans are checked in parallel.
    """
    span = F.col("pos") - F.col("pos") % SPAN
    r = _read(lines, keys).withColumn("span", F.explode(F.when(F.col("pos") % SPAN == SPAN - 1, F.array(span, span + SPAN)).otherwise(F.array(span))))
    w = Window.partitionBy(*keys, "span").orderBy("pos")
    r = r.withColumn("before", F.lag("pos").over(w)).withColumn("expected", F.lag("hash").over(w)).filter(F.col("span") == span)
    expected = F.when(F.col("pos") == 0, F.lit(GENESIS)).when(F.col("before") == F.col("pos") - 1, F.col("expected"))
    code = F.when(F.col("code") <= 3, F.col("code")).when(~F.col("prev_hash").eqNullSafe(expected), 4).otherwise(F.col("code"))
    return r.select(*keys, "span", "pos", "hash", code.alias("code"))


def _spans(x: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys..., span, records, last, bad, and more) of checked records: a row for each span."""
    bad = F.min(F.when(F.col("code").isNotNull(), F.col("pos") * (len(REASONS) + 1) + F.col("code")))
    return x.groupBy(*keys, "span").agg(F.count(F.lit(1)).alias("records"), F.max(F.struct("pos", "hash")).alias("last"), bad.alias("bad"), *more)


def _verdict(spans: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row, or one per chain."""
    n = len(REASONS) + 1
    agg = spans.groupBy(*keys).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.max("last")["hash"].alias("last"), F.min("bad").alias("bad"), *more)
    reason = F.get(F.array(*map(F.lit, REASONS)), (F.col("bad") % n - 1).cast("int"))
    return agg.select(*keys, F.col("bad").isNull().alias("ok"), "records", F.coalesce("last", F.lit(GENESIS)).alias("head"), F.expr(f"bad div {n}").alias("divergence"), reason.alias("reason"), *agg.columns[len(keys) + 3 :])


def verify_chain(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ok, records, head, first divergent position and its reason; one row, or one per chain of `keys`.

    `lines`: (keys..., pos, line) with pos from 0 in each chain. Every record stores the hash before
    it, so spans of SPAN positions are checked in parallel; no ordered pass over the log is needed.
    Without keys an empty log is ok and its head is the genesis hash.
    """
    keys = keys or []
    return _verdict(_spans(_linked(lines, keys), keys), keys)


def numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """(pos, line) in the given order, by counts per range partition: no global window.

    The sorted lines are written first, so that counts and numbers are of the same partitions.
    """
    cols = [*dict.fromkeys([*order, "line"])]
    sorted_ = lines.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_, "numbered")
    base = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("k0"))
    base = base.select("_p", "k0", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("off"))  # one row per partition
    return sorted_.join(F.broadcast(base), "_p").select((F.col("off") + F.col("_k") - F.col("k0")).alias("pos"), "line")


def chain_records(events: list[dict], prev: str = GENESIS, start: int = 0) -> list[str]:
    """Canonical lines of new records: the chain is serial by nature, so this is a fold over one batch."""
    out = []
    for i, e in enumerate(events, start):
        payload = {"action": e["event"], "actor": e.get("actor") or "system", "detail": e.get("detail") or "", "outcome": e.get("outcome") or "ok", "subject": e.get("subject") or "", "ts": e["ts"]}
        rec = {"event": e["event"], "index": i, "payload": payload, "prev_hash": prev, "ts": e["ts"]}
        body = json.dumps(rec, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        prev = hashlib.sha256((prev + body).encode()).hexdigest()
        out.append(json.dumps(rec | {"hash": prev}, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    return out


def append(spark: SparkSession, log: DataFrame, events: list[dict]) -> list[str]:
    """Lines to append to a verified log of (pos, line); a broken chain is refused."""
    v = verify_chain(log).first()
    if not v["ok"]:
        raise ValueError(f"the chain is broken at {v['divergence']}: {v['reason']}")
    return chain_records(events, v["head"], v["records"])


def signature_payload(head_hash: Column) -> Column:
    """What is signed: the hex hash of the head's hash."""
    return F.sha2(head_hash, 256)


def sign_heads(lines: DataFrame, seed: bytes, every: int = 50, keys: list[str] | None = None) -> DataFrame:
    """(keys..., index, head_hash, signature, key_id): a signature for every `every`-th record of each chain."""
    due = lines.filter((F.col("pos") + 1) % every == 0).select(*(keys or []), F.col("pos").alias("index"), F.get_json_object("line", "$.hash").alias("head_hash")).filter("head_hash is not null")
    due = due.repartition(2 * due.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    return due.select("*", ed25519.signature_column(seed, signature_payload(F.col("head_hash"))).alias("signature"), F.lit(ed25519.key_id(ed25519.public_key(seed))).alias("key_id"))


def status(lines: DataFrame, signatures: DataFrame | None, key: bytes | None, every: int = 50, keys: list[str] | None = None) -> DataFrame:
    """Verification, signatures and assurance; one row, or one per chain of `keys`.

    A signature counts if it is the key's over the hash that the chain holds at its index. A head
    whose signature doesn't count is forged. Without a key nothing is signed. An empty log is EMPTY.
    """
    keys = keys or []
    if key is None or signatures is None:
        none = verify_chain(lines, keys).select("*", F.lit(None).cast("bigint").alias("last_signed"), F.lit(False).alias("head_signed"), F.lit(False).alias("forged"))
        return none.withColumn("assurance", assurance(F.col("records"), F.col("ok"), F.lit(False), F.lit(False)))
    span = [*keys, "span"]
    s = signatures.select(*keys, F.col("index").cast("bigint").alias("index"), "head_hash", "signature")
    # Few bytes, much work: spread over all cores first, and no filter on the result, which would be moved before that.
    good = s.repartition(2 * s.sparkSession.sparkContext.defaultParallelism).withColumn("ok", ed25519.verified_column(key, signature_payload(F.col("head_hash")), F.col("signature")))
    good = good.groupBy(*keys, (F.col("index") - F.col("index") % SPAN).alias("span")).agg(F.collect_set(F.when(F.col("ok"), F.struct("index", "head_hash"))).alias("good"))
    # Only hashes at places where some signature may be leave a span; there are at most `every` such places.
    places = s.select((F.col("index") % every).alias("place")).distinct().withColumn("due", F.lit(True))
    x = _linked(lines, keys).withColumn("place", F.col("pos") % every).join(F.broadcast(places), "place", "left")
    held = F.collect_list(F.when(F.col("due") & F.col("hash").isNotNull(), F.struct(F.col("pos").alias("index"), F.col("hash").alias("head_hash"))))
    x = _spans(x, keys, held.alias("held")).join(good, span, "left")
    v = _verdict(x, keys, F.max(F.array_max(F.array_intersect("held", "good"))["index"]).alias("last_signed"))
    newest = s.groupBy(*keys).agg(F.max("index").alias("newest"))
    j = v.join(newest, keys, "left") if keys else v.crossJoin(newest)  # one row each without keys
    at_head = F.col("newest") == F.col("records") - 1
    j = j.withColumn("head_signed", F.coalesce(F.col("ok") & at_head & (F.col("last_signed") == F.col("newest")), F.lit(False)))
    j = j.withColumn("forged", F.coalesce(at_head, F.lit(False)) & ~F.col("head_signed")).drop("newest")
    # A key is set, a checkpoint was due and none verifies: a rewrite must not hide behind lost signatures.
    lost = F.col("last_signed").isNull() & (F.col("records") >= every)
    return j.withColumn("assurance", assurance(F.col("records"), F.col("ok"), F.col("last_signed").isNotNull(), F.col("forged") | lost))


def assurance(records: Column, ok: Column, signed: Column, forged: Column) -> Column:
    return F.when(records == 0, "EMPTY").when(~ok | forged, "TAMPERED").when(signed, "SIGNED").otherwise("UNSIGNED")


class LogWriter:
    """Audit records of a stream: each micro-batch is appended to the chain in a folder.

    The chain is serial, so a batch's events are folded in their order on the driver; `most` bounds a
    batch, a larger one is refused. A batch that is delivered again finds its file and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 100_000):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def lines(self) -> DataFrame:
        """(batch, pos, line) of all records so far."""
        schema = "pos bigint, line string, batch bigint"
        return self.spark.read.schema(schema).parquet(self.path) if self._batches() else self.spark.createDataFrame([], schema)

    def _batches(self) -> set[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return set()
        found = (s.getPath().getName() for s in fs.listStatus(fs_path) if s.isDirectory() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return {int(n.split("=")[1]) for n in found if n.startswith("batch=")}

    def append(self, events: DataFrame, batch: int) -> None:
        """Append (event, ts, and optionally actor, detail, outcome, subject, seq); for foreachBatch."""
        done = self._batches()
        if batch in done:
            return
        if done:
            log = self.lines().select("pos", "line")
            head = verify_chain(log).first()
            if not head["ok"]:
                raise ValueError(f"the chain is broken at {head['divergence']}: {head['reason']}")
            prev, start = head["head"], head["records"]
        else:
            prev, start = GENESIS, 0
        order = ["seq"] if "seq" in events.columns else ["ts", "event"]
        rows = [r.asDict() for r in events.orderBy(*order).limit(self.most + 1).collect()]
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} events in one batch")
        out = [(start + i, x) for i, x in enumerate(chain_records(rows, prev, start))]
        self.spark.createDataFrame(out, "pos bigint, line string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

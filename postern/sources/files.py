"""Readers and writers: raw mail, mailboxes, NDJSON cases and logs, TSV and JSON reference data."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.functions import lexicons as L
from postern.functions import scoring
from postern.operators.cases import storable
from postern.operators.enrich import clean_field, prefixes

CASE = (
    "id string, documentId string, status string, title string, subject string, messageId string, observedAt bigint, createdAt bigint, risk double, riskFinal double, confidence double, "
    "verdict string, band string, domains array<string>, addresses array<string>, hopAddresses array<string>, urls array<string>, attachmentHashes array<string>, members array<string>, "
    "evidenceHash string, attribution string"
)


def read_mail(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """(msg_id, content, evidence_hash): one row per file."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("msg_id"), "content", F.sha2("content", 256).alias("evidence_hash"))


def stream_mail(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    schema = spark.read.format("binaryFile").load(path).schema
    f = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return f.select(F.col("path").alias("msg_id"), "content", F.col("modificationTime").alias("arrived"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(msg_id, content) of mailbox files: split at lines that begin a message, inside the reader."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path, wholetext=False).withColumn("file", F.input_file_name())
    body = F.regexp_replace(F.regexp_replace("value", r"^(?:From )?[^\r\n]*\r?\n", ""), r"(?m)^>(>*From )", "$1")
    return lines.filter(F.length(F.trim("value")) > 0).select(F.concat_ws("#", "file", F.sha2("value", 256)).alias("msg_id"), F.encode(body, "utf-8").alias("content"))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected lines): bad lines are kept aside, missing times are NULL."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    df = lines.select("value", F.from_json("value", CASE + ", _bad string", options).alias("r"))
    good = df.filter("r._bad is null").select("r.*").drop("_bad").withColumn("observedAt", F.when(F.col("observedAt") >= 0, F.col("observedAt")))
    return good, df.filter("r._bad is not null").select(F.col("value").alias("_bad"))


def scan_cases(spark: SparkSession, path: str, records: int = 10_000, size: int = 32 << 20) -> tuple[DataFrame, bool]:
    """(cases, truncated): the first readable cases of a file, at most `records` and `size` bytes of lines; for a listing.

    Both limits are this reader's feature, and the flag says that one was met; read_cases() reads all.
    No file gives no cases.
    """
    if not any(_exists(spark, path)):
        return spark.createDataFrame([], CASE), False
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    # The sum up to a line is needed only for the first lines; anything after `records` readable ones is cut anyway.
    head = lines.orderBy("at").limit(10 * records).withColumn("sum", F.sum(F.length("value") + 1).over(Window.orderBy("at")))
    parsed = head.filter(F.col("sum") <= size).select("at", F.from_json("value", CASE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).filter("r is not null and r._bad is null")
    good = parsed.orderBy("at").limit(records).select("at", "r.*").drop("_bad")
    cut = head.filter(F.col("sum") > size).limit(1).count() > 0 or good.count() >= records
    return good.orderBy("at").drop("at"), cut


def _exists(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    yield fs.exists(p)


def append_cases(cases: DataFrame, path: str) -> None:
    """Append the records that may be stored, one JSON line each."""
    lower = cases.select([F.col(c).alias(c) for c in cases.columns])
    storable(lower).filter("accepted").drop("accepted").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file_pos, line): trimmed non-blank lines of a log in file order."""
    return spark.read.text(path).withColumn("file_pos", F.monotonically_increasing_id()).select("file_pos", F.trim("value").alias("line")).filter("line <> ''")


def read_networks(spark: SparkSession, path: str, limit: int = 200_000) -> DataFrame:
    """Address dataset: tab-separated, optional header, # comments; unusable networks are skipped.

    `limit` is the format's documented bound; a larger file is refused, never cut.
    """
    raw = spark.read.option("sep", "\t").option("comment", "#").schema("net string, country string, asn string, organization string, isp string, hostname string").csv(path)
    rows = raw.withColumn("row_no", F.monotonically_increasing_id()).filter(~F.lower("net").isin("ip", "cidr", "net"))
    good = prefixes(rows.select("row_no", F.trim("net").alias("net"), *[clean_field(c).alias(c) for c in ("country", "asn", "organization", "isp", "hostname")]))
    if good.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} networks")
    return good.drop("lo", "hi", "prefix")


def read_confusables(spark: SparkSession, path: str) -> dict[str, str]:
    """Look-alike table of a TSV file, checked: three fields, one target per source, targets that don't fold again."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("source string, target string, script string, note string").csv(path).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100000 look-alike entries")
    out: dict[str, str] = {}
    for r in rows:
        if r["source"] is None or r["target"] is None or r["script"] is None:
            raise ValueError(f"fewer than three fields: {r}")
        s = chr(int(r["source"][2:], 16)) if r["source"].upper().startswith("U+") else r["source"]
        if out.setdefault(s, r["target"]) != r["target"]:
            raise ValueError(f"conflicting targets for {s!r}")
    if bad := [s for s, t in out.items() if any(ch in out for ch in t)]:
        raise ValueError(f"folding is not idempotent for {bad[:3]}")
    return out


def read_profile(spark: SparkSession, path: str | None) -> dict[str, list]:
    """Organisation profile; no file gives an empty one, a malformed file is an error, blanks are skipped."""
    keys = ("own_domains", "brands", "executives", "partner_domains", "mail_ranges")
    if path is None or not any(_exists(spark, path)):
        return {k: [] for k in keys}
    row = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path).first()
    d = row.asDict(recursive=True) if row else {}
    text = lambda v: [x.strip() for x in (v or []) if isinstance(x, str) and x.strip()]
    out = {k: text(d.get(k)) for k in keys if k != "executives"}
    return out | {"executives": [e["name"] for e in d.get("executives") or [] if e.get("name")], "abuse_contact": d.get("abuse_contact")}


def write_model(path: str, source: str = "hand_set_uncalibrated", model: scoring.Model | None = None) -> None:
    """Store a model as JSON; `g` is in the order of its features."""
    m = model or scoring.Model()
    doc = {"b0": m.b0, "beta": m.beta, "g": [m.g0, *m.g.values()], "gamma": m.gamma, "temperature": m.temperature, "tau_high": m.tau_high, "tau_susp": m.tau_susp, "tau_cluster": L.TAU_CLUSTER, "clip_c": L.CLIP, "w_bec": L.W_BEC, "feature_count": len(L.FEATURES), "weights_source": source}
    with open(path, "w") as f:
        json.dump(doc, f)


def read_model(path: str) -> scoring.Model:
    """A stored model for scoring.score; its weights must say where they come from and have the right shape."""
    with open(path) as f:
        m = json.load(f)
    if m.get("weights_source") not in ("fitted", "hand_set_uncalibrated"):
        raise ValueError("weights_source must be fitted or hand_set_uncalibrated")
    if len(m["b0"]) != 8 or len(m["beta"]) != 8 or any(len(b) != 60 for b in m["beta"]) or len(m["g"]) != 1 + len(L.BEC_WEIGHTS):
        raise ValueError("a model has 8 intercepts, 8 x 60 weights and 1 + 11 of the second head")
    num = lambda k, d: float(m.get(k, d))
    return scoring.Model(
        [float(v) for v in m["b0"]], [[float(v) for v in b] for b in m["beta"]], float(m["g"][0]), dict(zip(L.BEC_WEIGHTS, map(float, m["g"][1:]), strict=True)),
        num("gamma", L.GAMMA), num("temperature", 1.0), num("tau_high", 60.0), num("tau_susp", 40.0), m["weights_source"],
    )


def strict_json(df: DataFrame, column: str, depth: int = 64) -> DataFrame:
    """Adds `valid`: strict JSON, nothing after it, no raw control characters, nested at most `depth` deep."""

    def ok(t):
        if t is None:
            return None
        try:
            v = json.loads(t, parse_constant=lambda x: 1 / 0)
        except (ValueError, RecursionError, ZeroDivisionError):
            return False
        level, todo = 0, [v]
        while todo and level <= depth:
            todo = [x for y in todo if isinstance(y, (dict, list)) for x in (y.values() if isinstance(y, dict) else y)]
            level += 1
        return not todo

    def valid(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(ok).astype("boolean")

    return df.withColumn("valid", F.pandas_udf(valid, T.BooleanType())(F.col(column)))

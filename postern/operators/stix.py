"""Threat-intelligence export: observable objects with deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions.text import uuid5

# Fixed value: the namespace of name-based identifiers.
NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
DOMAIN = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


def stix_id(kind, value: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(k, F.lit("--"), uuid5(NAMESPACE, F.concat(k, F.lit(":"), value)))


def observables(cases: DataFrame, strict: bool = False) -> DataFrame:
    """(case_no, type, value, stix_id) of every observable of every case, each once per case.

    `strict` strips the sha256: prefix of stored attachment hashes before the hex test; without it
    such hashes are left out, as the stored form isn't plain hex.
    """
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    tag = lambda kind, arr: F.transform(arr, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    ips = low(F.col("hopaddresses"))
    hashes = low(F.col("attachmenthashes"))
    if strict:
        hashes = F.transform(hashes, lambda h: F.regexp_replace(h, "^sha256:", ""))
    v4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
    items = F.concat(
        tag("email-message", F.filter(F.array("id"), lambda v: v.isNotNull() & (v != ""))),
        tag("email-addr", F.filter(low(F.col("addresses")), lambda v: v.rlike(r"^[^@\s]+@[^@\s]+$"))),
        tag("domain-name", F.filter(low(F.col("domains")), lambda v: v.rlike(DOMAIN))),
        tag("ipv4-addr", F.filter(ips, lambda v: v.rlike(v4))),
        tag("ipv6-addr", F.filter(ips, lambda v: v.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$"))),
        tag("url", F.filter(F.coalesce("urls", F.array().cast("array<string>")), lambda v: F.length(v).between(1, 2048))),
        tag("file", F.filter(hashes, lambda v: v.rlike("^[0-9a-f]{64}$"))),
    )
    x = cases.select("case_no", F.explode(F.array_distinct(items)).alias("x")).select("case_no", "x.*")
    return x.withColumn("stix_id", stix_id(F.col("type"), F.col("value")))


def distinct_objects(objects: DataFrame) -> DataFrame:
    """(stix_id, type, value, first_case): every object once, with the first case that shows it."""
    return objects.groupBy("stix_id", "type", "value").agg(F.min("case_no").alias("first_case"))


def bundles(objects: DataFrame, cap: int | None = None) -> DataFrame:
    """(case_no, bundle_id, n_objects, left_out, bundle): a JSON bundle per case; the id follows from its sorted object ids.

    A case's objects come from one row of the case table, so they are bounded by it. With a `cap`
    only that many are in the bundle and left_out says how many are not.
    """
    per = objects.groupBy("case_no").agg(F.array_sort(F.collect_set(F.struct(F.col("stix_id").alias("id"), "type", "value"))).alias("all"))
    per = per.withColumn("objs", F.col("all") if cap is None else F.slice("all", 1, cap))
    ids = F.array_join(F.transform("objs", lambda o: o["id"]), ",")
    return per.select(
        "case_no", F.concat(F.lit("bundle--"), uuid5(NAMESPACE, F.sha2(ids, 256))).alias("bundle_id"), F.size("objs").alias("n_objects"), (F.size("all") - F.size("objs")).alias("left_out"),
        F.to_json(F.struct(F.lit("bundle").alias("type"), F.col("objs").alias("objects"))).alias("bundle"),
    )

"""Case records: search, order and page, latest version, append guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("open", "closed", "escalated")


def free_text(q: str) -> Column:
    """Case-insensitive substring of the text fields or of any element of the arrays; blank matches all."""
    if not q.strip():
        return F.lit(True)
    needle = F.lit(q.lower())
    scalar = F.lit(False)
    for f in ("id", "title", "status", "subject", "messageid"):
        scalar = scalar | F.coalesce(F.contains(F.lower(f), needle), F.lit(False))
    for a in ("domains", "urls", "attachmenthashes"):
        scalar = scalar | F.coalesce(F.exists(a, lambda v: F.coalesce(F.contains(F.lower(v), needle), F.lit(False))), F.lit(False))
    return scalar


def ordered(cases: DataFrame) -> DataFrame:
    """Newest observation first, missing last, then id."""
    seen = F.when(F.col("observedat") >= 0, F.col("observedat"))
    return cases.orderBy(seen.desc_nulls_last(), F.col("id").asc_nulls_first(), "case_no")


def search(cases: DataFrame, q: str = "", status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of matching cases; a page past the end is empty, a bad page or status is an error."""
    if not (1 <= page <= 100_000 and 1 <= page_size <= 100):
        raise ValueError("page must be 1..100000 and page size 1..100")
    if status is not None and status.lower() not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    hit = cases.filter(free_text(q))
    if status is not None:
        hit = hit.filter(F.col("status") == status)
    return ordered(hit).offset((page - 1) * page_size).limit(page_size)


def page_totals(cases: DataFrame, q: str = "", status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One row: total, returned, scanned, truncated."""
    match = free_text(q) & (F.col("status").eqNullSafe(F.lit(status)) if status is not None else F.lit(True))
    t = cases.agg(F.count(F.when(match, 1)).alias("total"), F.count(F.lit(1)).alias("scanned"))
    rest = F.greatest(F.lit(0), F.least(F.lit(page_size), F.col("total") - (page - 1) * page_size))
    return t.select("total", rest.cast("bigint").alias("returned"), "scanned", F.lit(False).alias("truncated"))


def latest(cases: DataFrame, key: str = "id") -> DataFrame:
    """Last delivered row of each id: (id, case_no, status, risk, band)."""
    best = F.max(F.struct("ingestedat", "case_no", "status", "risk", "band"))
    return cases.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, "b.case_no", "b.status", "b.risk", "b.band")


def storable(cases: DataFrame) -> DataFrame:
    """Adds accepted: a record that lacks risk, domains, urls and attachment hashes altogether is refused."""
    return cases.withColumn("accepted", F.coalesce(F.col("risk").isNotNull() | F.col("domains").isNotNull() | F.col("urls").isNotNull() | F.col("attachmenthashes").isNotNull(), F.lit(False)))


def opening(automation: Column, asked: Column) -> Column:
    """Whether a case is opened: by the model if it may, else on an analyst's word."""
    return F.when(automation, True).otherwise(F.lower(asked).isin("analyst", "true"))


def document_id(messageid: Column, evidencehash: Column) -> Column:
    bare = F.regexp_replace(messageid, r"^[\s<]+|[>\s]+$", "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= 256), bare).otherwise(F.concat(F.lit("sha256:"), evidencehash))


def summaries(cases: DataFrame, longest: int = 200) -> DataFrame:
    """What a list of cases shows of each: identity, state, scores, a shortened subject and how much else there is."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    long = F.length("subject") > longest
    count = {f"n_{c}": F.when(F.col(c).isNull(), F.lit(0).cast("bigint")).otherwise(n(c)) for c in ("domains", "urls", "addresses", "hopaddresses", "attachmenthashes", "members")}
    return cases.select(
        "case_no", "id", "status", "verdict", "band", F.when(long, F.concat(F.substring("subject", 1, longest), F.lit("...[truncated]"))).otherwise(F.col("subject")).alias("subject"), F.when(F.col("observedat") >= 0, F.col("observedat")).alias("observed_ms"),
        *[v.alias(k) for k, v in count.items()], (F.col("attribution").isNotNull() | F.col("attributionraw").isNotNull()).alias("attributed"),
    )

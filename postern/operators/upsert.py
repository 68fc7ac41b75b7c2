"""Messages delivered more than once: an idempotent upsert store.

Layout. Every upsert writes one *run*: a table hash-bucketed by identifier, one file a bucket, sorted
inside each bucket, in which each identifier occurs once. Runs are listed in a manifest. A run is
written beside what it replaces and counts from the moment the manifest names it, so a retried batch
changes nothing, a lost one leaves the store as it was, and the store can be opened again. Compaction
merges the sorted runs two by two, bucket against bucket, with a full outer merge join that neither
exchanges nor sorts its inputs; equal identifiers collapse to the smaller arrival, and the merged run
replaces both.

Skew. The collapse inside a run is a minimum, which Spark combines before the shuffle: an
identifier that holds a third of all rows leaves each map task as one row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.session import remove, scratch_path


def message_key(messageid: Column, evidencehash: Column) -> Column:
    """Identifier of a delivery, or NULL where there is no evidence hash.

    The message id is compared without angle brackets, blanks around it and letter case; null and
    blank ids are equal. A row without evidence hash has no identity: it never counts as a copy.
    """
    bare = F.lower(F.regexp_replace(F.coalesce(messageid, F.lit("")), r"^[\s<>]+|[\s<>]+$", ""))
    return F.concat(F.lower(F.trim(evidencehash)), F.lit("|"), bare)


ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class UpsertStore:
    """Hash-bucketed sorted runs of (identifier, arrival) in a folder; `arrival` orders the copies.

    Empty batches write an empty run. Ties in arrival are broken by the row id, which is unique.
    Given the path of a store, that store is opened; one process writes to a store at a time.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.path = (path or scratch_path(spark, "store")).rstrip("/")
        known = self._manifest()
        self.buckets = known["buckets"] if known else buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.schema: str | None = known["schema"] if known else None
        self.runs: dict[str, str] = dict(known["runs"]) if known else {}  # name -> folder

    def _fs(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        """The manifest with the highest number; older ones are what it replaced."""
        p, fs = self._fs("manifest")
        found = sorted((s.getPath().getName() for s in fs.listStatus(p)), key=lambda n: int(n.split(".")[0])) if fs.exists(p) else []
        found = [n for n in found if n.endswith(".json")]
        self.number = int(found[-1].split(".")[0]) if found else 0
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first()[0]) if found else None

    def _commit(self, runs: dict[str, str]) -> None:
        """Name the runs that count from now on: a file written under another name and renamed."""
        text = json.dumps({"buckets": self.buckets, "schema": self.schema, "runs": runs})
        part, fs = self._fs(f"manifest/{self.number + 1}.part")
        final, _ = self._fs(f"manifest/{self.number + 1}.json")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, final):
            raise RuntimeError("another process has changed the store")
        gone = set(self.runs.values()) - set(runs.values())
        self.number, self.runs = self.number + 1, runs
        for folder in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {folder}")
            remove(self.spark, f"{self.path}/{folder}")

    def upsert(self, batch: DataFrame, run: str, key: str, order: list[str]) -> None:
        """Collapse one batch and write it as run `run`; the same run name replaces the run."""
        best = F.struct(*[c for o in order for c in (F.col(o).isNull().alias(f"{o}_unset"), F.col(o))])
        collapsed = batch.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("ident")).agg(F.min(best).alias("arrival"))
        folder = self._write(collapsed.repartition(self.buckets, "ident"))
        self._commit({**self.runs, run: folder})

    def _write(self, df: DataFrame) -> str:
        folder = f"run_{uuid.uuid4().hex[:16]}"
        df.write.option("path", f"{self.path}/{folder}").bucketBy(self.buckets, "ident").sortBy("ident").saveAsTable(folder)
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return folder

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed table of this session."""
        folder = self.runs[run]
        if not self.spark.catalog.tableExists(folder):
            self.spark.sql(f"CREATE TABLE {folder} ({self.schema}) USING parquet CLUSTERED BY (ident) SORTED BY (ident) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return self.spark.table(folder)

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one: (ident, arrival)."""
        x = self.table(a).withColumnRenamed("arrival", "arrival_a").hint("merge")
        y = self.table(b).withColumnRenamed("arrival", "arrival_b").hint("merge")
        return x.join(y, "ident", "full_outer").select("ident", F.least("arrival_a", "arrival_b").alias("arrival"))

    def compact(self) -> DataFrame:
        """One row per identifier: (ident, arrival). Merges the runs two by two until one is left, each merge written."""
        if not self.runs:
            raise ValueError("the store holds no run")
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            while len(self.runs) > 1:
                a, b = sorted(self.runs)[:2]
                rest = {k: v for k, v in self.runs.items() if k not in (a, b)}
                self._commit({**rest, f"{b}+": self._write(self.merged(a, b))})
        finally:
            self.spark.conf.set(ORDERED, before)
        return self.table(next(iter(self.runs)))


def duplicate_deliveries(cases: DataFrame, runs: int = 3) -> DataFrame:
    """case_no of every delivery that a compacted store drops.

    The batches of the table are replayed as `runs` upserts (whole batches by hash of batch_id; a
    null batch_id is a batch of its own). The copy with the lowest ingestedat, then the lowest
    case_no stays; a null ingestedat counts as latest. An empty table gives no rows.
    """
    rows = cases.select(
        "case_no", "ingestedat", "batch_id", message_key(F.col("messageid"), F.col("evidencehash")).alias("ident_key")
    )
    store = UpsertStore(cases.sparkSession)
    for i in range(runs):
        part = rows.filter(F.pmod(F.xxhash64("batch_id"), F.lit(runs)) == i)
        store.upsert(part, f"r{i}", "ident_key", ["ingestedat", "case_no"])
    kept = store.compact().select(F.col("arrival.case_no").alias("case_no"))
    return rows.filter(F.col("ident_key").isNotNull()).select("case_no").join(kept, "case_no", "left_anti")

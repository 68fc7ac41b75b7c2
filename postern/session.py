"""Session helpers: building a session, and the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "postern", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; `conf` wins over the defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map={**base, **{k: str(v) for k, v in conf.items()}}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can read.

    Where it is unset, a session whose executors are threads of this process gets a temporary folder;
    on a cluster that is an error, as executors would write to disks of their own.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="postern-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


_OWN: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's part of the shared folder, which is removed when Python ends."""
    own = f"{shared_dir(spark)}/postern/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, whatever its file system; one that is gone, or a session that has ended, is fine."""
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage at replicated files and gives the planner the table's true size, so a
    side is broadcast only when it has been measured to be small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; keeps nested array expressions from being copied."""
    return F.transform(F.array(value), body)[0]

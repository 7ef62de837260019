"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "narracode", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the submitter sets these. Its
    scratch folder lives as long as the process."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if "spark.checkpoint.dir" not in conf:
        scratch = tempfile.mkdtemp(prefix="narracode-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        builder = builder.config("spark.checkpoint.dir", scratch)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else the session's warehouse, which
    is always set and which all executors reach."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder below the shared one that holds all scratch tables of this application."""
    return f"{shared_dir(spark)}/narracode/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder.

    Later readers scan the files, so a lost executor costs a re-read and not a re-run of
    everything upstream.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Plans that are made inside send rows to Python in batches of about ``size``: of wide rows, the
    usual ones take several hundred MB in a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, once its results are written."""
    jvm, root = spark.sparkContext._jvm, scratch_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

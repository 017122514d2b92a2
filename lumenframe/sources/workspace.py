"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests on one machine.
FALLBACK = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir`` of the session, else a folder of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{FALLBACK}/{uuid.uuid5(uuid.NAMESPACE_OID, tempfile.gettempdir()).hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new empty folder under the shared one; Hadoop deletes it when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame, name: str, rows_per_task: int | None = None) -> DataFrame:
    """Writes a table in the shared folder and reads it back: later stages neither recompute nor need the first executors.

    With ``rows_per_task`` the table is read by as many tasks as its rows call for, however many files it has: a small
    table then makes few shuffle files, and a large one keeps its parallelism.
    """
    spark = df.sparkSession
    path = f"{fresh_folder(spark, name)}/table"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.coalesce(max(1, -(-out.count() // rows_per_task))) if rows_per_task else out

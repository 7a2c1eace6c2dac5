"""Files in the shared folder: tables that must not be computed twice, and layouts that queries write and read back."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def kept_folder(spark: SparkSession, name: str) -> str:
    """A path that is not there yet, in ``spark.checkpoint.dir``; in a temporary folder only where that is unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """The same, for files that are deleted when the interpreter ends."""
    out = kept_folder(spark, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def clean() -> None:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return

    atexit.register(clean)
    return out


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once, where several plans read them."""
    out = scratch(rows.sparkSession, name)
    rows.write.parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def laid(rows: DataFrame, value: Column, key: str, name: str) -> str:
    """Lines ``value`` in the order of ``key`` as text, in several part files; their path."""
    out = scratch(rows.sparkSession, name)
    rows.select(value.alias("value"), key).repartitionByRange(4, key).sortWithinPartitions(key).select("value").write.text(out)
    return out

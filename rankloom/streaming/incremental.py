"""Incremental append by id, restartable work lists, and running confusion counts.

Batch inputs use the anti-join of :func:`rankloom.operators.joins.unprocessed`.  Where new rows keep
arriving as files, streams keep what they have seen and counted in their state store; the checkpoint folder makes a restart go
on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.joins import unprocessed
from rankloom.sources.records import valid_shards


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_new(rows: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "id") -> int:
    """Work on the rows whose id the output lacks, append the results, and return how many there were: counted as they are written."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if exists(spark, path):
        fresh = unprocessed(fresh, spark.read.parquet(path).select(key), key)
    seen = Observation()
    work(fresh).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def arriving(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """JSON files that arrive in ``source``."""
    return spark.readStream.schema(schema).json(source)


def append_stream(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "id") -> StreamingQuery:
    """The same for JSON files that arrive in ``source``; it takes all that are there, then stops.

    The ids that were seen are kept in the checkpoint's state store, so the output is never read.  A batch has a folder ``batch=N`` of its
    own below ``path``, which it replaces when it is run again after a failure.
    """
    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = arriving(spark, source, schema).dropDuplicates([key])
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def confusion_stream(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """(gold, predicted, n) over all JSON rows (gold, predicted, ...) that have arrived: the counts live in the state store.

    After each batch ``path`` is replaced by the whole matrix, one row for each pair of classes.
    """
    def put(matrix: DataFrame, _: int) -> None:
        matrix.coalesce(1).write.mode("overwrite").parquet(path)

    counts = arriving(spark, source, schema).groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def missing_chunks(done: DataFrame, expected: int) -> DataFrame:
    """(chunk) numbers from 0 that have no results yet."""
    spark = done.sparkSession
    return spark.range(expected).select(F.col("id").cast("int").alias("chunk")).join(done.select("chunk"), "chunk", "left_anti")


def repaired(spark: SparkSession, path: str, expected: DataFrame, compute: Callable[[DataFrame], DataFrame], shard: str = "shard") -> list:
    """Compute again the shards of a table at ``path`` that do not have the rows that ``expected`` (shard, expected) says, and return their names.

    ``compute`` gets a table of those shards and gives their rows.  Only their folders are replaced.  ``ValueError`` if a shard is not right then either.
    """
    def broken() -> list:
        if not exists(spark, path):
            return sorted(r[0] for r in expected.where("expected > 0").select(shard).collect())
        there = spark.read.parquet(path).select(F.col(shard).alias("shard"))
        found = valid_shards(there, expected.select(F.col(shard).alias("shard"), "expected"))
        return sorted(r["shard"] for r in found.where(~F.col("valid")).collect())  # names of shards, never rows

    bad = broken()
    if bad:
        wanted = expected.where(F.col(shard).isin(bad)).select(shard)
        compute(wanted).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
        if still := broken():
            raise ValueError(f"shards {still} still have other rows than expected")
    return bad


def cached(keys: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """Values by key from a Parquet cache; missing ones are computed and added first."""
    append_new(keys, path, compute, key)
    return keys.sparkSession.read.parquet(path).join(keys.select(key), key, "left_semi")


def running_confusion(total: DataFrame | None, batch: DataFrame) -> DataFrame:
    """(gold, predicted, n) after one more batch of rows (gold, predicted)."""
    now = batch.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return now if total is None else total.unionByName(now).groupBy("gold", "predicted").agg(F.sum("n").alias("n"))

"""Shared pieces: intermediate tables in the shared folder, splits, sizes."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, a single machine) a temporary folder is made.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[tuple[object, object, str]] = []


def _delete(tables: list[tuple[object, object, str]]) -> None:
    for fs, path, _ in tables:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and any executor may be lost."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not _made:
        atexit.register(lambda: _delete(_made))
    _made.append((path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, out))
    table_ = spark.read.schema(df.schema).parquet(out)
    table_._shared_at = out
    return table_


def tables_made() -> list[str]:
    """Shared tables that are there now, for :func:`release`."""
    return [at for _, _, at in _made]


def release(before: list[str], *needed: DataFrame) -> None:
    """Delete the shared tables written since ``before``, but those of ``needed``; what is read later must not depend on them."""
    keep = {*before, *(df._shared_at for df in needed)}
    gone = [m for m in _made if m[2] not in keep]
    _delete(gone)
    _made[:] = [m for m in _made if m[2] in keep]


#: Documents that an Arrow batch holds at most.
BATCH_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Whole texts make Arrow batches large on both sides of the pipe; the session's limit is lowered, never raised.

    Results are lazy and read the limit when they run, so it stays lowered for the session (the README says so).
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def protected(docs: DataFrame, own: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs``; those not in ``own`` are out of the way of its names meanwhile."""
    away = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in own}
    out = work(docs.withColumnsRenamed(away))
    return out.select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


def held_out(key: Column, mod: int, rest: int) -> Column:
    return fold(key, mod) == rest


def partitions(spark: SparkSession, least: int = 12) -> int:
    """Shuffle partitions of this session; it grows with the cluster's setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Integers that ``repartition(n, key)`` deals to the partitions 0, 1 ... in turn, so that n groups are not dealt by chance."""
    found: dict[int, int] = {}
    begin = 0
    while len(found) < n:
        end = begin + 8 * n
        for r in spark.range(begin, end).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).collect():
            found.setdefault(r["p"], r["k"])
        begin = end
    return [found[p] for p in range(n)]


def columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a result of bounded size, as Arrow gives them: no object per row."""
    got = df.toArrow()
    return [c.to_numpy() for c in got.columns]


def least_count(histogram: list[tuple[int, int]], most: int) -> int:
    """The least count such that rows of at least it number no more than ``most``."""
    least, total = 1 + max((n for n, _ in histogram), default=0), 0
    for n, rows in sorted(histogram, reverse=True):
        total += rows
        if total > most:
            break
        least = n
    return least


def blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))

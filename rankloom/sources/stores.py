"""Stores that a later job opens: a vector index in shards with a manifest, and a document store by id.

Both are Parquet folders at a path, written and read by Spark alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import dense
from rankloom.operators.ranking import top_k

#: Vectors of a shard, as it is meant; the range shuffle makes them about so many.
SHARD_ROWS = 1 << 16
#: Buckets of a document store.
BUCKETS = 64


# --- vector index ------------------------------------------------------------------------------


def _checksum(*columns: str) -> Column:
    """Of rows in any order."""
    return F.sum(F.pmod(F.xxhash64(*columns), F.lit(2**31 - 1)))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("least_dims"), F.max(F.size("embedding")).alias("dims"), _checksum("docid", "embedding").alias("checksum"), F.max("norm").alias("top"), F.min("norm").alias("bottom"))


def write_index(rows: DataFrame, path: str, key: str = "docid", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> None:
    """Vectors in shards by falling length, each a folder of ``path``/shards, and ``path``/manifest: a row for each shard.

    The manifest is written last and from what was given, so an index without one, or one that differs from it, was not written to its end.
    Rows whose id or vector is null are left out.  An existing index is replaced.
    """
    v = F.col(vector).cast("array<double>")
    own = rows.select(F.col(key).alias("docid"), v.alias("embedding"), F.sqrt(dense.dot(v, v)).alias("norm")).where("docid is not null and embedding is not null")
    n, total = own.agg(F.count("*"), F.coalesce(_checksum("docid", "embedding"), F.lit(0))).first()
    ranged = own.repartitionByRange(max(1, -(-n // shard_rows)), F.desc("norm"), "docid").sortWithinPartitions(F.desc("norm"), "docid")
    ranged.withColumn("shard", F.spark_partition_id()).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards")
    spark = rows.sparkSession
    if not n:
        _sums(own.withColumn("shard", F.lit(0))).write.mode("overwrite").parquet(f"{path}/manifest")
        return
    manifest = _sums(spark.read.parquet(f"{path}/shards")).orderBy("shard").collect()  # one row for each shard
    if (sum(r["rows"] for r in manifest), sum(r["checksum"] for r in manifest)) != (n, total):
        raise ValueError("what was written is not what was given")
    schema = "shard int, rows long, least_dims int, dims int, checksum long, top double, bottom double"
    spark.createDataFrame([tuple(r) for r in manifest], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


@dataclass
class VectorIndex:
    vectors: DataFrame
    #: (shard, rows, length of its longest vector), longest first.
    shards: list[tuple[int, int, float]]
    dims: int

    @property
    def rows(self) -> int:
        return sum(n for _, n, _ in self.shards)


def open_index(spark: SparkSession, path: str, check: bool = True) -> VectorIndex:
    """The index at ``path``; with ``check`` its shards are compared with the manifest, and a difference raises ``ValueError``."""
    manifest = spark.read.parquet(f"{path}/manifest").collect()  # one row for each shard
    if not manifest:
        return VectorIndex(spark.createDataFrame([], "docid string, embedding array<double>, norm double, shard int"), [], 0)
    vectors = spark.read.parquet(f"{path}/shards")
    if check:
        found = {r["shard"]: tuple(r) for r in _sums(vectors).collect()}
        bad = sorted({r["shard"] for r in manifest if found.get(r["shard"]) != tuple(r)} | (set(found) - {r["shard"] for r in manifest}))
        if bad:
            raise ValueError(f"shards {bad} differ from the manifest")
        if len({d for r in manifest for d in (r["least_dims"], r["dims"])}) > 1:
            raise ValueError("vectors of several lengths")
    return VectorIndex(vectors, sorted(((r["shard"], r["rows"], r["top"]) for r in manifest), key=lambda s: (-s[2], s[0])), manifest[0]["dims"])


@dataclass
class Found:
    rows: DataFrame
    #: Shards that were not read, over all blocks of queries, of ``shards``.
    skipped: int
    shards: int


def search_index(index: VectorIndex, queries: DataFrame, k: int = 100, query_key: str = "qid", vector: str = "embedding") -> Found:
    """The k largest inner products of each query, ties by id: exact.

    The shards of the longest vectors are searched first; a shard whose longest vector times the query's length cannot reach the k-th best score found there is not read.
    Queries go in blocks (see :data:`dense.QUERY_BLOCK`).
    """
    spark = queries.sparkSession
    first, rows = [], 0
    for shard, n, _ in index.shards:
        first.append(shard)
        rows += n
        if rows >= k:
            break
    found, skipped, read = [], 0, 0
    for block in dense.query_blocks(queries, query_key, vector):
        if not first:
            continue
        head = dense.search_block(index.vectors.where(F.col("shard").isin(*first)), block, k)
        # one number for each query of the block
        bound = {r["qid"]: r["bound"] for r in top_k(head, k, F.desc("score"), F.col("docid")).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k).collect()}
        own = block.with_bounds(bound)
        rest = [s for s, _, top in index.shards[len(first) :] if own.reached(top)]
        read += len(index.shards)
        skipped += len(index.shards) - len(first) - len(rest)
        found.append(head)
        if rest:
            found.append(dense.search_block(index.vectors.where(F.col("shard").isin(*rest)), own, k))
    if not found:
        return Found(spark.createDataFrame([], f"qid {queries.schema[query_key].dataType.simpleString()}, docid {index.vectors.schema['docid'].dataType.simpleString()}, score double, rank int"), 0, 0)
    return Found(top_k(reduce(DataFrame.unionAll, found), k, F.desc("score"), F.col("docid")), skipped, read)


# --- document store ----------------------------------------------------------------------------


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class DocumentStore:
    """Documents by id: a folder for each bucket (a hash of the id), files sorted by id with a Bloom filter of it.

    The document that came first stays; of rows that repeat an id within a batch, the least (by its other columns, in order) is taken.  Rows
    without an id are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, schema: str):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path, key, buckets, schema

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str = "docid", buckets: int = BUCKETS) -> DocumentStore:
        """An empty store; it remembers its key, schema and number of buckets."""
        spark.createDataFrame([(key, buckets, schema)], "key string, buckets int, schema string").coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path, key, buckets, schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DocumentStore:
        return cls(spark, path, *spark.read.parquet(f"{path}/layout").first())

    def read(self) -> DataFrame:
        from rankloom.streaming.incremental import exists

        schema = f"{self.schema}, bucket int"
        at = f"{self.path}/documents"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def add(self, rows: DataFrame) -> None:
        """Those of ``rows`` whose id the store lacks.  Only the ids of the buckets that the batch touches are read, and only its rows are moved."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        batch = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*(c for c in names if c != self.key))).alias("_d")).select(*(F.col(c) if c == self.key else F.col(f"_d.{c}").alias(c) for c in names))
        batch = batch.withColumn("bucket", _bucket(self.key, self.buckets))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most the number of buckets
        old = self.read().where(F.col("bucket").isin(*touched)).select("bucket", self.key)
        fresh = batch.join(old, ["bucket", self.key], "left_anti").select(*names, "bucket")
        out = fresh.repartition("bucket").sortWithinPartitions("bucket", self.key)
        out.write.mode("append").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.block.size", str(16 << 20)).parquet(f"{self.path}/documents")

    def fetch(self, ids: list) -> DataFrame:
        """The documents of a list of ids: other buckets are not listed, other row groups not read."""
        if not ids:
            return self.read().drop("bucket").limit(0)
        kind = self.spark.createDataFrame([], self.schema).schema[self.key].dataType.simpleString()
        asked = self.spark.createDataFrame([(i,) for i in ids], f"{self.key} {kind}")
        wanted = sorted(r["b"] for r in asked.select(_bucket(self.key, self.buckets).alias("b")).distinct().collect())
        return self.read().where(F.col("bucket").isin(*wanted) & F.col(self.key).isin(*ids)).drop("bucket")

    def fetch_all(self, ids: DataFrame) -> DataFrame:
        """The documents of a table of ids of any size: a join within buckets."""
        asked = ids.select(self.key).distinct().withColumn("bucket", _bucket(self.key, self.buckets))
        return self.read().join(asked, ["bucket", self.key], "left_semi").drop("bucket")

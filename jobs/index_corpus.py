"""Keep the postings of a growing corpus: a stream of document files, taken up where the last run ended.

    spark-submit jobs/index_corpus.py --documents DIR --output DIR --checkpoint DIR

Sparse retrieval needs each word's documents with counts and lengths.  Those of a document never change, so a corpus to which
files are added only needs the postings of new documents; frequencies and mean length follow from them when a search asks.
The job reads Parquet files as a stream until all that are there have been taken.  The checkpoint remembers the files, and in its
state store the ids that were seen: a document whose id has come before, in any run, is left out.  Ids stand for one text each;
where rows of one batch repeat an id, one of them is taken.  Rows without an id are left out; a null or empty text is a document of no words.

Output, below ``output``:
  documents/batch=N/             docid, language, len
  postings/batch=N/bucket=B/     term, docid, tf, len, language; B is a hash of the term
A batch writes its own folders with dynamic overwrite, so one that is run again after a failure replaces what it had written.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.common import LOG, command_line, settings  # noqa: E402
from rankloom.operators import sparse  # noqa: E402


#: Documents of an Arrow batch whose words are counted together, at most.
BATCH_ROWS = 1000


#: Words of a share of a bucket, about.
SHARE_WORDS = 2_000_000


def shares_of(words: int, buckets: int) -> int:
    """Shares of each bucket of a batch of so many words: 4 at least, so that small batches write few files."""
    return max(4, -(-words // (buckets * SHARE_WORDS)))


def index_batch(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """Write the documents and postings of one batch into folders of its own."""
    docs = batch.select(F.col(config["key"]).alias("docid"), F.col(config["language"]).alias("language"), F.coalesce(sparse.words(config["text"]), F.array().cast("array<string>")).alias("w"))
    put = lambda rows, name, *by: rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{output}/{name}")
    docs = docs.persist()  # both tables come from one read of the batch
    conf, limit = batch.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    former = conf.get(limit)
    try:
        conf.set(limit, str(BATCH_ROWS))
        put(docs.select("docid", "language", F.size("w").alias("len")), "documents")
        # a document is one row here, so its words are counted in the task that holds it; buckets are by md5, so that other engines can find a word's folder
        rows = sparse.row_postings(docs, config["buckets"], "language")
        # a bucket's files are sorted by term; its postings are cut by document into shares whose size does not grow with the batch
        words = docs.agg(F.sum(F.size("w"))).first()[0] or 0
        shares = shares_of(words, config["buckets"])
        tasks = max(int(conf.get("spark.sql.shuffle.partitions")), config["buckets"] * shares // 4)
        put(rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("docid"), F.lit(shares))).sortWithinPartitions("bucket", "term", "docid"), "postings", "bucket")
    finally:
        conf.set(limit, former)
        docs.unpersist()


def arriving(spark: SparkSession, documents: str, schema: StructType, files_per_batch: int) -> DataFrame:
    """A stream of the files in a folder; a path of one file is a stream of that file alone."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = documents.rstrip("/").rpartition("/")
    first = spark.read.parquet(documents).select("_metadata.file_name").first()
    if first and first["file_name"] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(documents)


def index_corpus(spark: SparkSession, documents: str, output: str, checkpoint: str, **given) -> dict:
    """Index what is new among ``documents``; returns what was read and written."""
    config = settings(__file__, **given)
    schema = spark.read.parquet(documents).select(config["key"], config["text"], config["language"]).schema
    told = {"batches": 0, "documents": 0, "postings": 0}

    def work(batch: DataFrame, number: int) -> None:
        index_batch(batch, number, output, config)
        wrote = {t: batch.sparkSession.read.parquet(f"{output}/{t}").where(F.col("batch") == number).count() for t in ("documents", "postings")}
        LOG.info("batch %s: wrote %s documents, %s postings to %s", number, wrote["documents"], wrote["postings"], output)
        told["batches"] += 1
        for t, n in wrote.items():
            told[t] += n

    new = arriving(spark, documents, schema, config["files_per_batch"]).where(F.col(config["key"]).isNotNull()).dropDuplicates([config["key"]])
    stream = new.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()
    try:
        stream.awaitTermination()
    finally:
        if stream.isActive:
            stream.stop()
    told["read"] = sum(p["numInputRows"] for p in stream.recentProgress)
    LOG.info("read %s new rows of %s; wrote %s documents and %s postings in %s batches", told["read"], documents, told["documents"], told["postings"], told["batches"])
    return told


def read_postings(spark: SparkSession, output: str) -> DataFrame:
    """(docid, term, tf, len, language, bucket) of all runs."""
    return spark.read.parquet(f"{output}/postings").select("docid", "term", "tf", "len", "language", "bucket")


def main() -> None:
    args, config, spark = command_line(__file__, index_corpus.__doc__, "documents", "output", "checkpoint")
    try:
        index_corpus(spark, args.documents, args.output, args.checkpoint, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

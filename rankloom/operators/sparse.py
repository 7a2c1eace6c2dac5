"""BM25: index statistics and scores as joins on the term."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.sources.scratch import scratch

#: Words are runs of letters and digits; the library defaults that apply where no parameters are given.
TOKEN = r"[\p{L}\p{N}]+"
K1, B, EPSILON = 1.5, 0.75, 0.25


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("docid"), F.explode(words(text)).alias("term"))


def tokenised(docs: DataFrame, key: str = "docid", text: str = "text") -> DataFrame:
    """(docid, w): every document's words, written once, as all statistics and postings come from them."""
    out = scratch(docs.sparkSession, "words")
    rows = docs.select(F.col(key).alias("docid"), F.coalesce(words(text), F.array().cast("array<string>")).alias("w"))
    rows.write.parquet(out)
    return docs.sparkSession.read.schema(rows.schema).parquet(out)


def document_frequencies(own: DataFrame) -> DataFrame:
    """(term, df): words are made distinct within each row, so one aggregate by term is enough."""
    return own.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def statistics(own: DataFrame) -> tuple[int, float, float]:
    """Number of documents, mean length, and what replaces a negative idf: a quarter of the mean idf.

    idf depends on df alone, so the mean comes from the histogram of df, which is short.
    """
    n, avgdl = own.agg(F.count("*"), F.coalesce(F.avg(F.size("w")), F.lit(0.0))).first()
    counted = document_frequencies(own).groupBy("df").agg(F.count("*").alias("terms")).collect()
    total = sum(r["terms"] for r in counted)
    mean = sum(r["terms"] * (math.log(n - r["df"] + 0.5) - math.log(r["df"] + 0.5)) for r in counted) / total if total else 0.0
    return n, avgdl, EPSILON * mean


def idf(n: int, floor: float) -> Column:
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return F.when(raw < 0, floor).otherwise(raw)


def postings(own: DataFrame, *more: str) -> DataFrame:
    """(docid, term, tf, len) and the columns ``more`` of the document, from (docid, w)."""
    rows = own.select("docid", F.size("w").alias("len"), *more, F.explode("w").alias("term"))
    return rows.groupBy("docid", "len", "term", *more).agg(F.count("*").alias("tf"))


def _counted(own: list[str], buckets: int):
    """Postings of an Arrow batch of (*own, w): words are numbered once, then rows and numbers are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w")
            words = pc.list_flatten(w).dictionary_encode()
            names, n = words.dictionary, len(words.dictionary)
            if not n:
                continue
            keys, tf = np.unique(pc.list_parent_indices(w).to_numpy().astype(np.int64) * n + words.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(keys, n)
            bucket = np.array([int.from_bytes(hashlib.md5(t).digest()[:2], "big") % buckets for t in names.cast(pa.binary()).to_pylist()], dtype=np.int32)
            lengths = pc.list_value_length(w).cast(pa.int32())
            for a in range(0, len(keys), 1 << 16):
                at = slice(a, a + (1 << 16))
                rows = pa.array(row[at])
                parts = {c: batch.column(c).take(rows) for c in own} | {"len": lengths.take(rows), "term": names.take(pa.array(term[at])), "tf": pa.array(tf[at], pa.int64()), "bucket": pa.array(bucket[term[at]])}
                yield pa.RecordBatch.from_pydict(parts)

    return run


def row_postings(own: DataFrame, buckets: int, *more: str) -> DataFrame:
    """(docid, the columns ``more``, len, term, tf, bucket) from (docid, w) with one row a document: each is counted where it is, and nothing is shuffled.

    The bucket is the first two bytes of the term's md5, modulo ``buckets``.
    """
    kept = ["docid", *more]
    kinds = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in kept]
    return own.select(*kept, "w").mapInArrow(_counted(kept, buckets), ", ".join([*kinds, "len int, term string, tf long, bucket int"]))


def index(docs: DataFrame, key: str = "docid", text: str = "text") -> tuple[DataFrame, DataFrame, tuple[int, float, float]]:
    """(postings: docid, term, tf, len), (terms: term, df, idf), :func:`statistics`."""
    own = tokenised(docs, key, text)
    n, avgdl, floor = statistics(own)
    return postings(own), document_frequencies(own).withColumn("idf", idf(n, floor)), (n, avgdl, floor)


def scores(queries: DataFrame, docs: DataFrame, query_key: str = "qid", query_text: str = "query", key: str = "docid", text: str = "text") -> DataFrame:
    """(qid, docid, score) of pairs that share a term; a term that a query repeats counts again.

    Only words of the queries leave the scan of the documents; their lengths travel with them.
    """
    asked = tokens(queries, query_key, query_text).withColumnRenamed("docid", "qid").groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    wanted = asked.select("term").distinct()
    own = tokenised(docs, key, text)
    n, avgdl, floor = statistics(own)
    rows = own.select("docid", F.size("w").alias("len"), F.explode("w").alias("term"))
    tf = rows.join(wanted, "term", "left_semi").groupBy("term", "docid", "len").agg(F.count("*").alias("tf"))
    terms = document_frequencies(own).join(wanted, "term", "left_semi").select("term", idf(n, floor).alias("idf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avgdl))
    part = tf.join(terms, "term").select("term", "docid", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("w"))
    return part.join(asked, "term").groupBy("qid", "docid").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def search(queries: DataFrame, docs: DataFrame, k: int = 100, negated: bool = False, **names) -> DataFrame:
    """The k best documents of each query; ties (to 9 decimals, as sums may be taken in any order) by id.

    Postings are read by falling impact, as far as needed (see ``impacts``).  ``negated`` stores -score, as some run files do.
    """
    from rankloom.operators import impacts

    return impacts.search(queries, docs, k, negated, **names)

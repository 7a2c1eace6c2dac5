"""Exact dense retrieval over embedding tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import top_k

#: Queries whose vectors are broadcast together, at most; more are searched block by block.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    doubles = v.cast("array<double>")
    norm = F.sqrt(dot(doubles, doubles))
    return F.transform(doubles, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalised(a), normalised(b))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of token vectors whose mask is 1."""
    weights = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    first = F.transform(vectors[0], lambda x: F.lit(0.0))
    summed = F.aggregate(F.arrays_zip(vectors.alias("v"), mask.alias("m")), first, lambda acc, t: F.zip_with(acc, t["v"], lambda s, x: s + x.cast("double") * t["m"]))
    return F.transform(summed, lambda x: x / F.greatest(weights, F.lit(1e-9)))


def last_token_pooled(vectors: Column, mask: Column, left_padded: bool) -> Column:
    """The last token's vector: the last place if padding is on the left, else that of the last mask of 1."""
    if left_padded:
        return F.element_at(vectors, -1)
    return F.element_at(vectors, F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int")))


def is_left_padded(rows: DataFrame, mask: str = "mask") -> bool:
    """Whether every row's last mask is 1."""
    return bool(rows.agg(F.coalesce(F.bool_and(F.element_at(mask, -1) == 1), F.lit(True))).first()[0])


def _sortable(ids: pa.Array) -> np.ndarray:
    """Ids as numpy sorts them: numbers, or text by code points (the order of UTF-8 bytes)."""
    return np.array(ids.to_pylist(), dtype=str) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids.to_numpy(zero_copy_only=False)


#: Numbers of a product of rows and queries that are held at once.
PRODUCT = 1 << 22


@dataclass
class Block:
    """Query vectors that are sent to tasks together; ``bound`` is what a score must reach (-inf: anything)."""

    ids: pa.Array
    vectors: np.ndarray
    bound: np.ndarray

    def with_bounds(self, bound: dict) -> Block:
        return Block(self.ids, self.vectors, np.array([bound.get(q, -np.inf) for q in self.ids.to_pylist()]))

    def reached(self, length: float) -> bool:
        """Whether a vector of this length may reach the bound of any query (Cauchy-Schwarz)."""
        return bool((self.lengths * length * (1 + 1e-9) + 1e-12 >= self.bound).any())

    @property
    def lengths(self) -> np.ndarray:
        return np.sqrt((self.vectors**2).sum(1))


def _nearest(shared, k: int, skip_self: bool, kind: pa.DataType):
    """Each task's k best for every query of a block, selected for all queries at once."""

    def best(query, s, d):
        """The k best of each query, sorted by query."""
        order = np.lexsort((d, -s, query))
        query, s, d = query[order], s[order], d[order]
        start = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=bool)
        at = np.arange(len(query))
        keep = at - np.maximum.accumulate(np.where(start, at, 0)) < k
        return query[keep], s[keep], d[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        n, lengths, least = len(block.ids), block.lengths, block.bound.copy()
        own = _sortable(block.ids)
        held, waiting = (np.zeros(0, dtype=np.int64), np.zeros(0), own[:0] if skip_self else None), 0
        parts: list[tuple] = []

        def settle():
            nonlocal held, parts, waiting
            if parts:
                every = [held, *parts] if len(held[0]) else parts
                held, parts, waiting = best(*(np.concatenate(x) for x in zip(*every, strict=True))), [], 0
                count = np.bincount(held[0], minlength=n)
                full = np.flatnonzero(count >= k)
                least[full] = np.maximum(least[full], held[1][(np.cumsum(count) - 1)[full]])

        for batch in batches:
            if not batch.num_rows:
                continue
            every = _sortable(batch.column(0))
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(every), -1)
            step = max(1, PRODUCT // n)
            for a in range(0, len(every), step):
                rows, ids = vectors[a : a + step], every[a : a + step]
                longest = np.sqrt((rows * rows).sum(1).max())
                some = np.flatnonzero(lengths * longest * (1 + 1e-9) + 1e-12 >= least)
                if not len(some):
                    continue
                s = block.vectors[some] @ rows.T
                take = s >= (least[some] - 1e-12 * lengths[some] * longest)[:, None]  # products of other shapes may differ by rounding
                if skip_self:
                    take &= own[some, None] != ids
                if s.shape[1] > k:  # of one product no query needs more than its k best
                    s_ = np.where(take, s, -np.inf)
                    take &= s >= np.partition(s_, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                q, d = np.nonzero(take)
                parts.append((some[q], s[q, d], ids[d]))
                waiting += len(q)
                if waiting > n * k:
                    settle()
        settle()
        q, s, d = held
        d = pa.array([] if d is None else d.tolist(), kind)
        yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(q)), d, pa.array(s)], names=["qid", "docid", "score"])

    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def _kind(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType.simpleString()
    if kind not in _ARROW:
        raise TypeError(f"ids of type {kind} are not searched")
    return kind


def query_blocks(queries: DataFrame, key: str = "qid", vector: str = "embedding") -> Iterator[Block]:
    """Queries in blocks of about :data:`QUERY_BLOCK`, each collected on its own."""
    kind = _kind(queries, key)
    asked = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and q is not null")
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    for block in range(n):
        own = asked if n == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == block)
        rows = own.collect()  # one block of bounded size
        if rows:
            yield Block(pa.array([r["q"] for r in rows], _ARROW[kind]), np.array([r["v"] for r in rows], dtype=np.float64), np.full(len(rows), -np.inf))


def search_block(docs: DataFrame, block: Block, k: int, skip_self: bool = False) -> DataFrame:
    """(qid, docid, score): every task's k best of ``docs`` (docid, embedding), none below the block's bounds."""
    kind = _kind(docs, "docid")
    shared = docs.sparkSession.sparkContext.broadcast(block)
    of = {v: name for name, v in _ARROW.items()}
    return docs.select("docid", "embedding").mapInArrow(_nearest(shared, k, skip_self, _ARROW[kind]), f"qid {of[block.ids.type]}, docid {kind}, score double")


def search(queries: DataFrame, docs: DataFrame, k: int = 100, query_key: str = "qid", key: str = "docid", vector: str = "embedding", normalise: bool = False, skip_self: bool = False) -> DataFrame:
    """(qid, docid, score, rank): the k largest inner products of each query, ties by id.

    Ids keep their type (text or whole numbers).  Blocks of query vectors are sent to the documents, which
    are never moved: each task keeps its own k best of a block, and only those are shuffled.
    """
    v = normalised(F.col(vector)) if normalise else F.col(vector).cast("array<double>")
    asked = queries.select(F.col(query_key).alias("q"), v.alias("v"))
    base = docs.select(F.col(key).alias("docid"), v.alias("embedding")).where("embedding is not null and docid is not null")
    kinds = _kind(asked, "q"), _kind(base, "docid")
    found = [search_block(base, block, k, skip_self) for block in query_blocks(asked, "q", "v")]
    if not found:
        return docs.sparkSession.createDataFrame([], f"qid {kinds[0]}, docid {kinds[1]}, score double, rank int")
    return top_k(reduce(DataFrame.unionAll, found), k, F.desc("score"), F.col("docid"))

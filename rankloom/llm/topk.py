"""Exact top-k by inner product: vectors by falling length, partial sums after an SVD rotation.

Components become integers, floor(scale * c).  All vectors are ordered by length in a range shuffle and
cut into shards, whose blocks are the rows of a table.  A shard is processed from its longest vector on, many
queries at a time.  A query leaves as soon as |q| |p| of the next vector cannot reach its k-th best score.
Of the vectors that are left, the inner product is summed in steps over dimensions rotated by the right
singular vectors of a sample (``SAMPLE`` vectors of the smallest hashes; any rotation gives the same results), and
after each step those are passed over whose sum so far plus |rest of q| |rest of p| (Cauchy-Schwarz) stays below it.
What remains is scored in exact integers.  Every query visits the shard of the longest vectors first; its
k-th best score there decides which of the next shards it goes to, a prefix of their order.

A shard has about ``SHARD_ROWS`` vectors (more where there would be over ``MAX_SHARDS``).  Of equal vectors that follow one another a
query cannot need more than the first k of the k + 1 smallest ids, so the others are not kept.  Where there are fewer shards than tasks the queries
of a shard are cut into parts, each with its copy of the shard.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those without
an id, or with a squared length of 2^62 or more after quantising, as scores might leave a long.  Zero vectors
take part.  Vectors are compared with those of their own length.  A query's own id is no candidate of it; rows that repeat an id
and vector are one query, and candidates each; ties go to the smaller id.  Empty tables and queries without candidates give no rows.
Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import blocks, even_keys, partitions, shared_table, short_batches, table
from rankloom.llm.whitening import matrix_of, vectors_of

SCALE = 1024
K_BEST = 10
SHARD_ROWS, MAX_SHARDS = 1 << 12, 1 << 20
SAMPLE = 1 << 12
#: Vectors in a row of the index, and those that are compared at once.
BLOCK, STEP = 64, 256
#: Shares of the dimensions after which a partial sum is held against its bound.
CUTS = (0.25, 0.5, 0.75)
#: Queries that are worth a copy of a shard.
PART = 64

LARGEST = 2.0**62
INDEX = "shard long, block int, top double, ids binary, vectors binary"
FOUND = "query_id long, key long, vec_id long, score long, verified long"


def quantised(c: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(c.astype(np.float64) * scale).astype(np.int64)


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Right singular vectors, those of the largest singular values first."""
    x = vectors.astype(np.float64)
    return np.linalg.svd(x, full_matrices=True)[2].T if len(x) < x.shape[1] else np.linalg.eigh(x.T @ x)[1][:, ::-1]


def kept_of_equals(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows, in order, without those that no query can need: equal vectors follow one another by id, and of them k + 1 ids and k rows of an id suffice."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    new_vector = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
    new_id = new_vector | np.concatenate([[True], ids[1:] != ids[:-1]])
    at = np.arange(len(ids))
    number = np.cumsum(new_id)
    distinct = number - number[np.maximum.accumulate(np.where(new_vector, at, 0))]
    repeat = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.flatnonzero((distinct <= k) & (repeat < k))


class Shard:
    """Vectors by falling length, with their rotation and the lengths of what is left of it after each cut."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray):
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-self.norm, kind="stable")
        self.vectors, self.ids, self.norm = vectors[order], ids[order], self.norm[order]
        self.single = self.vectors.astype(np.float64)
        self.turn, self.cuts = turn, sorted({max(1, int(len(turn) * c)) for c in CUTS})
        self.turned = self.single @ turn
        self.rest = [np.sqrt((self.turned[:, c:] ** 2).sum(1)) for c in self.cuts]

    def search(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each query its best scores and ids (``taken`` of them, best first), none below ``bound``, and the vectors scored exactly."""
        m = len(q)
        none = np.iinfo(np.int64).min
        best_s, best_i = np.full((m, k), none), np.full((m, k), np.iinfo(np.int64).max)
        least, verified = np.maximum(bound, none), np.zeros(m, dtype=np.int64)
        q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        turned = q.astype(np.float64) @ self.turn
        rest = [np.sqrt((turned[:, c:] ** 2).sum(1)) for c in self.cuts]
        slack = 1e-9 * q_norm * (self.norm[0] if len(self.norm) else 0) + 0.5  # more than rounding can be wrong by
        exact = q_norm.max(initial=0) * self.norm.max(initial=0) < 2.0**52
        single = q.astype(np.float64)
        active = np.arange(m)
        for a in range(0, len(self.ids), STEP):
            b = min(a + STEP, len(self.ids))
            active = active[q_norm[active] * self.norm[a] + slack[active] >= least[active]]
            if not len(active):
                break
            alive = np.flatnonzero(q_norm[active].max() * self.norm[a:b] + slack[active].max() >= least[active].min()) + a
            rows, partial, done = active, np.zeros((len(active), len(alive))), 0
            may = own[rows][:, None] != self.ids[alive]
            for cut, of_q, of_p in zip(self.cuts, rest, self.rest, strict=True):
                partial += turned[rows, done:cut] @ self.turned[alive, done:cut].T
                done = cut
                may &= partial + of_q[rows][:, None] * of_p[alive] >= (least[rows] - slack[rows])[:, None]
                some, left = may.any(1), may.any(0)
                if not (some.all() and left.all()):
                    rows, alive, partial, may = rows[some], alive[left], partial[some][:, left], may[some][:, left]
                if not len(rows):
                    break
            if not len(rows):
                continue
            verified[rows] += may.sum(1)
            if not exact:
                scores = q[rows] @ self.vectors[alive].T
            elif may.mean() > 0.1:
                scores = (single[rows] @ self.single[alive].T).astype(np.int64)
            else:
                scores = np.full(may.shape, none)
                x, y = np.nonzero(may)
                scores[x, y] = np.einsum("ij,ij->i", single[rows[x]], self.single[alive[y]]).astype(np.int64)
            scores = np.where(may & (scores >= least[rows][:, None]), scores, none)
            better = (scores > none).any(1)
            rows, scores = rows[better], scores[better]
            if not len(rows):
                continue
            all_s = np.concatenate([best_s[rows], scores], 1)
            all_i = np.concatenate([best_i[rows], np.where(scores > none, self.ids[alive], np.iinfo(np.int64).max)], 1)
            order = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
            least[rows] = np.maximum(least[rows], best_s[rows, k - 1])
        return best_s, best_i, (best_s > none).sum(1), verified


def _packed(size: int, scale: int, k: int, shard_rows: int):
    """Blocks of the index; rows come by falling length, each partition a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, inside = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            v, ids = quantised(matrix_of(K.string_column(batch, "v"), size), scale), K.string_column(batch, "id").to_numpy()
            kept = kept_of_equals(v, ids, k)
            v, ids, out = v[kept], ids[kept], []
            for a in range(0, len(ids), BLOCK):
                part = v[a : a + BLOCK]
                if inside >= shard_rows:
                    shard, inside = shard + 1, 0
                kind = "<i4" if np.abs(part).max() < 1 << 31 else "<i8"
                out.append((shard, inside, float(np.sqrt((part.astype(np.float64) ** 2).sum(1)).max()), ids[a : a + BLOCK].tobytes(), part.astype(kind).tobytes()))
                inside += len(part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "top", "ids", "vectors"])

    return run


def _searched(size: int, scale: int, k: int, turn: np.ndarray):
    """Queries of each shard and part after its blocks; rows come sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            place = np.stack([K.string_column(batch, c).to_numpy() for c in ("shard", "part")], 1)
            is_query = K.string_column(batch, "q").is_valid().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((place[1:] != place[:-1]).any(1) | (is_query[1:] != is_query[:-1])) + 1
            cut = [0, *change.tolist(), len(place)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if tuple(place[a].tolist()) != now:
                    now, held, shard = tuple(place[a].tolist()), [], None
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    held += zip(K.string_column(part, "ids").to_pylist(), K.string_column(part, "vectors").to_pylist(), strict=True)
                    continue
                if not held:
                    continue
                if shard is None:
                    ids = [np.frombuffer(i, dtype=np.int64) for i, _ in held]
                    vectors = [np.frombuffer(v, dtype="<i4" if len(v) == 4 * size * len(i) else "<i8").reshape(-1, size).astype(np.int64) for i, (_, v) in zip(ids, held, strict=True)]
                    shard, held = Shard(np.concatenate(vectors), np.concatenate(ids), turn), [()]
                q, own, key = quantised(matrix_of(K.string_column(part, "q"), size), scale), K.string_column(part, "query_id").to_numpy(), K.string_column(part, "key").to_numpy()
                bound = K.string_column(part, "bound").fill_null(np.iinfo(np.int64).min).to_numpy()
                for lo in range(0, len(q), 1024):
                    at = slice(lo, lo + 1024)
                    s, i, taken, verified = shard.search(q[at], own[at], bound[at], k)
                    here = np.arange(k) < taken[:, None]
                    row = np.nonzero(here)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(own[at][row]), pa.array(key[at][row]), pa.array(i[here]), pa.array(s[here]), pa.array(np.zeros(len(row), dtype=np.int64))], names=["query_id", "key", "vec_id", "score", "verified"])
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(key[at]), pa.nulls(len(own[at]), pa.int64()), pa.nulls(len(own[at]), pa.int64()), pa.array(verified)], names=["query_id", "key", "vec_id", "score", "verified"])

    return run


def _routed(shared, size: int, scale: int):
    """Queries with the shards, a prefix of their order, whose longest vector may reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, tops = shared.value
        for batch in batches:
            q = quantised(matrix_of(K.string_column(batch, "q"), size), scale).astype(np.float64)
            reach = []
            for length, bound in zip(np.sqrt((q * q).sum(1)).tolist(), K.string_column(batch, "bound").to_pylist(), strict=True):
                everything = bound is None or bound <= 0
                reach.append(shards if everything else shards[length * tops * (1 + 1e-9) + 0.5 >= bound])
            names = ["query_id", "key", "q", "bound"]
            yield pa.RecordBatch.from_arrays([*(K.string_column(batch, n) for n in names), pa.array(reach, pa.list_(pa.int64()))], names=[*names, "shards"])

    return run


class Index:
    """Blocks of all shards, as a table; ``tops`` are the shards with the length of their longest vector, longest first."""

    def __init__(self, blocks_: DataFrame, tops: list[tuple[int, float]], turn: np.ndarray, size: int, scale: int, k: int):
        self.blocks, self.tops, self.turn, self.size, self.scale, self.k = blocks_, tops, turn, size, scale, k


def measured(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows with ``square``, the squared length after quantising, where it is below 2^62."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double"))
    small = F.forall("v", lambda x: F.abs(x.cast("double") * scale) < 2.0**31)
    return rows.where(small).withColumn("square", square).where(F.col("square") < LARGEST)


def build_index(rows: DataFrame, size: int, n: int, scale: int = SCALE, k: int = K_BEST) -> Index | None:
    """The index of those of ``rows`` (id, v) that have ``size`` components, about ``n``, for up to ``k`` results a query."""
    spark = rows.sparkSession
    rows = measured(rows.where(F.size("v") == size), scale)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return None
    shard_rows = max(SHARD_ROWS, blocks(n, MAX_SHARDS))
    order = [F.desc("square"), F.xxhash64("v"), F.col("id"), F.col("at")]  # equal vectors follow one another, over as many tasks as they need
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(min(partitions(spark), blocks(n, shard_rows)), *order).sortWithinPartitions(*order)
    index = shared_table(ranged.select("id", "v").mapInArrow(_packed(size, scale, k, shard_rows), INDEX), "norms")
    tops = index.groupBy("shard").agg(F.max("top").alias("top")).orderBy(F.desc("top"), "shard").collect()  # at most MAX_SHARDS and a few for each task
    return Index(index, [(r["shard"], r["top"]) for r in tops], rotation(quantised(np.array(sample, dtype=np.float64), scale)), size, scale, k)


def _visit(index: Index, asked: DataFrame, shards: DataFrame, n_shards: int, n_queries: int) -> DataFrame:
    """What shards hold for the queries ``asked`` (query_id, key, q, bound, shard)."""
    spark = asked.sparkSession
    n = partitions(spark)
    parts = max(1, min(blocks(n, n_shards), blocks(n_queries, PART)))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    copies = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = copies.unionByName(asked.withColumn("part", part), allowMissingColumns=True)
    # shards are dealt to tasks in turn, by their number within all ranges
    turn = F.pmod(F.shiftright("shard", 32) + F.col("shard").bitwiseAND(F.lit((1 << 32) - 1)) + F.col("part") * n_shards, F.lit(n))
    to = F.element_at(F.array(*map(F.lit, even_keys(spark, n))), (turn + 1).cast("int"))
    both = both.withColumn("_to", to).repartition(n, "_to").drop("_to").sortWithinPartitions("shard", "part", F.col("q").isNotNull(), "block", "key")
    return both.mapInArrow(_searched(index.size, index.scale, index.k, index.turn), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """All that the shards return for ``queries`` (id, v): query_id, key (of its vector), vec_id, score; rows without vec_id tell the vectors scored exactly."""
    spark = queries.sparkSession
    asked = measured(queries.where(F.size("v") == index.size), index.scale).dropDuplicates(["id", "v"]).select(F.col("id").alias("query_id"), F.xxhash64("id", "v").alias("key"), F.col("v").alias("q"))
    asked = shared_table(asked, "queries")
    n = asked.count()
    first = index.tops[0][0]
    nothing = F.lit(None).cast("long")
    near = shared_table(_visit(index, asked.select("*", nothing.alias("bound"), F.lit(first).alias("shard")), index.blocks.where(F.col("shard") == first), 1, n), "longest")
    if len(index.tops) == 1:
        return near
    bound = _best(near, index.k).where(F.col("rank") == index.k).select("query_id", "key", F.col("score").alias("bound"))
    shared = spark.sparkContext.broadcast((np.array([s for s, _ in index.tops[1:]], dtype=np.int64), np.array([t for _, t in index.tops[1:]])))
    routed = asked.join(bound, ["query_id", "key"], "left").select("query_id", "key", "q", "bound")
    schema = f"query_id long, key long, q {asked.schema['q'].dataType.simpleString()}, bound long, shards array<long>"
    routed = routed.mapInArrow(_routed(shared, index.size, index.scale), schema).withColumn("shard", F.explode("shards"))
    rest = _visit(index, routed.select("query_id", "key", "q", "bound", "shard"), index.blocks.where(F.col("shard") != first), len(index.tops) - 1, n)
    return near.unionByName(rest)


def largest(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K_BEST, scale: int = SCALE) -> DataFrame:
    """For each row of ``queries`` its k largest inner products among ``vectors``: query_id, rank, vec_id and score."""
    spark = vectors.sparkSession
    short_batches(spark)
    rows, asked = (vectors_of(df, key, vector).where("id is not null") for df in (vectors, queries))
    found = []
    for size, n in sorted(tuple(r) for r in rows.groupBy(F.size("v")).count().collect()):  # one pass for each length; tables have one
        index = build_index(rows, size, n, scale, k)
        if index is not None:
            found.append(_best(search(index, asked), k).select("query_id", "rank", "vec_id", "score"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return largest(vectors.where(F.col("vec_id") % 100 == 0), vectors)

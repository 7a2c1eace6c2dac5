"""BM25 top-k over impact-ordered postings: blocks with maxima, read only as far as a new document may still enter.

The weight of a word in a document (its impact) is known when the index is built.  Documents are dealt into
shards by hash, so the postings of a common word are cut over all tasks.  Within a shard a word's postings are ordered by falling impact
and cut into blocks of ``BLOCK``; a block's first impact is its maximum.  A shard and the queries that ask it meet in
one task, the queries a batch at a time.  For each query the kernel reads, block by block, the list whose next block
can add most.  Documents met there are scored whole, by look-up in the other lists, unless what they have and the maxima
of the other lists stay below the k-th best.  It stops when the sum of the next blocks' maxima stays below it too.
Lists of common words, whose impacts are small, are thus looked up for few documents and hardly read at all; no pairs of
queries and documents that merely share a word are listed.  Rows without an id take no part; rows that repeat an id are one
document, whose scores add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import sparse
from rankloom.operators.ranking import top_k

BLOCK = 128
#: Documents of a shard, and the least that are worth a shard of their own.
SHARD_DOCS, LEAST_DOCS = 1 << 14, 1 << 10
#: Words of all queries that are broadcast at most; more are joined, with common words' postings cut by document.
BROADCAST_TERMS, SALT = 1 << 18, 16
#: Postings of a word, on average, up to which all are simply added up: a look-up in all lists costs about as much.
PLAIN = 256
#: Scores that differ by less are ties to the rounding that orders results.
SLACK = 1e-8

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def shards_for(n: int, tasks: int) -> int:
    return max(1, -(-n // SHARD_DOCS), min(tasks, n // LEAST_DOCS))


def weighted(postings: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings with their word's idf."""
    if n_terms <= BROADCAST_TERMS:
        return postings.join(F.broadcast(terms), "term")
    salted = postings.withColumn("_salt", F.pmod(F.xxhash64("docid"), F.lit(SALT)))
    return salted.join(terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>"))), ["term", "_salt"]).drop("_salt")


def build(docs: DataFrame, key: str = "docid", text: str = "text", wanted: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(blocks: shard, term, block, docs, impacts; number of shards) for all words, or for those of ``wanted`` (term)."""
    spark = docs.sparkSession
    own = sparse.tokenised(docs.where(F.col(key).isNotNull()), key, text)
    n, avgdl, floor = sparse.statistics(own)
    shards = shards_for(n, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = own.select("docid", F.size("w").alias("len"), F.explode("w").alias("term"))
    terms = sparse.document_frequencies(own).select("term", sparse.idf(n, floor).alias("idf"))
    if wanted is not None:
        n_terms = wanted.count()
        small = F.broadcast(wanted) if n_terms <= BROADCAST_TERMS else wanted
        rows, terms = rows.join(small, "term", "left_semi"), terms.join(small, "term", "left_semi")
    else:
        n_terms = terms.count()
    tf = rows.groupBy("docid", "term", "len").agg(F.count("*").alias("tf"))
    norm = F.col("tf") + sparse.K1 * (1 - sparse.B + sparse.B * F.col("len") / F.lit(avgdl))
    impact = (F.col("idf") * F.col("tf") * (sparse.K1 + 1) / norm).alias("impact")
    placed = weighted(tf, terms, n_terms).select("term", "docid", impact, F.pmod(F.xxhash64("docid"), F.lit(shards)).cast("int").alias("shard"))
    order = Window.partitionBy("shard", "term").orderBy(F.desc("impact"), "docid")
    cut = placed.withColumn("place", F.row_number().over(order)).withColumn("block", F.expr(f"(place - 1) div {BLOCK}").cast("int"))
    held = cut.groupBy("shard", "term", "block").agg(F.array_sort(F.collect_list(F.struct("place", "docid", "impact"))).alias("p"))
    return held.select("shard", "term", "block", F.col("p.docid").alias("docs"), F.col("p.impact").alias("impacts")), shards


class Shard:
    """A shard's lists by word: documents (numbered) and impacts, by falling impact; and all postings by word and document, for look-ups in many lists at once."""

    def __init__(self, lists: dict[str, tuple[np.ndarray, np.ndarray]]):
        every = [d for d, _ in lists.values()]
        self.docs, number = np.unique(np.concatenate(every), return_inverse=True)
        self.lists, at, keys, weights = {}, 0, [], []
        for n, (term, (d, w)) in enumerate(lists.items()):
            own = number[at : at + len(d)]
            at += len(d)
            by_doc = np.argsort(own)
            if (own[by_doc][1:] == own[by_doc][:-1]).any():  # rows that repeat an id add up
                own, place = np.unique(own, return_inverse=True)
                w = np.bincount(place, weights=w)
                order = np.lexsort((own, -w))
                own, w = own[order], w[order]
                by_doc = np.argsort(own)
            self.lists[term] = (n, own, w)
            keys.append(n * len(self.docs) + own[by_doc])
            weights.append(w[by_doc])
        self.keys, self.weights = np.concatenate(keys), np.concatenate(weights)

    def _whole(self, held: list[tuple], d: np.ndarray) -> np.ndarray:
        """Scores of documents, summed in the order of the words: a document's sum is always the same."""
        asked = (np.array([n for n, *_ in held])[:, None] * len(self.docs) + d).ravel()
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        found = np.where(self.keys[at] == asked, self.weights[at], 0.0).reshape(len(held), len(d))
        score = np.zeros(len(d))
        for row, (*_, m) in zip(found, held, strict=True):
            score += row * m
        return score

    def search(self, terms: list[str], times: list[float], k: int, plain: int = PLAIN) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[int, int, int]]]:
        """(documents, scores) that may be among the k best, and for each word its postings, those read in order and those looked up."""
        names = [t for t in terms if t in self.lists]
        held = [(*self.lists[t], m) for t, m in zip(terms, times, strict=True) if t in self.lists]
        if sum(len(d) for _, d, _, _ in held) <= plain * len(held):  # fewer than look-ups cost
            score = np.zeros(len(self.docs))
            met = np.zeros(len(self.docs), dtype=bool)
            for _, d, w, m in held:
                score[d] += w * m
                met[d] = True
            best = np.flatnonzero(met)
            if len(best) > k:
                best = best[score[best] >= np.partition(score[best], len(best) - k)[len(best) - k] - SLACK]
            return self.docs[best], score[best], {t: (len(h[1]), len(h[1]), 0) for t, h in zip(names, held, strict=True)}
        at, read, looked = [0] * len(held), [0] * len(held), 0
        top = lambda i: max(0.0, held[i][2][at[i]] * held[i][3]) if at[i] < len(held[i][1]) else 0.0
        next_ = np.array([top(i) for i in range(len(held))])
        left = np.array([len(h[1]) for h in held])
        seen = np.zeros(len(self.docs), dtype=bool)
        best_d, best_s, least = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
        own = [0] * len(held)
        step = [BLOCK] * len(held)
        while (left > 0).any() and not (len(best_s) >= k and next_.sum() < least - SLACK):
            i = int(np.lexsort((left, np.where(left > 0, -next_, np.inf)))[0])
            _, docs, impacts, m = held[i]
            some = slice(at[i], at[i] + step[i])
            d, w = docs[some], impacts[some] * m
            at[i], step[i] = at[i] + len(d), step[i] * 2
            read[i] += len(d)
            left[i] -= len(d)
            others = next_.sum() - next_[i]
            next_[i] = top(i)
            new = ~seen[d]
            seen[d] = True
            d = d[new & (w + others >= least - SLACK)]
            if not len(d):
                continue
            looked += len(d)
            own[i] += len(d)
            best_d, best_s = np.concatenate([best_d, d]), np.concatenate([best_s, self._whole(held, d)])
            if len(best_s) > k:
                least = np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                keep = best_s >= least - SLACK
                best_d, best_s = best_d[keep], best_s[keep]
            elif len(best_s) == k:
                least = best_s.min()
        return self.docs[best_d], best_s, {t: (len(h[1]), read[j], looked - own[j]) for j, (t, h) in enumerate(zip(names, held, strict=True))}


def _plain(values: pa.Array) -> np.ndarray:
    """Ids as numpy sorts them."""
    return np.array(values.to_pylist(), dtype=object) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else values.to_numpy(zero_copy_only=False)


def _searched(k: int, types: tuple[pa.DataType, pa.DataType], counted: bool, plain: int):
    """Queries of each shard after its blocks; rows come sorted so."""

    def results(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for qid, terms, times in zip(*(batch.column(c).to_pylist() for c in ("qid", "terms", "times")), strict=True):
            docs, scores, told = shard.search(terms, times, k, plain)
            if counted:
                out += [(qid, None, None, t, *n) for t, n in told.items()]
            else:
                out += [(qid, d, s, None, None, None, None) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (types[0], types[1], pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["qid", "docid", "score", "term", "held", "read", "looked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, {}, None
        for batch in batches:
            place, asks = batch.column("shard").to_numpy(), batch.column("terms").is_valid().to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(place)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if place[a] != now:
                    now, held, shard = place[a], {}, None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    for term, d, w in zip(part.column("term").to_pylist(), part.column("docs"), part.column("impacts"), strict=True):
                        held.setdefault(term, []).append((_plain(d.values), w.values.to_numpy(zero_copy_only=False)))
                elif held or shard:
                    if shard is None:
                        shard, held = Shard({t: tuple(np.concatenate(x) for x in zip(*own, strict=True)) for t, own in held.items()}), {}
                    yield results(shard, part)

    return run


def _asked(blocks: DataFrame, shards: int, queries: DataFrame, k: int, query_key: str, query_text: str, counted: bool) -> DataFrame:
    kinds = (queries.schema[query_key].dataType.simpleString(), blocks.schema["docs"].dataType.elementType.simpleString())
    if not set(kinds) <= set(_ARROW):
        raise TypeError(f"ids of types {kinds} are not searched")
    own = sparse.tokens(queries, query_key, query_text).withColumnRenamed("docid", "qid").groupBy("qid", "term").agg(F.count("*").cast("double").alias("times"))
    own = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("t")).select("qid", F.col("t.term").alias("terms"), F.col("t.times").alias("times"))
    own = own.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    n = max(1, min(shards, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    both = blocks.unionByName(own, allowMissingColumns=True).repartition(n, "shard")
    both = both.sortWithinPartitions("shard", F.col("terms").isNotNull(), "term", "block")
    return both.mapInArrow(_searched(k, (_ARROW[kinds[0]], _ARROW[kinds[1]]), counted, PLAIN), f"qid {kinds[0]}, docid {kinds[1]}, score double, term string, held long, read long, looked long")


def search_blocks(blocks: DataFrame, shards: int, queries: DataFrame, k: int = 100, query_key: str = "qid", query_text: str = "query") -> DataFrame:
    """(qid, docid, score, rank) from an index; ties (to 9 decimals) by id."""
    found = _asked(blocks, shards, queries, k, query_key, query_text, False).select("qid", "docid", "score")
    return top_k(found, k, F.desc(F.round("score", 9)), F.col("docid"))


def postings_read(blocks: DataFrame, shards: int, queries: DataFrame, k: int = 100, query_key: str = "qid", query_text: str = "query") -> DataFrame:
    """(term, queries, held, read, looked): postings of a word over all searches that ask for it, those read in order and those looked up."""
    found = _asked(blocks, shards, queries, k, query_key, query_text, True)
    return found.groupBy("term").agg(F.count_distinct("qid").alias("queries"), *(F.sum(c).alias(c) for c in ("held", "read", "looked")))


def search(queries: DataFrame, docs: DataFrame, k: int = 100, negated: bool = False, query_key: str = "qid", query_text: str = "query", key: str = "docid", text: str = "text") -> DataFrame:
    """The k best documents of each query; ``negated`` stores -score, as some run files do."""
    wanted = sparse.tokens(queries, query_key, query_text).select("term").distinct()
    blocks, shards = build(docs, key, text, wanted)
    ranked = search_blocks(blocks, shards, queries, k, query_key, query_text)
    return ranked.withColumn("score", -F.col("score")) if negated else ranked

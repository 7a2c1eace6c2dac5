"""Benchmark decontamination with suffix arrays of the training text.

Every task turns its documents into shards of word ids, builds a suffix array of each shard over
those positions where a benchmark window could start (all words from there on, for a window's
length, are benchmark words), and binary-searches every benchmark suffix in it.  The ranges found
give all verbatim occurrences with their places; they are extended to their longest match.  Where the
shard has fewer suffixes than the benchmark, the search goes the other way, with the same result.

Benchmark items are read in blocks of bounded size: four bytes for each word, a hash for each different
one, and the order of their windows.  One block is broadcast; further blocks are searched in turn, one
in memory at a time, and what they find is written and merged by text, so nothing is capped.  Texts are
never shuffled while the benchmark fits one block.

Defined results: null or wordless texts have no words and no hits; an item without words has no
window; an item shorter than the window is one window.  Repeated documents are judged each; rows
that repeat an item's id are one item.  Items of null id are one item, null in ``items`` (last), which the query counts and
does not list.  An empty table gives an empty result, an empty benchmark no hits.  Columns of the
documents are kept; clashing names are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import blocks, protected, shared_table, short_batches, table

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 8 << 20

FOUND = "n_words long, n_hit long, longest long, items array<long>, spans array<struct<start:long,stop:long>>"


def _ranks(words: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Ranks of the runs of 1, 2, 4 ... words from each place on, up to ``size``; the order is that of the words."""
    out, step = {1: words}, 1
    while 2 * step <= size:
        follow = np.zeros_like(out[step])
        follow[:-step] = out[step][step:]
        pair = out[step].astype(np.int64) * (int(follow.max(initial=0)) + 1) + follow
        out[2 * step] = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        step *= 2
    return out


class Windows:
    """The windows of a block of benchmark items, by length, as places in the items' words."""

    def __init__(self, ids: list[int | None], texts: pa.Array | pa.ChunkedArray | list[str | None], window: int = WINDOW):
        data, off = K.text_buffer(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        parts = []
        for lo, hi in K.chunks(off):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            s, e, first = K.words(part, o, K.ALNUM)
            parts.append((K.hashes(part, s, e), np.diff(first)))
        h = np.concatenate([np.zeros(0, dtype=np.uint64), *(x for x, _ in parts)])
        n = np.concatenate([np.zeros(0, dtype=np.int64), *(x for _, x in parts)])
        self.vocab, word = np.unique(h, return_inverse=True)
        self.words = word.astype(np.int32) + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        null = np.array([i is None for i in ids], dtype=bool)
        known, place = np.unique(np.array([i for i in ids if i is not None], dtype=np.int64), return_inverse=True)
        self.ids = [*known.tolist(), None]  # the null id comes last
        self.items = np.full(len(ids), len(known), dtype=np.int64)
        self.items[~null] = place
        del h, word, parts
        self.tests: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, a place of each window in their order, (window, item) pairs
        lengths = np.minimum(n, window)
        ranks = _ranks(self.words, window)
        for size in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == size)
            runs = n[own] - size + 1
            at = np.repeat(self.first[own], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            half = ranks[1 << (size.bit_length() - 1)]  # two runs that cover the window
            key = half[at].astype(np.int64) * (int(half.max()) + 1) + half[at + size - (1 << (size.bit_length() - 1))]
            _, place, inverse = np.unique(key, return_index=True, return_inverse=True)
            pairs = np.unique(inverse.astype(np.int64) * len(n) + np.repeat(own, runs))
            self.tests.append((size, at[place].astype(np.int32), np.stack([pairs // len(n), pairs % len(n)], 1).astype(np.int32)))
        self.least = min((t[0] for t in self.tests), default=0)

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """Dense ids of word hashes, 0 for words that no item has."""
        if not len(self.vocab) or not len(h):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)


def suffix_array(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places ``at`` in the order of the suffixes that start there; a 0 ends a suffix."""
    n = len(words)
    live = words > 0
    # ranks are dense from the start, so that equal numbers of classes mean that none was split
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[:-1][live] = np.unique(words[live], return_inverse=True)[1] + 1
    step = 1
    while step < n:
        follow = np.where(np.arange(n) + step < n, rank[np.minimum(np.arange(n) + step, n)], 0)
        pair = rank[:-1] * (rank.max() + 1) + follow
        _, new = np.unique(pair[live], return_inverse=True)
        new_rank = np.zeros(n + 1, dtype=np.int64)
        new_rank[:-1][live] = new + 1
        if new_rank.max() == rank.max():
            break
        rank, step = new_rank, step * 2
    return at[np.argsort(rank[at], kind="stable")]


#: Runs that are compared with one another at a time.
AT_ONCE = 1 << 16


def bounds(words: np.ndarray, array: np.ndarray, tests: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: for each run of ``size`` words of ``tests`` from ``places`` on, the range of ``array`` whose runs equal it.

    ``array`` holds places in ``words`` in the order of the runs that begin there.
    """
    words, tests = (np.concatenate([x, np.zeros(size, dtype=x.dtype)]) for x in (words, tests))
    out = np.zeros((2, len(places)), dtype=np.int64)
    for begin in range(0, len(places), AT_ONCE):
        wanted = tests[places[begin : begin + AT_ONCE, None] + np.arange(size)]
        row = np.arange(len(wanted))
        for upper in (0, 1):
            lo, hi = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(array), dtype=np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                there = words[array[np.minimum(mid, len(array) - 1)][:, None] + np.arange(size)]
                differ = there != wanted
                k = differ.argmax(1)
                right = there[row, k] < wanted[row, k]
                if upper:
                    right |= ~differ.any(1)
                lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            out[upper, begin : begin + len(wanted)] = lo
    return out[0], out[1]


def occurrences(words: np.ndarray, array: np.ndarray, windows: Windows, size: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, window) of every occurrence; the shorter side is searched in the longer one."""
    if len(places) <= len(array):
        lo, hi = bounds(words, array, windows.words, places, size)
        times = hi - lo
        return array[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)], np.repeat(np.arange(len(places)), times)
    lo, hi = bounds(windows.words, places, words, array, size)
    return array[hi > lo], lo[hi > lo]


def search(data: np.ndarray, off: np.ndarray, windows: Windows) -> dict[str, list]:
    """All occurrences of the windows in the documents of one shard."""
    parts = [(lo, *_chunk_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], windows)) for lo, hi in K.chunks(off)]
    n_docs = len(off) - 1
    n_words = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, dtype=np.int64)
    found = {"n_words": n_words, "n_hit": np.zeros(n_docs, dtype=np.int64), "longest": np.zeros(n_docs, dtype=np.int64), "items": [[] for _ in range(n_docs)], "spans": [[] for _ in range(n_docs)]}
    if not windows.tests or not n_words.sum():
        return found
    # keep only the runs of benchmark words that are long enough, with a 0 after each
    words, place, doc = [], [], []
    for base, ids, n in parts:
        first = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(n)), n)
        known = ids > 0
        cut = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        edge = np.union1d(cut, first)
        lo, hi = edge[:-1], edge[1:]
        fit = (hi - lo >= windows.least) & known[np.minimum(lo, len(ids) - 1)] if len(ids) else np.zeros(0, dtype=bool)
        lo, hi = lo[fit], hi[fit]
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange((size + 1).sum()) if len(lo) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(size + 1) - 1
        at[ends] = hi - 1 if len(hi) else at[ends]
        w = ids[at]
        w[ends] = 0
        words.append(w), place.append(at - first[owner[at]] if len(at) else at), doc.append(owner[at] + base if len(at) else at)
    words, place, doc = np.concatenate(words).astype(np.int32), np.concatenate(place), np.concatenate(doc)
    if not len(words):
        return found
    gap = np.flatnonzero(words == 0)
    left = gap[np.searchsorted(gap, np.arange(len(words)))] - np.arange(len(words))  # words of the run from here on
    array = suffix_array(words, np.flatnonzero(left >= windows.least))
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    pairs = []
    for size, source, of in windows.tests:
        at, which = occurrences(words, array, windows, size, source)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
        _longest(words, doc, at, source[which], size, windows, found["longest"])
        met = np.unique(np.stack([doc[at], which], 1), axis=0)
        begin, end = np.searchsorted(of[:, 0], met[:, 1]), np.searchsorted(of[:, 0], met[:, 1], side="right")
        count = end - begin
        item = of[np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), 1]
        pairs.append(np.unique(np.stack([np.repeat(met[:, 0], count), item], 1), axis=0))
    hit = np.cumsum(hit[:-1]) > 0
    np.add.at(found["n_hit"], doc[hit], 1)
    begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    stop = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
    for d, a, b in zip(doc[begin].tolist(), place[begin].tolist(), place[stop].tolist(), strict=True):
        found["spans"][d].append({"start": a, "stop": b + 1})
    met = np.concatenate(pairs)  # rows that repeat an id are one item, as they are over several blocks
    for d, item in np.unique(np.stack([met[:, 0], windows.items[met[:, 1]]], 1), axis=0).tolist():
        found["items"][d].append(windows.ids[item])
    return found


def _chunk_words(data: np.ndarray, off: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = K.words(data, off, K.ALNUM)
    return windows.word_ids(K.hashes(data, s, e)), np.diff(first)


def _longest(words, doc, at, source, size, windows: Windows, longest: np.ndarray) -> None:
    """Extend each occurrence word by word while the item goes on as the document does."""
    stop = windows.first[np.searchsorted(windows.first, source, side="right")]
    n, live = np.full(len(at), size, dtype=np.int64), np.arange(len(at))
    while len(live):
        a, b = at[live] + n[live], source[live] + n[live]
        live = live[(b < stop[live]) & (words[np.minimum(a, len(words) - 1)] == windows.words[np.minimum(b, len(windows.words) - 1)])]
        n[live] += 1
    np.maximum.at(longest, doc[at], n)


def _searcher(block, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            for lo, hi in K.chunks(off, SHARD_BYTES):
                found = search(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], windows)
                part = batch.slice(lo, hi - lo)
                kept = [K.string_column(part, n) for n in names]
                columns = [pa.array(found[k], t) for k, t in (("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, "n_words", "n_hit", "longest", "items", "spans"])

    return run


def find_matches(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, longest (words of the longest verbatim match), items and spans (word ranges hit)."""
    spark = docs.sparkSession
    short_batches(spark)
    own = {x.split(" ")[0] for x in ("n_words", "n_hit", "longest", "items", "spans")}
    docs = docs.drop(*own)
    bench = bench.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    n = blocks(bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], block_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if n == 1:
        return docs.mapInArrow(_searcher(spark.sparkContext.broadcast(_windows(bench, window)), text, docs.columns), f"{schema}, {FOUND}")
    # the findings of each block by text, written before the next block is read
    slim = docs.select(F.sha2(text, 256).alias("_row"), text)
    parts = []
    for k in range(n):
        block = spark.sparkContext.broadcast(_windows(bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k), window))
        found = slim.mapInArrow(_searcher(block, text, ["_row"]), f"_row string, {FOUND}").where("n_hit > 0")
        parts.append(shared_table(found.select("_row", "longest", "items", "spans").dropDuplicates(["_row"]), "found"))
        block.destroy()
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    merged = union.groupBy("_row").agg(F.max("longest").alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"))
    # spans of several blocks may overlap: join them from left to right
    joined = F.aggregate("_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(s))))
    merged = merged.withColumn("spans", joined).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"]))
    counted = docs.mapInArrow(_counter(text, docs.columns), f"{schema}, n_words long").withColumn("_row", F.sha2(text, 256))
    none = {"n_hit": F.lit(0).cast("long"), "longest": F.lit(0).cast("long"), "items": F.array().cast("array<long>"), "spans": F.array().cast("array<struct<start:bigint,stop:bigint>>")}
    return counted.join(merged, "_row", "left").select(*docs.columns, "n_words", *(F.coalesce(c, empty).alias(c) for c, empty in none.items()))


def _windows(bench: DataFrame, window: int) -> Windows:
    """Of one block of bounded size."""
    rows = bench.toArrow()
    return Windows(rows.column("item").to_pylist(), rows.column("text"), window)


def _counter(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            n = [np.diff(K.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.ALNUM)[2]) for lo, hi in K.chunks(off)]
            yield pa.RecordBatch.from_arrays([*(K.string_column(batch, c) for c in names), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *n]), pa.int64())], names=[*names, "n_words"])

    return run


def remove_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    return protected(docs, (text,), lambda d: find_matches(d, bench, text, **how).where("n_hit = 0"))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

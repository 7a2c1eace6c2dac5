"""N-gram Jaccard join: a size-aware join of light (small) and heavy (large) sets.

Two documents link when ``100 * |A and B| >= threshold * |A or B|`` over their distinct word
shingles.  Equal sets are one class from the start, named by a hash of the set.

* Light sets enumerate their subsets of every size that a link could share: with at most k(n)
  elements missing, the (n - j)-subsets for j = 0..k(n).  Linked sets share one.
* Heavy sets are posted in inverted lists under their prefix, the n - ceil(t n) + 1 first elements
  of a global order; linked sets share one.  Elements known to be frequent come last in that order,
  so a passage that many documents share fills no long list.  A pair is skipped where sizes, or the
  places of the shared element, rule a link out.
* The boundary is the largest size for which enumerating subsets costs less than scanning lists.
  Light sets close enough to it are posted in the lists too, for their heavy partners.

Short lists give their possible pairs at once.  Long lists are scanned twice.  First every set is
verified against the one set it meets most often among the heads of its lists (the member with the
fewest rarer elements), which links most of a group of near copies in one star.  Then all pairs of a
long list whose sets are not in one component yet are verified.  Pairs within a component need no
check, so no link between components is lost and large groups do not expand into all their pairs.  A
list whose members are all in one component goes at once; of the others, members are dealt to blocks of
about ``BLOCK``, and each pair of blocks that differ in their components is a group of its own, so one
list is spread over many tasks.  Keys of shingles that very many documents hold (``SPLIT``) are listed
by aggregates and joins in place of buckets that one task holds.
Before sets are fetched, a bitmap of each (a bit for each element, of one byte for 8 elements) rules
out pairs whose bitmaps differ in more places than the sets may.  Verification then counts the exact
intersection.

Defined results: null, empty and wordless texts have an empty set and link with nothing (component:
their own id); fewer words than the shingle make one shingle; repeated rows are one class; a null id
keeps its row and takes part in links.  An empty table gives an empty result.  Columns not named are
not read.  Shingles and sets are told apart by 64-bit hashes (for a set, together with its size).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import columns, least_count, partitions, release, shared_table, short_batches, table, tables_made
from rankloom.llm.components import components

#: Frequent shingles that are told to every task, at most; others keep their place in the order.
HOT_SHINGLES = 1 << 20
HOT_LEAST = 3
#: A task packs the shingles of so many bytes of text at a time.
COUNT_BYTES = 16 << 20
#: Sets whose ids are broadcast for verification, at most; beyond, they are joined.
BROADCAST_SETS = 4_000_000
#: Pairs that are broadcast to the sets, at most.
BROADCAST_PAIRS = 1_000_000
#: Members of a list whose pairs are compared at once.
SHORT = 16
#: Members of a long list that are compared with others of a block; documents of a shingle whose list is never held by one task.
BLOCK, SPLIT = 128, 1 << 16
SALTS = 16
MANY = np.dtype([("h", "u1", 3), ("n", "<u4")])
POSTING = np.dtype([("key", "<u8"), ("owner", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def needed(n, m, threshold: int):
    """The least intersection of sets of sizes n and m that link."""
    return -(-(threshold * (n + m)) // (100 + threshold))


def spare(n: int, threshold: int) -> int:
    """Elements of a set of size n that a partner may lack at most."""
    return n - -(-threshold * n // 100)


def boundary(list_length: float, threshold: int, most: int = 64) -> int:
    """The largest size whose subsets cost no more than scanning its lists of ``list_length`` postings."""
    light = 0
    for n in range(1, most):
        k = spare(n, threshold)
        if sum(comb(n, j) for j in range(k + 1)) > (k + 1) * (1 + list_length):
            break
        light = n
    return light


class Sets:
    """Shingle sets of the documents of a buffer: sorted distinct hashes and the first of each document."""

    def __init__(self, data: np.ndarray, off: np.ndarray, k: int):
        s, e, first = K.words(data, off, K.NOT_BLANK)
        h, at = K.shingles(K.hashes(data, s, e), first, k)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
        h, doc = h[order], doc[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[keep], doc[keep]
        self.first = np.searchsorted(self.doc, np.arange(len(off)))
        self.n = np.diff(self.first)

    def names(self) -> np.ndarray:
        """A 64-bit name of each set."""
        weak = K.sums(K.mix(self.h ^ np.uint64(0x5851F42D4C957F2D)), self.first)
        other = K.sums(self.h * np.uint64(0x2545F4914F6CDD1D), self.first)
        return K.mix(weak ^ K.mix(other + self.n.astype(np.uint64))).view(np.int64)


def hash_bits(spark: SparkSession) -> int:
    """Leading bits of a shingle's hash that name its bucket: as many buckets as the session's partitions ask for, 256 at least."""
    return min(20, max(8, (2 * partitions(spark) - 1).bit_length()))


def _hashed(k: int, text: str, bits: int):
    """The upper 32 bits of all shingle hashes, of each document once, by bucket; those that repeat with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report():
            h, n = np.unique((np.concatenate(held) >> np.uint64(32)).astype("<u4"), return_counts=True)
            bucket = h >> np.uint32(32 - bits)
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            rest = np.ascontiguousarray((h & np.uint32((1 << (32 - bits)) - 1)).view(np.uint8).reshape(-1, 4)[:, :3])
            once, many = n == 1, np.zeros(int((n > 1).sum()), dtype=MANY)
            many["h"], many["n"] = rest[n > 1], n[n > 1]
            at = np.append(begin, len(h))
            columns = [pa.array(bucket[begin].astype(np.int32))]
            for rows, chosen in ((rest[once], once), (many, ~once)):
                cut = np.concatenate([[0], np.cumsum(chosen)])[at]
                columns.append(pa.array([rows[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "rows", "many"])

        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            for lo, hi in K.chunks(off):
                held.append(Sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k).h)
                size += off[hi] - off[lo]
                if size >= COUNT_BYTES:
                    yield from report()
                    held, size = [], 0
        if held:
            yield from report()

    return run


def _frequent(bits: int):
    """Counts of those that occur ``HOT_LEAST`` times or more (kind 0); the sum of all counts (1) and of their squares (2)."""

    def wide(h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(h), 4), dtype=np.uint8)
        out[:, :3] = h
        return out.view("<u4").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _buckets(batches, "rows", "many"):
            once = np.frombuffer(b"".join(x for x, _ in blobs), dtype=np.uint8).reshape(-1, 3)
            many = np.frombuffer(b"".join(x for _, x in blobs), dtype=MANY)
            h, n = np.unique(wide(once), return_counts=True)
            h, n = np.concatenate([h, wide(many["h"])]), np.concatenate([n, many["n"].astype(np.int64)])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            h, n = h[begin], np.add.reduceat(n, begin) if len(begin) else n
            more = n >= HOT_LEAST
            rows = [(0, (bucket << (32 - bits)) + int(x), int(c)) for x, c in zip(h[more], n[more], strict=True)]
            rows += [(1, 0, int(n.sum())), (2, 0, int((n.astype(np.int64) ** 2).sum()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["kind", "h", "n"])

    return run


class Order:
    """The global order of shingles: by hash, but those known to be frequent last, by count.

    ``hashes`` are the upper 32 bits.  Should two shingles share them, their order is still one order.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order].astype(np.uint32)
        self.counts = counts[order].astype(np.int64)
        self.rank = np.empty(len(hashes), dtype=np.int32)
        self.rank[np.lexsort((self.hashes, counts[order]))] = np.arange(len(hashes))
        self.split = self.hashes[self.counts >= SPLIT]
        self.maybe = np.zeros(1 << 24, dtype=np.uint8)  # a bit for each 32 hashes
        np.bitwise_or.at(self.maybe, self.hashes >> 8, (1 << (self.hashes >> 5 & 7)).astype(np.uint8))

    def hot(self, h: np.ndarray) -> np.ndarray:
        """Rank among the frequent ones + 1, or 0."""
        out = np.zeros(len(h), dtype=np.int32)
        if len(self.hashes):
            h = (h >> np.uint64(32)).astype(np.uint32)
            some = np.flatnonzero(self.maybe[h >> 8] >> (h >> 5 & 7).astype(np.uint8) & 1)
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            found = self.hashes[at] == h[some]
            out[some[found]] = self.rank[at[found]] + 1
        return out


def prefixes(sets: Sets, order: Order, light: int, threshold: int) -> list[bytes]:
    """For each set the keys of its prefix, in the global order, if a heavy partner is possible."""
    n = sets.n
    prefix = n - -(-threshold * n // 100) + 1
    # the order within a set: frequent elements after all others
    rank = np.lexsort((sets.h, order.hot(sets.h), sets.doc))
    pos = np.arange(len(rank)) - sets.first[sets.doc]
    listed = (pos < prefix[sets.doc]) & (100 * n[sets.doc] >= threshold * (light + 1))
    keys, cut = sets.h[rank][listed], np.searchsorted(sets.doc[listed], np.arange(len(n) + 1))
    return [keys[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


def subsets(sets: Sets, light: int, threshold: int) -> list[bytes]:
    """For each light set the keys of its subsets of all sizes that a link could share."""
    out = [b""] * len(sets.n)
    for d in np.flatnonzero((sets.n > 0) & (sets.n <= light)).tolist():
        own = K.mix(sets.h[sets.first[d] : sets.first[d + 1]] ^ np.uint64(0xC2B2AE3D27D4EB4F))
        gone = [x for j in range(spare(len(own), threshold) + 1) for x in combinations(range(len(own)), j)]
        without = np.array([own[list(x)].sum(dtype=np.uint64) for x in gone], dtype=np.uint64)
        size = np.array([len(own) - len(x) for x in gone], dtype=np.uint64)
        out[d] = K.mix(own.sum(dtype=np.uint64, keepdims=True) - without + size * np.uint64(0x9E3779B97F4A7C15)).tobytes()
    return out


def bitmaps(sets: Sets) -> list[bytes]:
    """A bit for each element, in a power of two of bits from 64 on, at least the set's size."""
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(sets.n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    flags = np.zeros(at[-1], dtype=bool)
    flags[at[sets.doc] + (sets.h >> np.uint64(20)).astype(np.int64) % bits[sets.doc]] = True
    packed = np.packbits(flags)
    return [packed[a:b].tobytes() for a, b in zip(at[:-1] // 8, at[1:] // 8, strict=True)]


def bits_differ(x: bytes, y: bytes) -> int:
    """Places in which two bitmaps differ, the larger one folded: no more than the elements that only one set has."""
    x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _indexed(shared, doc_id: str, text: str, k: int, light: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            for lo, hi in K.chunks(off):
                sets = Sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                keys = (prefixes(sets, order, light, threshold), subsets(sets, light, threshold), bitmaps(sets))
                yield pa.RecordBatch.from_arrays([K.string_column(batch, doc_id).slice(lo, hi - lo), pa.array(sets.n.astype(np.int64)), pa.array(sets.names(), mask=sets.n == 0), *(pa.array(x, pa.binary()) for x in keys)], names=["doc_id", "n", "owner", "prefix", "subsets", "bits"])

    return run


def _postings(batch: pa.RecordBatch, name: str) -> np.ndarray:
    owner, n = (K.string_column(batch, c).to_numpy() for c in ("owner", "n"))
    keys = K.string_column(batch, name).to_pylist()
    size = np.array([len(x) // 8 for x in keys], dtype=np.int64)
    rows = np.zeros(size.sum(), dtype=POSTING)
    rows["key"], rows["owner"], rows["n"] = np.frombuffer(b"".join(keys), dtype=np.uint64), np.repeat(owner, size), np.repeat(n, size)
    if name == "prefix":
        rows["pos"] = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    return rows


def _apart(keys: np.ndarray, split: np.ndarray) -> np.ndarray:
    return np.isin((keys >> np.uint64(32)).astype(np.uint32), split)


def _dealt(buckets: int, split: np.ndarray):
    """Postings by bucket of their key, packed: one row for a bucket and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = _postings(batch, "prefix")
            if len(split):
                prefix = prefix[~_apart(prefix["key"], split)]
            rows = np.concatenate([prefix, _postings(batch, "subsets")])
            bucket = (rows["key"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
            stop = np.append(begin[1:], len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary())], names=["bucket", "rows"])

    return run


def _split(split: np.ndarray):
    """Postings of very frequent shingles, one to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _postings(batch, "prefix")
            rows = rows[_apart(rows["key"], split)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int64)) if c != "key" else pa.array(rows[c].view(np.int64)) for c in ("key", "owner", "n", "pos")], names=["key", "owner", "n", "pos"])

    return run


def split_lists(keys: DataFrame, split: np.ndarray, threshold: int) -> DataFrame:
    """The members of the lists of very frequent shingles, with the head of each, as :func:`_scanned` gives them."""
    rows = shared_table(keys.mapInArrow(_split(split), "key long, owner long, n long, pos long").groupBy("key", "owner").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "split")
    heads = rows.groupBy("key").agg(F.min(F.struct("pos", "n", "owner")).alias("h"), F.count("*").alias("size")).where("size > 1").select("key", "h")
    n, m = F.col("n"), F.col("h.n")
    most = 1 + F.least(n - F.col("pos") - 1, m - F.col("h.pos") - 1)
    least = F.ceil(threshold * (n + m) / F.lit(100 + threshold))
    met = (most >= least) & (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (F.col("owner") != F.col("h.owner"))
    return rows.join(F.broadcast(heads), "key").select("key", "owner", "n", "pos", F.col("h.owner").alias("head"), (1 + met.cast("long")).alias("kind"))


def _lists(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct postings in lists (sorted by key, place, size, owner) of two members or more; the first of each."""
    rows = rows[np.lexsort((rows["owner"], rows["n"], rows["pos"], rows["key"]))]
    if not len(rows):
        return rows, np.zeros(1, dtype=np.int64)
    same = np.ones(len(rows), dtype=bool)
    same[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["owner"][1:] != rows["owner"][:-1])
    rows = rows[same]
    begin = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    size = np.diff(np.append(begin, len(rows)))
    live = np.repeat(size > 1, size)
    return rows[live], np.concatenate([[0], np.cumsum(size[size > 1])])


def _possible(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sizes and the places of the shared element allow a link."""
    most = 1 + np.minimum(a["n"] - a["pos"] - 1, b["n"] - b["pos"] - 1)
    small, large = np.minimum(a["n"], b["n"]), np.maximum(a["n"], b["n"])
    return (most >= needed(a["n"].astype(np.int64), b["n"], threshold)) & (100 * small.astype(np.int64) >= threshold * large)


def _buckets(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """The packed rows of each bucket; the rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, *rows in zip(K.string_column(batch, "bucket").to_pylist(), *(K.string_column(batch, n) for n in names), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(tuple(x.as_py() for x in rows))
    if held:
        yield now, held


def _scanned(threshold: int):
    """Possible pairs of short lists (kind 0: owner and head); the members of long lists with the head (1, or 2 if both could link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _buckets(batches, "rows"):
            rows, first = _lists(np.frombuffer(b"".join(x for x, in blobs), dtype=POSTING))
            size = np.diff(first)
            out = [np.zeros((0, 6), dtype=np.int64)]
            for n in np.unique(size[size <= SHORT]).tolist():
                begin = first[:-1][size == n]
                for i in range(n):
                    for j in range(i + 1, n):
                        a, b = rows[begin + i], rows[begin + j]
                        ok = _possible(a, b, threshold)
                        pair = np.zeros((int(ok.sum()), 6), dtype=np.int64)
                        pair[:, 1], pair[:, 4] = np.minimum(a["owner"], b["owner"])[ok], np.maximum(a["owner"], b["owner"])[ok]
                        out.append(pair)
            pairs = np.unique(np.concatenate(out), axis=0)
            long = np.repeat(size > SHORT, size)
            head = rows[np.repeat(first[:-1], size)][long]
            own = rows[long]
            met = _possible(head, own, threshold) & (head["owner"] != own["owner"])
            members = np.stack([own["key"].view(np.int64), own["owner"], own["n"], own["pos"], head["owner"], 1 + met], axis=1).astype(np.int64)
            got = np.concatenate([pairs, members])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in got.T], names=["key", "owner", "n", "pos", "head", "kind"])

    return run


def _alike(threshold: int):
    """Pairs that the bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, n, m = (K.string_column(batch, c) for c in ("a", "b", "x", "y", "n", "m"))
            n, m = n.to_numpy(), m.to_numpy()
            most = n + m - 2 * needed(n, m, threshold)
            keep = pa.array([i for i, (p, q) in enumerate(zip(x, y, strict=True)) if bits_differ(p.as_py(), q.as_py()) <= most[i]], pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])

    return run


def _with(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with a table of one row for each key; a key's rows do not meet in one task.

    It is broadcast if it holds at most ``BROADCAST_PAIRS`` rows (of three numbers), else repeated for each salt of the rows.
    """
    if few.count() <= BROADCAST_PAIRS:
        return rows.join(F.broadcast(few), on)
    salt = F.pmod(F.xxhash64("owner"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"]).drop("salt")


def crossing_groups(rows: DataFrame, block: int) -> DataFrame:
    """(group, side, owner, n, pos, label): members of long lists (key, owner, n, pos, label) in groups that are each compared whole.

    Of lists whose members have one label nothing is left.  Labels of ``block`` members or more of a list are
    cut into blocks, the others are dealt to blocks together.  Each pair of blocks of a list, but those of one
    large label, is a group: sides 0 and 1, or side 0 alone for a block with itself.
    """
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rows = shared_table(_with(rows, shared_table(mixed, "keys"), ["key"]), "mixed")
    cells = rows.groupBy("key", "label").agg(F.count("*").alias("size"))
    large = F.col("size") >= block
    rest = cells.groupBy("key").agg(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("rest"))
    cells = cells.join(rest, "key").select("key", "label", large.alias("large"), F.when(large, F.ceil(F.col("size") / block)).otherwise(F.ceil(F.col("rest") / block)).cast("int").alias("parts"))
    cells = shared_table(cells, "cells")
    # a block: the label (null for those of many) and a number
    blocks = cells.select("key", F.when(F.col("large"), F.col("label")).alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    a, b = (blocks.select("key", F.struct("of", "part").alias(x)) for x in "ab")
    pairs = a.join(b, "key").where("a <= b and not coalesce(a.of = b.of, false)").withColumn("group", F.xxhash64("key", "a.of", "a.part", "b.of", "b.part"))
    sides = pairs.select("key", "group", F.explode(F.when(F.expr("a = b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block"))))).alias("s"))
    sides = sides.select("key", "group", "s.side", F.col("s.block.of").alias("of"), F.col("s.block.part").alias("part"))
    placed = _with(rows, cells, ["key", "label"]).withColumns({"of": F.when(F.col("large"), F.col("label")), "part": F.pmod(F.when(F.col("large"), F.xxhash64("owner")).otherwise(F.xxhash64("label")), "parts").cast("int")})
    met = (F.col("x.key") == F.col("y.key")) & F.col("x.of").eqNullSafe(F.col("y.of")) & (F.col("x.part") == F.col("y.part"))
    return placed.alias("x").join(sides.alias("y"), met).select("group", "side", "x.key", "owner", "n", "pos", "label")


def _crossing(threshold: int):
    """Pairs of a group's sets that have different labels and could link; rows come sorted by group and key."""

    def pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = rows[["owner", "n", "pos"]].to_records(index=False)
        label, side = rows["label"].values, rows["side"].values
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        single = not len(right)
        a, b = np.meshgrid(left, left if single else right, indexing="ij")
        a, b = a.ravel(), b.ravel()
        ok = label[a] != label[b]
        if single:
            ok &= a < b
        a, b = a[ok], b[ok]
        ok = _possible(got[a], got[b], threshold)
        return got["owner"][a[ok]], got["owner"][b[ok]]

    def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = rows[["group", "key"]].values
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        out = [pairs(rows.iloc[lo:hi]) for lo, hi in zip(first, first[1:], strict=False)]
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(a):
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            done = (rows["group"] != rows["group"].iloc[-1]).values  # the last group may go on
            rest = rows[~done].reset_index(drop=True)
            if done.any():
                yield from whole(rows[done].reset_index(drop=True))
        if rest is not None:
            yield from whole(rest)

    return run


def _sets_of(shared, doc_id: str, text: str, k: int):
    """(owner, set) of the documents that stand for a wanted set (all documents if ``shared`` is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, ids = (None, None) if shared is None else shared.value
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            key = K.string_column(batch, doc_id).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in K.chunks(off):
                sets = Sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                names, wanted = sets.names(), sets.n > 0
                if owners is not None and not len(owners):
                    wanted[:] = False
                elif owners is not None:
                    at = np.minimum(np.searchsorted(owners, names), len(owners) - 1)
                    wanted &= (owners[at] == names) & (ids[at] == key[lo:hi])
                some = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array([sets.h[sets.first[d] : sets.first[d + 1]].tobytes() for d in some.tolist()], pa.binary())], names=["owner", "elements"])

    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(K.string_column(batch, "x"), K.string_column(batch, "y"), strict=True)):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = np.sort(np.concatenate([x, y]))
                if int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y), threshold):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([K.string_column(batch, c).take(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def alike(pairs: DataFrame, owners: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps of ``owners`` do not rule out."""
    x = owners.select(F.col("owner").alias("a"), F.col("bits").alias("x"), "n")
    y = owners.select(F.col("owner").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_alike(threshold), "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    if pairs.count() <= BROADCAST_PAIRS:  # 16 bytes each
        pairs = F.broadcast(pairs)
    x = sets.select(F.col("owner").alias("b"), F.col("elements").alias("y"))
    y = sets.select(F.col("owner").alias("a"), F.col("elements").alias("x"))
    return pairs.join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a long, b long").distinct()


def by_bucket(packed: DataFrame) -> DataFrame:
    n = partitions(packed.sparkSession)
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket")


def frequent_shingles(docs: DataFrame, text: str, k: int) -> tuple[Order, float]:
    """The global order, and the mean length of the list of a shingle taken at random."""
    bits = hash_bits(docs.sparkSession)
    hashed = docs.select(text).mapInArrow(_hashed(k, text, bits), "bucket int, rows binary, many binary")
    counted = shared_table(by_bucket(hashed).mapInArrow(_frequent(bits), "kind long, h long, n long"), "frequent")
    total = {r["kind"]: r["n"] for r in counted.where("kind > 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    hot = counted.where("kind = 0")
    least = least_count([(r["n"], r["rows"]) for r in hot.groupBy("n").agg(F.count("*").alias("rows")).collect()], HOT_SHINGLES)
    h, n = columns(hot.where(F.col("n") >= least).select("h", "n"))
    return Order(h, n), total.get(2, 0) / max(1, total.get(1, 1))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, threshold: int = 85) -> DataFrame:
    """A row per document: doc_id, n_shingles and component_id (smallest doc_id that links reach)."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    before = tables_made()
    order, length = frequent_shingles(docs, "text", k)
    light = boundary(length, threshold)
    shared = spark.sparkContext.broadcast(order)
    index = shared_table(docs.mapInArrow(_indexed(shared, "doc_id", "text", k, light, threshold), "doc_id long, n long, owner long, prefix binary, subsets binary, bits binary"), "sets")
    buckets = 8 * partitions(spark)
    keys = index.where("owner is not null").select("owner", "n", "prefix", "subsets")
    split = order.split
    dealt = by_bucket(keys.mapInArrow(_dealt(buckets, split), "bucket int, rows binary"))
    lists = dealt.mapInArrow(_scanned(threshold), "key long, owner long, n long, pos long, head long, kind long")
    lists = shared_table(lists.unionByName(split_lists(keys, split, threshold)) if len(split) else lists, "lists")
    owners = index.where("owner is not null").groupBy("owner").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.coalesce("doc_id", F.lit(0))).alias("id"), F.min("doc_id").alias("least"))

    # pairs of short lists; in long ones each set with the head that it meets most often
    met = lists.where("kind = 2").groupBy("owner", "head").agg(F.count("*").alias("n"))
    best = met.groupBy("owner").agg(F.max(F.struct("n", F.col("head"))).alias("best")).select(F.least("owner", "best.head").alias("a"), F.greatest("owner", "best.head").alias("b"))
    pairs = lists.where("kind = 0").select(F.col("owner").alias("a"), F.col("head").alias("b")).unionAll(best).distinct()
    pairs = shared_table(alike(pairs, owners, threshold), "pairs")

    # the documents that stand for the sets to be verified
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("owner")).unionAll(lists.where("kind > 0").select("owner")).distinct()
    wanted = shared_table(wanted.join(owners.select("owner", "id"), "owner"), "owners")
    if wanted.count() <= BROADCAST_SETS:
        names, ids = columns(wanted.select("owner", "id"))
        order = np.argsort(names)
        keep = spark.sparkContext.broadcast((names[order], ids[order]))
        sets = docs.mapInArrow(_sets_of(keep, "doc_id", "text", k), "owner long, elements binary")
    else:
        sets = docs.mapInArrow(_sets_of(None, "doc_id", "text", k), "owner long, elements binary").join(wanted, "owner", "left_semi").dropDuplicates(["owner"])
    sets = shared_table(sets, "elements")
    links = shared_table(linked(pairs, sets, threshold), "links")

    # what crosses components in long lists
    long = lists.where("kind > 0").select("key", "owner", "n", "pos")
    if not long.isEmpty():
        label = shared_table(components(links), "labels")
        rows = long.join(label.withColumnRenamed("node", "owner"), "owner", "left").select("key", "owner", "n", "pos", F.coalesce("component", "owner").alias("label"))
        groups = crossing_groups(rows, BLOCK)
        crossing = groups.repartition(partitions(spark), "group").sortWithinPartitions("group", "key").mapInPandas(_crossing(threshold), "a long, b long").distinct()
        crossing = shared_table(alike(crossing, owners, threshold), "crossing")
        links = shared_table(links.unionAll(linked(crossing, sets, threshold)), "all_links")
    label = components(links)

    # classes are named before documents are joined to them, by tables of their own: such a join can be
    # split where very many documents are copies of one set
    named = shared_table(owners.select("owner", "least").join(label.withColumnRenamed("node", "owner"), "owner", "left").select("owner", "least", F.coalesce("component", "owner").alias("component")), "named")
    least = shared_table(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    classes = shared_table(named.select("owner", "component").join(least, "component").select("owner", "component_id"), "classes")
    release(before, index, classes)
    return index.select("doc_id", "n", "owner").join(classes, "owner", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The document of the smallest id of each component; rows that repeat an id stay or go together.

    Of a component without any id one row stays; rows without id and shingles are components of their own and stay.
    """
    nameless = docs.where(F.col(doc_id).cast("long").isNull())
    if nameless.isEmpty():
        kept = jaccard_components(docs, doc_id, text, **how).where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
        return docs.join(kept, doc_id, "left_semi").select(*docs.columns)
    name = F.xxhash64(F.lit("no id"), F.coalesce(text, F.lit("")))
    own = F.col(doc_id).cast("long")
    found = jaccard_components(docs.select(F.coalesce(own, name).alias("doc_id"), F.col(text).alias("text")), k=how.get("k", 4), threshold=how.get("threshold", 85))
    names = nameless.select(name.alias("doc_id"), F.lit(1).alias("last")).distinct()
    found = shared_table(found.distinct().join(names, "doc_id", "left").na.fill({"last": 0}), "named_rows")
    # ids go before names that stand for none
    best = found.groupBy("component_id").agg(F.min(F.struct("last", "doc_id")).alias("best")).select("best.*").join(found.select("doc_id", "n_shingles"), "doc_id")
    kept = best.where("last = 0").select(F.col("doc_id").alias("_name"))
    some = best.where("last = 1").select(F.col("doc_id").alias("_name"), "n_shingles")
    with_id = docs.join(kept, own == F.col("_name"), "left_semi").select(*docs.columns)
    rows = nameless.withColumn("_at", name).join(some, F.col("_at") == F.col("_name"))
    single = rows.where("n_shingles > 0").dropDuplicates(["_name"]).select(*docs.columns)
    return with_id.unionAll(single).unionAll(rows.where("n_shingles = 0").select(*docs.columns))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

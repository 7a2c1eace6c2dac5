"""Best-fit packing by minimum bin slack.

Documents become token ids (byte-level BPE, then one id 0); longer ones are cut into pieces of the
capacity, the first piece being the shorter.  Only the counts of each length (at most ``capacity``
numbers) reach the driver.  There each bin takes the largest length left and the fullest feasible
combination of the others, found by subset-sum dynamic programming over a bitset; the combination
is applied as often as the counts allow, so the work depends on the number of lengths and not on
the number of documents.  A piece's place follows from its rank among those of its length: a task
counts its own pieces while it cuts them, and the counts of the tasks before it are added.

Defined results: a null text is empty and gives the single id 0; repeated documents are packed each.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import shared_table, short_batches, table

CAPACITY = 2048
END = 0
#: Text that the tokenizer's file marks as a special token.
SPECIAL = "<|endoftext|>"


def min_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, pieces of it), ...]), ...]: combinations and how many bins take each."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    bins = []
    while left:
        largest = next(iter(left))
        room = capacity - largest
        mask, reach, layers = (1 << (room + 1)) - 1, 1, []
        for n, c in left.items():
            c = min(c - (n == largest), room // n)
            k = 1
            while c > 0:  # any number up to c, as sums of 1, 2, 4 ... pieces
                k = min(k, c)
                new = (reach | reach << n * k) & mask
                if new != reach:
                    layers.append((n, k, reach))
                    reach = new
                c, k = c - k, 2 * k
            if reach >> room & 1:
                break
        at, combination = reach.bit_length() - 1, {largest: 1}
        for n, k, before in reversed(layers):
            if not before >> at & 1:
                combination[n] = combination.get(n, 0) + k
                at -= n * k
        times = min(left[n] // k for n, k in combination.items())
        bins.append((times, sorted(combination.items(), reverse=True)))
        for n, k in combination.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return bins


class Encoder:
    """Token ids of a text; the two libraries give the same ids, the faster one is used where it can be."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if not hasattr(self.full, "encode"):
                self.full = self.full()
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@cache
def encoder(name: str) -> Encoder:
    """One for each Python worker; workers are used again by later tasks."""
    return Encoder(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _cut(doc_id: str, text: str, capacity: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for key, x in zip(K.string_column(batch, doc_id).to_pylist(), K.string_column(batch, text), strict=True):
                ids = np.append(encode(x.as_py() or ""), np.uint32(END)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                stops = range(first, len(ids) + 1, capacity)
                for piece, stop in enumerate(stops):
                    start = max(0, stop - capacity) if piece else 0
                    n = stop - start
                    out.append((key, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (length, first rank, first bin, pieces in a bin, offset) by length and rank."""
    rows, used, base = [], {}, 0
    for times, combination in bins:
        offset = 0
        for n, k in combination:
            rows.append((n, used.get(n, 0), base, k, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        base += times
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return table_, table_[:, 0] * (1 << 48) + table_[:, 1]


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = places.value
        for batch in batches:
            n, rank = (K.string_column(batch, c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = rows[np.searchsorted(keys, n * (1 << 48) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            kept = [K.string_column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at[:, 2] + nth // at[:, 3]), pa.array(at[:, 4] + nth % at[:, 3] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = shared_table(docs.mapInArrow(_cut("doc_id", "text", capacity, tokenizer), PIECES), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(_places(min_bin_slack({r["length"]: r["n"] for r in counts}, capacity)))
    before = by_part.select("part", "length", F.expr("sum(n) over (partition by length order by part) - n").alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

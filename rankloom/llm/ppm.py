"""Language-model scoring by prediction by partial matching, beside a unigram baseline.

A text is read as its tokens: words (A-Z lower-cased) and one end.  The baseline scores tokens by
add-one counts.  The model scores their spelling: bytes of the words, one space between them and an
end symbol, each predicted from the longest context of up to 5 bytes that the trie holds.  At a
context with T occurrences of q different symbols a symbol seen n times gets n / (T + q) and the
escape to the next shorter context q / (T + q).  After an escape, the symbols seen in the longer
context are excluded from T and q of the shorter one; since every symbol seen after a context was
also seen after its suffix, what is excluded is a constant of the longer context and is computed
once.  Below the empty context the symbols not seen yet are equally likely.

Counts come from all training documents, by aggregates over the whole corpus.  Two tables of bounded
size go to every task: the trie (per order, the contexts of the highest counts, whole, up to
``MOST_ENTRIES`` entries) and the head of the vocabulary (``MOST_WORDS``).  Words beyond the head
are scored exactly by a join on the word, which returns sums per document.  So are symbols whose
longest context is not in a trie that had to leave contexts out: the whole count table is dealt by
the last bytes of the context, each share of it makes a trie of its own, and the symbols are looked up
there.  Two bytes are asked first; a suffix that holds more than an even share is dealt by one byte
more, up to the whole context, and the counts after such a suffix (there are no more of a length than
shares) go to every task with the orders 0 and 1.  Scores do not depend on the two limits.

Defined results: null, empty and wordless texts are the end alone (n_tokens 1); repeated rows are
scored each alike and count each in training; a null id is hashed as empty text.  Without training
documents N and V are 0 and all symbols equally likely.  An empty table gives an empty result.
Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import columns, held_out, least_count, partitions, release, shared_table, short_batches, table, tables_made

ORDER = 5
MOST_ENTRIES = 1 << 20
MOST_WORDS = 1 << 20
MOD, REST = 7, 2
#: Symbols that UTF-8 never holds.
START, END = 0xFE, 0xFF
SYMBOLS = 255  # all but START
END_WORD = np.uint64(0x1D8E4E27C47D124F)
#: Text that a task counts at a time.
COUNT_BYTES = 32 << 20
CHUNK, SCORE_CHUNK = 2 << 20, 1 << 20
#: Suffixes of a context that are dealt by a further byte are those above this share of the work.
MOST_SHARES = 4096
#: Counts that a task packs by bucket at a time.
PACK_ROWS = 1 << 20
#: Odd number that deals suffixes over the buckets.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
COUNT = np.dtype([("key", "<u8"), ("n", "<i8")])
TAIL = np.dtype([("word", "<u8"), ("row", "<i8"), ("times", "<i4")])


def spell(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte contexts and symbols of all documents as ``context << 8 | symbol``, and the first of each document."""
    n = len(first) - 1
    size = e - s
    words = np.diff(first)
    length = K.sums(size + 1, first) + (words == 0)  # a space or an end after each word
    begin = np.concatenate([[0], np.cumsum(length + ORDER)])
    out = np.full(begin[-1], ord(" "), dtype=np.uint8)
    out[(begin[:-1, None] + np.arange(ORDER)).ravel()] = START
    out[begin[1:] - 1] = END
    doc = np.repeat(np.arange(n), words)
    before = np.cumsum(size + 1) - (size + 1)
    at = begin[doc] + ORDER + before - before[first[doc]] if len(s) else before
    place = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    source = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[place] = K.LOWER[data[source]]
    wide = out.astype(np.uint64)
    key = np.zeros(len(out), dtype=np.uint64)
    for j in range(ORDER + 1):
        key[ORDER:] |= wide[j : len(out) - ORDER + j] << np.uint64(8 * (ORDER - j))
    keep = np.ones(len(out), dtype=bool)
    keep[(begin[:-1, None] + np.arange(ORDER)).ravel()] = False
    return key[keep], np.concatenate([[0], np.cumsum(length)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _counted(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, ends, size = [], [], 0, 0

        def report():
            for kind, (keys, counts) in ((0, _merged(grams)), (1, _merged([*words, (np.array([END_WORD]), np.array([ends]))]))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            for lo, hi in K.chunks(off, CHUNK):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                s, e, first = K.words(part, o, K.NOT_BLANK)
                grams.append(np.unique(spell(part, s, e, first)[0], return_counts=True))
                words.append(np.unique(K.hashes(part, s, e), return_counts=True))
                ends, size = ends + hi - lo, size + len(part)
                if len(grams) == 4:
                    grams, words = [_merged(grams)], [_merged(words)]
                if size >= COUNT_BYTES:
                    yield from report()
                    grams, words, ends, size = [], [], 0, 0
        if ends:
            yield from report()

    return run


class Trie:
    """Contexts of all orders with their symbols; ``grams[k]`` has (keys ``context << 8 | symbol``, counts) of order k."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.keys, self.log_n, self.contexts, self.own, self.down = [], [], [], [], []
        self.whole = True  # nothing that was counted is left out
        self.short = grams[:2]
        self.least = 1  # contexts of fewer occurrences were left out
        before = None
        for k, (keys, n) in enumerate(grams):
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.float64)
            context = keys >> np.uint64(8)
            begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(n, begin) if len(begin) else np.zeros(0)
            kinds = np.diff(np.append(begin, len(keys))).astype(np.float64)
            if k:  # what a context excludes from its suffix, and what is left there
                mask = np.uint64((1 << 8 * (k - 1)) - 1)
                up = np.searchsorted(before[0], (context & mask) << np.uint64(8) | keys & np.uint64(255))
                gone = np.add.reduceat(before[1][up], begin) if len(begin) else np.zeros(0)
                suffix = np.searchsorted(before[2], context[begin] & mask)
                rest, more = before[3][suffix] - gone, before[4][suffix] - kinds
                self.down.append(self._logs(rest + more, more))
            else:
                left = SYMBOLS - kinds  # below the empty context
                self.down.append(self._logs(left, left))
            self.keys.append(keys if k > 2 else keys.astype(np.uint32))
            self.log_n.append(np.log(n))
            self.contexts.append(context[begin])
            self.own.append(self._logs(total + kinds, kinds))
            before = (keys, n, context[begin], total, kinds)

    @staticmethod
    def _logs(whole: np.ndarray, escape: np.ndarray) -> np.ndarray:
        """Rows (log of the denominator, log of the escape's share); both 0 where nothing is left to choose from."""
        some = whole > 0
        out = np.zeros((len(whole), 2))
        out[some, 0] = np.log(whole[some])
        out[some, 1] = np.log(np.maximum(escape[some], 1e-300))
        return out

    def decides(self, keys: np.ndarray) -> np.ndarray:
        """Whether the trie gives the probability that the whole table gives."""
        if self.whole:
            return np.ones(len(keys), dtype=bool)
        held, context = self.contexts[ORDER], keys >> np.uint64(8)
        if not len(held):
            return np.zeros(len(keys), dtype=bool)
        return held[np.minimum(np.searchsorted(held, context), len(held) - 1)] == context

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's probability after its context; ``keys`` of the highest order."""
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        spare = np.zeros((len(keys), 2))  # logs at this order, given the escape from a longer context
        fell = np.zeros(len(keys), dtype=bool)
        for k in range(len(self.keys) - 1, -1, -1):
            key = (keys[rest] & np.uint64((1 << 8 * (k + 1)) - 1)).astype(self.keys[k].dtype)
            context = (key >> self.keys[k].dtype.type(8)).astype(self.contexts[k].dtype)
            if not len(self.contexts[k]):
                continue
            c = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            there = self.contexts[k][c] == context
            logs = np.where(fell[rest, None], spare[rest], self.own[k][c])
            e = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            found = self.keys[k][e] == key
            out[rest[found]] += self.log_n[k][e[found]] - logs[found, 0]
            missed = there & ~found
            out[rest[missed]] += logs[missed, 1] - logs[missed, 0]
            spare[rest[missed]] = self.down[k][c[missed]]
            fell[rest[missed]] = True
            rest = rest[~found]
        return np.concatenate([out]) if not len(rest) else self._uniform(out, rest, spare, fell)

    @staticmethod
    def _uniform(out: np.ndarray, rest: np.ndarray, spare: np.ndarray, fell: np.ndarray) -> np.ndarray:
        out[rest] -= np.where(fell[rest], spare[rest, 0], np.log(SYMBOLS))
        return out


def _tails(what: np.ndarray, owner: np.ndarray, row: np.ndarray) -> pa.Array:
    """For each document, what it holds that is to be joined, and how often."""
    order = np.lexsort((what, owner))
    what, owner = what[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], (what[1:] != what[:-1]) | (owner[1:] != owner[:-1])])) if len(what) else np.zeros(0, dtype=np.int64)
    far = np.zeros(len(begin), dtype=TAIL)
    far["word"], far["row"], far["times"] = what[begin], row[owner[begin]], np.diff(np.append(begin, len(what)))
    cut = np.searchsorted(owner[begin], np.arange(len(row) + 1))
    return pa.array([far[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())


def _scored(shared, doc_id: str, text: str):
    """A row per document: what the trie and the head of the vocabulary give, and its words and symbols beyond them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, head, counts = shared.value
        end = counts[np.searchsorted(head, END_WORD)] if END_WORD in head else 0
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            ids = K.string_column(batch, doc_id)
            whole = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi in K.chunks(off, SCORE_CHUNK):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                s, e, first = K.words(part, o, K.NOT_BLANK)
                keys, at = spell(part, s, e, first)
                distinct, inverse = np.unique(keys, return_inverse=True)
                near = trie.decides(distinct)
                log = np.zeros(len(distinct))
                log[near] = trie.log_probability(distinct[near])
                score = K.sums(log[inverse], at) / np.log(10)
                h = K.hashes(part, s, e)
                row = K.mix(K.hashes(part, o[:-1], o[1:]) ^ K.mix(whole[lo:hi])).view(np.int64)
                where = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                known = head[where] == h if len(head) else np.zeros(len(h), dtype=bool)
                log = np.where(known, np.log10(counts[where] + 1.0), 0.0) if len(head) else np.zeros(len(h))
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                away = ~near[inverse]
                grams = _tails(keys[away], np.repeat(np.arange(hi - lo), np.diff(at))[away], row)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(row), pa.array((np.diff(first) + 1).astype(np.int64)), pa.array((K.sums(known.astype(np.int64), first) + (end > 0)).astype(np.int64)), pa.array(K.sums(log, first) + np.log10(end + 1.0)), pa.array(score), _tails(h[~known], doc[~known], row), grams],
                    names=["doc_id", "row", "n_tokens", "known", "logs", "score", "far", "grams"],
                )

    return run


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words % np.uint64(buckets)).astype(np.int32)


class Suffixes:
    """Deals contexts by their last bytes: two, and one more for as long as the suffix is in ``hot`` (of 2 to 4 bytes)."""

    def __init__(self, hot: dict[int, np.ndarray], paths: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.hot, self.paths = hot, paths  # sorted suffixes by length; (keys, counts) of the symbols after them

    @staticmethod
    def _held(sorted_: np.ndarray, what: np.ndarray) -> np.ndarray:
        return sorted_[np.minimum(np.searchsorted(sorted_, what), len(sorted_) - 1)] == what if len(sorted_) else np.zeros(len(what), dtype=bool)

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """How many bytes of the context of each of ``keys`` decide."""
        out = np.full(len(keys), 2)
        for k, hot in self.hot.items():
            out += (out == k) & self._held(hot, keys >> np.uint64(8) & np.uint64((1 << 8 * k) - 1))
        return out

    def buckets(self, keys: np.ndarray, n: int) -> np.ndarray:
        length = self.lengths(keys).astype(np.uint64)
        suffix = keys >> np.uint64(8) & ((np.uint64(1) << np.uint64(8) * length) - np.uint64(1))
        return (((suffix << np.uint64(3) | length) * SPREAD >> np.uint64(32)) % np.uint64(n)).astype(np.int32)

    def orders(self, keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The counts of the orders from 2 on that a share with ``keys`` needs to answer ``asked``."""
        length, out = self.lengths(keys), []
        met = np.concatenate([keys, asked]) >> np.uint64(8)
        for k in range(2, ORDER + 1):
            own = length <= k  # of the others, the share holds only some of what follows the suffix
            parts = [(keys[own] & np.uint64((1 << 8 * (k + 1)) - 1), counts[own])]
            if k in self.paths:
                path, n = self.paths[k]
                used = self._held(np.unique(met & np.uint64((1 << 8 * k) - 1)), path >> np.uint64(8))
                parts.append((path[used], n[used]))
            out.append(_merged(parts))
        return out


def divide(grams: DataFrame, least: int, shares: int) -> Suffixes:
    """Suffixes with more than one of ``shares`` even parts of the work: rows of the count table, and occurrences that tasks may have to look up."""
    before = tables_made()
    work = F.lit(1) + F.when(F.col("n") < least, F.col("n")).otherwise(0)
    sizes = shared_table(grams.groupBy(F.shiftright("key", 8).bitwiseAND(0xFFFFFFFF).alias("suffix")).agg(F.sum(work).alias("work")), "suffixes")
    most = (sizes.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]) // shares
    hot, paths = {}, {}
    for k in (2, 3, 4):
        suffix = F.col("suffix").bitwiseAND((1 << 8 * k) - 1).alias("suffix")
        (found,) = columns(sizes.groupBy(suffix).agg(F.sum("work").alias("work")).where(F.col("work") > most).select("suffix"))
        if not len(found):
            break
        hot[k] = np.sort(found.astype(np.int64).view(np.uint64))
        own = F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1)
        named = grams.sparkSession.createDataFrame([(int(x),) for x in hot[k]], "suffix long")  # no more than shares
        after = grams.select(own.alias("key"), "n").withColumn("suffix", F.shiftright("key", 8)).join(F.broadcast(named), "suffix", "left_semi")
        keys, n = columns(after.groupBy("key").agg(F.sum("n").alias("n")))
        order = np.argsort(keys.view(np.uint64))
        paths[k] = (keys.view(np.uint64)[order], n[order])
    release(before)
    return Suffixes(hot, paths)


def _by_bucket(rows: np.ndarray, bucket: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``rows`` packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
    stop = np.append(begin[1:], len(rows))
    return pa.array(bucket[begin], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(begin, stop, strict=False)], pa.binary())


def _packed_counts(batches: Iterator[pa.RecordBatch], bucket_of, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, n) of a table, packed by bucket."""
    held, size = [], 0

    def packed():
        rows = np.concatenate(held)
        bucket, counts = _by_bucket(rows, bucket_of(rows["key"], buckets))
        return pa.RecordBatch.from_arrays([bucket, counts, pa.nulls(len(bucket), pa.binary())], names=["bucket", "counts", "rows"])

    for batch in batches:
        rows = np.empty(batch.num_rows, dtype=COUNT)
        for c in ("key", "n"):
            rows[c] = K.string_column(batch, c).to_numpy(zero_copy_only=False).view(COUNT[c])
        held.append(rows)
        size += len(rows)
        if size >= PACK_ROWS:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def _packed(batches: Iterator[pa.RecordBatch], column: str, bucket_of, buckets: int) -> Iterator[pa.RecordBatch]:
    """What is to be joined with its documents, packed by bucket."""
    for batch in batches:
        rows = np.frombuffer(b"".join(K.string_column(batch, column).to_pylist()), dtype=TAIL)
        if not len(rows):
            continue
        bucket, rows = _by_bucket(rows, bucket_of(rows["word"], buckets))
        yield pa.RecordBatch.from_arrays([bucket, pa.nulls(len(bucket), pa.binary()), rows], names=["bucket", "counts", "rows"])


def _word_sums(words: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """By document, sums of the words that the vocabulary holds."""
    at = np.minimum(np.searchsorted(words, rows["word"]), max(len(words) - 1, 0))
    ok = words[at] == rows["word"] if len(words) else np.zeros(len(rows), dtype=bool)
    rows, n = rows[ok], counts[at[ok]]
    keys, inverse = np.unique(rows["row"], return_inverse=True)
    known, logs = np.bincount(inverse, rows["times"], len(keys)), np.bincount(inverse, rows["times"] * np.log10(n + 1.0), len(keys))
    return keys, known.astype(np.int64), logs, np.zeros(len(keys))


def _gram_sums(short: list[tuple[np.ndarray, np.ndarray]], suffixes: Suffixes):
    def sums(grams: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """By document, the scores of symbols after contexts whose last bytes are of this bucket."""
        distinct, which = np.unique(rows["word"], return_inverse=True)
        trie = Trie([*short, *suffixes.orders(grams, counts, distinct)])
        log = trie.log_probability(distinct)[which] / np.log(10)
        keys, inverse = np.unique(rows["row"], return_inverse=True)
        return keys, np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys)), np.bincount(inverse, rows["times"] * log, len(keys))

    return sums


def _looked_up(batches: Iterator[pa.RecordBatch], sums) -> Iterator[pa.RecordBatch]:
    """Per bucket, ``sums`` by document of what its rows hold; rows sorted by bucket."""
    now, held, far = None, [], []

    def joined():
        if not far:
            return
        table_ = np.concatenate([np.zeros(0, dtype=COUNT), *held])
        table_ = table_[np.argsort(table_["key"])]
        rows = np.unique(np.concatenate(far))  # repeated rows of the table have the same key and are counted once
        keys, known, logs, score = sums(table_["key"], table_["n"], rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(known), pa.array(logs), pa.array(score)], names=["row", "known", "logs", "score"])

    for batch in batches:
        for bucket, counts, rows in zip(*(K.string_column(batch, c).to_pylist() for c in ("bucket", "counts", "rows")), strict=True):
            if bucket != now:
                yield from joined()
                now, held, far = bucket, [], []
            if rows is not None:
                far.append(np.frombuffer(rows, dtype=TAIL))
            else:
                held.append(np.frombuffer(counts, dtype=COUNT))
    yield from joined()


def looked_up(table: DataFrame, scored: DataFrame, column: str, bucket_of, sums, buckets: int) -> DataFrame:
    """(row, known, logs, score): what ``column`` of the documents holds, joined by bucket with a table (key, n)."""
    schema = "bucket int, counts binary, rows binary"
    far = scored.where(F.length(column) > 0).select(column).mapInArrow(lambda batches: _packed(batches, column, bucket_of, buckets), schema)
    both = table.select("key", "n").mapInArrow(lambda batches: _packed_counts(batches, bucket_of, buckets), schema).unionByName(far)
    both = both.repartition(partitions(scored.sparkSession), "bucket").sortWithinPartitions("bucket")
    return both.mapInArrow(lambda batches: _looked_up(batches, sums), "row long, known long, logs double, score double")


def count_corpus(docs: DataFrame, text: str) -> DataFrame:
    """(kind, key, n): n-grams of bytes (0) and words (1) of all ``docs``."""
    counted = docs.select(text).mapInArrow(_counted(text), "kind int, key long, n long")
    return shared_table(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def build_trie(counts: DataFrame) -> Trie:
    """The trie of bounded size from the n-gram counts."""
    grams = counts.where("kind = 0").select("key", "n")
    chosen, least, whole = [], 1, True
    before = tables_made()
    orders = [grams]  # each from the one above it, which has fewer rows than the whole
    for k in range(ORDER - 1, -1, -1):
        orders.append(shared_table(orders[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")), f"order-{k}"))
    for k, own in enumerate(reversed(orders)):
        own = own.withColumn("context", F.shiftright("key", 8))
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("q"))
        if k >= 2:  # shorter ones are at most 65,536 contexts' worth of symbols
            histogram = contexts.groupBy("total").agg(F.sum("q").alias("q")).collect()
            least = max(least, least_count([(r["total"], r["q"]) for r in histogram], MOST_ENTRIES))
            whole = whole and all(r["total"] >= least for r in histogram)
            own = own.join(contexts.where(F.col("total") >= least).select("context"), "context", "left_semi")
        keys, n = columns(own.select("key", "n"))
        chosen.append((keys.view(np.uint64), n))
    release(before)
    trie = Trie(chosen)
    trie.whole, trie.least = whole, least
    return trie


def score_texts(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10), learnt from ``train``."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = count_corpus(train, text)
    words = counts.where("kind = 1").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    histogram = words.groupBy("n").agg(F.count("*").alias("words")).collect()
    least = least_count([(r["n"], r["words"]) for r in histogram], MOST_WORDS)
    head, times = columns(words.where((F.col("n") >= least) | (F.col("key") == int(END_WORD))))
    head = head.view(np.uint64)
    order = np.argsort(head)
    trie = build_trie(counts)
    shared = spark.sparkContext.broadcast((trie, head[order], times[order]))
    scored = shared_table(docs.mapInArrow(_scored(shared, "doc_id", "text"), "doc_id long, row long, n_tokens long, known long, logs double, score double, far binary, grams binary"), "scored")
    buckets = 8 * partitions(spark)
    found = looked_up(words.where((F.col("n") < least) & (F.col("key") != int(END_WORD))), scored, "far", _word_bucket, _word_sums, buckets)
    if not trie.whole:
        grams = counts.where("kind = 0").select("key", "n")
        suffixes = divide(grams, trie.least, min(buckets, MOST_SHARES))
        found = found.unionAll(looked_up(grams, scored, "grams", suffixes.buckets, _gram_sums(trie.short, suffixes), buckets))
    found = found.groupBy("row").agg(F.sum("known").alias("more"), F.sum("logs").alias("more_logs"), F.sum("score").alias("more_score"))
    out = scored.drop("far", "grams").join(found, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), MOD, REST)
    scored = score_texts(docs, docs.where(~held))
    return scored.withColumn("held_out", held_out(F.col("doc_id"), MOD, REST)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Toxicity: a convolutional text classifier trained in numpy.

Hashed word embeddings (a word's vector is the mean of those of the word and of its first 4 and 6
bytes, so inflected forms share theirs), filters over 1, 2 and 3 words, rectified max pooling over
the whole text and a logistic output.  It is trained on the driver on a bounded sample of labelled rows
(``MAX_ROWS`` of each class, of one text for each id, and ``MAX_BYTES`` of word ids; texts are taken whole
or not at all).  One dimension of the embedding starts at the words' log odds in the training fold, all
filters and output weights start at random numbers.  The decision threshold is calibrated for each
language; the language is guessed from the text's own function words, never read from a column.
Scoring is one pass in Arrow batches.

Defined results: null, empty and wordless texts pool to zero and get the score of such a text;
repeated documents score alike; labels other than 0 and 1, and null ids, are not learned from; extra
columns are kept by :func:`score_toxicity`, clashing names are replaced.  An empty table gives an
empty result.  With no labelled rows of both classes the score is the (smoothed) base rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import held_out, release, shared_table, short_batches, table, tables_made
from rankloom.llm.labelled import MOD, REST, labelled_rows

#: Labelled rows of each class that are fitted at most.
MAX_ROWS = 4_000
#: Bytes of word ids that are fitted at most, half of them for each class.
MAX_BYTES = 64 << 20
THRESHOLD = 0.3
EPOCHS = 12

#: Frequent function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in that is it for with on as are this was be by",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine",
    "fr": "le la de et les des en un une du que pour dans qui est par pas sur au",
    "es": "el la de que y los las del se por con una su para es al lo como",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((int(h), k) for k, ws in enumerate(FUNCTION_WORDS.values()) for h in K.hash_words([w.encode() for w in ws.split()]))
    hashes = np.array(sorted({h for h, _ in rows}), dtype=np.uint64)
    member = np.zeros((len(hashes), len(FUNCTION_WORDS)))
    for h, k in rows:
        member[np.searchsorted(hashes, np.uint64(h)), k] += 1
    return hashes, member / member.sum(1, keepdims=True)


def guess_language(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An index into :data:`LANGUAGES` for each document."""
    known, member = _function_words()
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    votes = np.where((known[at] == h)[:, None], member[at], 0.0)
    votes = np.stack([K.sums(v, first) for v in votes.T], 1)
    return np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))


#: What weights are multiples of.
GRID = 2.0**-12

#: Rows of the embedding, and how many of them make up a word.
BUCKETS, PARTS = 1 << 18, 3


def word_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and for each its rows of the embedding."""
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1  # À to Þ
    data = data.copy()
    data[capital] += 32
    run = K.running(data)
    parts = [K.spans(run, s, np.minimum(e, s + n)) for n in (1 << 30, 4, 6)]
    salted = [K.mix(h + np.uint64(i)) % np.uint64(buckets) for i, h in enumerate(parts)]
    return parts[0], np.stack(salted, 1).astype(np.int32)


class TextCnn:
    def __init__(self, buckets: int = BUCKETS, dims: int = 16, widths: tuple[int, ...] = (1, 2, 3), filters: int = 12, seed: int = 7):
        self.widths, self.filters, self.dims = widths, filters, dims
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (buckets, dims)).astype(np.float32)
        self.conv = [rng.normal(0, 0.4, (k, dims, filters)).astype(np.float32) for k in widths]
        self.shift = np.zeros((len(widths), filters), dtype=np.float32)
        self.out = rng.normal(0, 0.3, len(widths) * filters).astype(np.float32)
        self.bias = 0.0
        self.threshold = np.zeros(len(LANGUAGES))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return (self.embed[ids[:, 0]] + self.embed[ids[:, 1]] + self.embed[ids[:, 2]]) / np.float32(PARTS)

    def pool(self, ids: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled filter outputs, and for training the word at which each one is reached (-1: none)."""
        n = len(first) - 1
        pooled, places = np.zeros((n, len(self.widths), self.filters), dtype=np.float32), []
        full = np.flatnonzero(np.diff(first))
        x = self.vectors(ids)
        stop = np.repeat(first[1:], np.diff(first))
        for i, (k, w) in enumerate(zip(self.widths, self.conv, strict=True)):
            z = np.full((len(ids), self.filters), self.shift[i])
            for j in range(k):
                z[: len(ids) - j or None] += x[j:] @ w[j] if j < len(ids) else 0
            z[np.arange(len(ids)) + k > stop] = 0
            np.maximum(z, 0, out=z)
            if len(full):
                pooled[full, i] = np.maximum.reduceat(z, first[:-1][full], axis=0)
            if where:
                at = np.full((n, self.filters), -1, dtype=np.int64)
                doc = np.repeat(np.arange(n), np.diff(first))
                row, col = np.nonzero((z == pooled[doc, i]) & (z > 0))
                at[doc[row], col] = row
                places.append(at)
        return pooled.reshape(n, -1), places

    def rounded(self) -> None:
        """Weights become multiples of ``GRID``: all sums of a margin are then exact in double precision, so their order, and with it the batch, has no effect."""
        on_grid = lambda w, most: (np.round(np.clip(w, -most, most) / GRID) * GRID).astype(w.dtype)
        self.embed = on_grid(self.embed, 64)
        self.conv, self.shift, self.out = [on_grid(w, 64) for w in self.conv], on_grid(self.shift, 64), on_grid(self.out, 64)

    def margin(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text, in double precision.  Products of numbers on the grid add up without rounding: equal texts have equal margins in any batch."""
        n, full = len(first) - 1, np.flatnonzero(np.diff(first))
        total = np.zeros(n)
        x = (self.embed[ids[:, 0]] + self.embed[ids[:, 1]] + self.embed[ids[:, 2]]).astype(np.float64)  # three times the word's vector
        stop = np.repeat(first[1:], np.diff(first))
        for i, (k, w) in enumerate(zip(self.widths, self.conv, strict=True)):
            z = np.full((len(ids), self.filters), self.shift[i] * np.float64(PARTS))
            for j in range(min(k, len(ids))):
                z[: len(ids) - j] += x[j:] @ w[j].astype(np.float64)
            z[np.arange(len(ids)) + k > stop] = 0
            if len(full):
                pooled = np.maximum(np.maximum.reduceat(z, first[:-1][full], axis=0), 0)
                total[full] += pooled @ self.out[i * self.filters : (i + 1) * self.filters].astype(np.float64)
        return total / PARTS + self.bias

    def fit(self, texts: list[np.ndarray], y: np.ndarray, language: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.1, seed: int = 11) -> TextCnn:
        base = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(base / (1 - base)))
        if len(np.unique(y)) < 2:
            self.out[:] = 0
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        check, train = order[: len(y) // 5], order[len(y) // 5 :]
        # the first dimension starts at each word's log odds, by the documents that hold it
        seen = np.zeros((2, len(self.embed)))
        for i in train:
            seen[int(y[i]), np.unique(texts[i])] += 1
        base, weight = y[train].mean(), 5.0
        share = (seen[1] + weight * base) / (seen.sum(0) + weight)
        self.embed[:, 0] = np.log(share / (1 - share)) - np.log(base / (1 - base))
        power = [np.full_like(p, 1e-2) for p in (self.embed, *self.conv, self.shift, self.out)]
        for _ in range(epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), batch):
                self._step(texts, y, train[lo : lo + batch], rate, power)
        held = check if len(np.unique(y[check])) == 2 else order
        self.rounded()
        margin = np.concatenate([self.margin(texts[i], np.array([0, len(texts[i])])) for i in held])
        whole = best_threshold(margin, y[held])
        for k in range(len(LANGUAGES)):
            own = language[held] == k
            self.threshold[k] = best_threshold(margin[own], y[held][own]) if min(y[held][own].sum(), (1 - y[held][own]).sum()) >= 30 else whole
        return self

    def _step(self, texts, y, rows, rate: float, power: list[np.ndarray]) -> None:
        first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
        ids = np.concatenate([texts[i] for i in rows])
        pooled, places = self.pool(ids, first, where=True)
        delta = (1 / (1 + np.exp(-(pooled @ self.out + self.bias))) - y[rows]).astype(np.float32)
        d_out = pooled.T @ delta / len(rows)
        d_pool = (delta[:, None] * self.out).reshape(len(rows), len(self.widths), self.filters)
        d_shift = np.zeros_like(self.shift)
        d_conv = [np.zeros_like(w) for w in self.conv]
        touched, grads = [], []
        for i, (k, at) in enumerate(zip(self.widths, places, strict=True)):
            doc, f = np.nonzero(at >= 0)
            d = d_pool[doc, i, f]
            np.add.at(d_shift[i], f, d / len(rows))
            for j in range(k):
                word = ids[at[doc, f] + j]
                np.add.at(d_conv[i][j].T, f, d[:, None] * self.vectors(word) / len(rows))
                touched += list(word.T)
                grads += [d[:, None] * self.conv[i][j].T[f] / np.float32(PARTS)] * PARTS
        word, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        d_embed = np.zeros((len(word), self.dims), dtype=np.float32)
        np.add.at(d_embed, inverse, np.concatenate(grads))
        power[0][word] += d_embed**2
        self.embed[word] -= rate * d_embed / np.sqrt(power[0][word])
        for p, g, s in zip((*self.conv, self.shift, self.out), (*d_conv, d_shift, d_out), power[1:], strict=True):
            s += g**2
            p -= rate * g / np.sqrt(s)
        self.bias -= rate * float(delta.mean())

    def score(self, h: np.ndarray, ids: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        """From 0 to 1; a text at its language's threshold scores ``threshold``."""
        at = self.threshold[guess_language(h, first)]
        z = self.margin(ids, first) - at + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def best_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin that divides best by F1, half-way between neighbours."""
    order = np.argsort(-margin, kind="stable")
    m, hits = margin[order], np.cumsum(y[order])
    if not len(m) or not hits[-1]:
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + hits[-1])
    f1[:-1][m[:-1] == m[1:]] = 0
    k = int(f1.argmax())
    return float((m[k] + m[k + 1]) / 2 if k + 1 < len(m) else m[k])


def _words_of(text: str, names: list[str], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            words, language = [], []
            for lo, hi in K.chunks(off):
                s, e, first = K.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.ALNUM)
                h, ids = word_ids(data[off[lo] : off[hi]], s, e, buckets)
                words += [ids[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                language += guess_language(h, first).tolist()
            yield pa.RecordBatch.from_arrays([*(K.string_column(batch, c) for c in names), pa.array(words, pa.binary()), pa.array(language, pa.int32())], names=[*names, "words", "language"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS, **shape) -> TextCnn:
    """A network trained on at most ``max_rows`` labelled rows of each class and ``max_bytes`` of word ids."""
    short_batches(docs.sparkSession)
    model = TextCnn(**shape)
    sample = labelled_rows(docs, labels, label, key, text, max_rows)
    sample = sample.mapInArrow(_words_of(text, ["y"], len(model.embed)), "y int, words binary, language int")
    before = tables_made()
    sample = shared_table(sample.withColumns({"at": F.xxhash64("words"), "size": F.length("words")}), "sample")
    left = {0: max_bytes // 2, 1: max_bytes // 2}
    wanted = []
    for r in sample.select("y", "at", "size").orderBy("at", "size").collect():  # at most two numbers for each row of the sample
        if r["size"] <= left[r["y"]]:
            left[r["y"]] -= r["size"]
            wanted.append((r["y"], r["at"]))
    wanted = docs.sparkSession.createDataFrame(sorted(set(wanted)), "y int, at long")
    rows = sample.join(F.broadcast(wanted), ["y", "at"]).collect()
    rows = sorted(((r["y"], bytes(r["words"]), r["language"]) for r in rows))  # any order of arrival gives the same model
    release(before)
    ids = [np.frombuffer(w, dtype=np.int32).reshape(-1, PARTS) for _, w, _ in rows]
    return model.fit(ids, np.array([r[0] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.int64), epochs)


def _scores_of(shared, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            scores = [np.zeros(0)]
            for lo, hi in K.chunks(off):
                s, e, first = K.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.ALNUM)
                h, ids = word_ids(data[off[lo] : off[hi]], s, e, len(model.embed))
                scores.append(model.score(h, ids, first))
            yield pa.RecordBatch.from_arrays([*(K.string_column(batch, c) for c in names), pa.array(np.concatenate(scores))], names=[*names, "toxicity_score"])

    return run


def score_toxicity(docs: DataFrame, model: TextCnn, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with toxicity_score, from 0 to 1; at :data:`THRESHOLD` a text counts as toxic."""
    short_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxicity_score"]
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "toxicity_score double"])
    return docs.mapInArrow(_scores_of(docs.sparkSession.sparkContext.broadcast(model), text, keep), schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))

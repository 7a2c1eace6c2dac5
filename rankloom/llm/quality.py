"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text are computed in one vectorised pass.  Small boosted trees are grown on
a bounded sample of labelled rows; every path from a root becomes a conjunctive rule; a lasso
logistic regression keeps few of them.  The rules are compiled into one Spark column expression
over the statistics.

Defined results: null and empty texts have all statistics 0 and get the score of such a text;
repeated documents score alike; labels other than 0 and 1, and null ids, are not learned from; extra
columns are kept by :func:`score_quality`, clashing names are replaced.  An empty table gives an
empty result.  With no labelled rows, or one class only, the score is the (smoothed) base rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import textkernel as K
from rankloom.llm.common import held_out, protected, short_batches, table
from rankloom.llm.labelled import MOD, REST, labelled_rows

#: Labelled rows of each class that are fitted at most.
MAX_ROWS = 10_000
THRESHOLD = 0.7

STATS = (
    "n_words", "n_lines", "word_bytes", "upper", "digits", "symbols", "pipes", "marks", "stops", "beyond_ascii", "distinct_words", "top_word",
    "distinct_lines", "distinct_pairs", "words_a_line", "words_a_stop", "letters",
)


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars.encode("latin-1"), dtype=np.uint8)] = True
    return out


_UPPER, _DIGIT, _LINE = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("0123456789"), ~_of("\n")
_SYMBOL, _PIPE, _MARK, _STOP = _of("#$%&*@^~<>{}[]=+_\\/`"), _of("|"), _of("!?"), _of(".;:")
_ALPHA = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_HIGH = np.arange(256) > 127


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of :data:`STATS` for each document; ratios are 0 where there is nothing to divide by."""
    s, e, first = K.words(data, off, K.NOT_BLANK)
    h = K.hashes(data, s, e)
    ls, le, lines = K.words(data, off, _LINE)
    n, size, n_lines = np.diff(first), np.diff(off), np.diff(lines)
    count = lambda mask: K.sums(mask[data].astype(np.int32), off)
    over = lambda a, b: np.divide(a, b, out=np.zeros(len(n)), where=b > 0)
    alpha, high, stops = count(_ALPHA), count(_HIGH), count(_STOP)
    distinct, top = K.repeats(h, first)
    pairs, at = K.shingles(h, first, 2)
    return np.stack([
        n, n_lines, over(K.sums(e - s, first), n), over(count(_UPPER), alpha), over(count(_DIGIT), size), over(count(_SYMBOL), size), over(count(_PIPE), n), over(count(_MARK), n), over(stops, n), over(high, size),
        over(distinct, n), over(top, n), over(K.repeats(K.hashes(data, ls, le), lines)[0], n_lines), over(K.repeats(pairs, at)[0], np.diff(at)), over(n, n_lines), over(n, stops), over(alpha + high, size),
    ], axis=1).astype(np.float64)


def _stats_of(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffer(K.string_column(batch, text))
            rows = [statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in K.chunks(off)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATS)))
            kept = [K.string_column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=[*names, *(f"q_{c}" for c in STATS)])

    return run


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a column ``q_<name>`` for each of :data:`STATS`."""
    short_batches(docs.sparkSession)
    own = {f"q_{c}" for c in STATS}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"q_{c} double" for c in STATS)])
    return docs.mapInArrow(_stats_of(text, keep), schema)


Condition = tuple[int, bool, float]  # statistic, whether it lies above, cut


@dataclass
class RuleEnsemble:
    """Conjunctive rules with lasso logistic weights; plain data, so it can be printed and audited."""

    trees: int = 40
    depth: int = 3
    bins: int = 32
    shrink: float = 0.2
    least: int = 10
    l1: float = 1e-3
    steps: int = 400
    bias: float = 0.0
    fitted: int = 0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        self.fitted = len(y)
        base = (y.sum() + 0.5) / (len(y) + 1)
        self.bias, self.rules = float(np.log(base / (1 - base))), []
        if len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        found: dict[tuple[Condition, ...], None] = {}
        margin = np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            self._grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), (), self.depth, margin, found)
        rules = list(found)
        hits = np.stack([self.hits(x, r) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
        weights = self._lasso(hits, y)
        self.rules = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]
        return self

    def _grow(self, binned, cuts, g, h, rows, path, depth, margin, found) -> None:
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if depth and len(rows) >= 2 * self.least:
            for k, q in enumerate(cuts):
                if not len(q):
                    continue
                b = binned[rows, k]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=len(q) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (k, int(gain.argmax())))
        if best[1] is None:
            margin[rows] += self.shrink * total_g / (total_h + 1)
            return
        k, at = best[1]
        cut = float(cuts[k][at])
        above = binned[rows, k] > at
        for side in (False, True):
            longer = (*path, (k, side, cut))
            found[tuple(sorted(longer))] = None
            self._grow(binned, cuts, g, h, rows[above == side], longer, depth - 1, margin, found)

    def _lasso(self, hits: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Proximal gradient with momentum; the bias is not penalised."""
        n = len(y)
        w, z, bias, zb, t = np.zeros(hits.shape[1]), np.zeros(hits.shape[1]), self.bias, self.bias, 1.0
        v = np.ones(hits.shape[1])
        for _ in range(20):  # largest singular value
            u = hits @ v
            v = hits.T @ u
            v /= np.linalg.norm(v) or 1
        rate = 1 / ((np.linalg.norm(hits @ v) ** 2 / n + 1) * 0.25 + 1e-9)
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-(hits @ z + zb)))
            new = z - rate * (hits.T @ (p - y)) / n
            new = np.sign(new) * np.maximum(np.abs(new) - rate * self.l1, 0)
            new_bias = zb - rate * float((p - y).mean())
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            z, zb = new + (before - 1) / t * (new - w), new_bias + (before - 1) / t * (new_bias - bias)
            w, bias = new, new_bias
        self.bias = float(bias)
        return w

    @staticmethod
    def hits(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
        return np.logical_and.reduce([(x[:, k] > cut) == above for k, above, cut in rule])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.bias - sum((w * self.hits(x, r) for r, w in self.rules), np.zeros(len(x)))))

    def column(self) -> Column:
        """The ensemble as an expression over the ``q_`` columns."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            holds = F.lit(True)
            for k, above, cut in rule:
                c = F.col(f"q_{STATS[k]}")
                holds = holds & ((c > cut) if above else (c <= cut))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """An ensemble fitted to at most ``max_rows`` labelled rows of each class."""
    sample = labelled_rows(docs, labels, label, key, text, max_rows)
    rows = np.array(with_statistics(sample, text, ["y"]).collect(), dtype=np.float64).reshape(-1, len(STATS) + 1)
    rows = rows[np.lexsort(rows.T)]  # the order in which they arrive doesn't matter
    return RuleEnsemble().fit(rows[:, 1:], rows[:, 0])


def score_quality(docs: DataFrame, model: RuleEnsemble, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with quality_score, from 0 to 1."""
    scored = with_statistics(docs, text, keep)
    return scored.withColumn("quality_score", model.column()).drop(*(f"q_{c}" for c in STATS))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with their own columns; all of them if no label told what is good."""
    if not model.fitted:
        return docs
    return protected(docs, (text,), lambda d: score_quality(d, model, text).where(F.col("quality_score") >= threshold))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

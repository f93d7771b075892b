"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the sample. Boosting goes round the features in turn: each step fits a
tree of at most four leaves to the gradient along one feature and adds it, shrunk, to that feature's lookup table.
Then the pairs whose quadrants explain most of what is left get tables of their own, boosted in turn with one cut on
each axis. A score is the sum of a text's table entries, put through the logistic function.

The model is fitted on the driver from at most SAMPLE labelled rows (those with the least hash of their id).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import add_columns, utf8

SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, PRIOR = 32, 120, 60, 6, 0.12, 5.0
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "log_words", "mean_word", "upper_share", "symbol_share", "bang_share", "digit_share", "line_words", "ended_lines",
    "distinct_share", "short_share", "repeated_lines", "pipe_share", "comma_share", "stop_share", "long_word", "non_ascii",
)


def features(text: bytes) -> list[float]:
    """Counts of the whole text; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    without = lambda chars: size - len(text.translate(None, chars))
    lengths = list(map(len, words))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return [
        math.log(n), sum(lengths) / n, without(UPPER) / size, without(b"#*$%&|<>") / size, text.count(b"!") / n, without(b"0123456789") / size,
        math.log(n / len(lines)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), len(set(words)) / n ** 0.85, sum(x < 4 for x in lengths) / n,
        1 - len(set(lines)) / len(lines), text.count(b"|") / n, text.count(b",") / n, text.count(b".") / n, math.log(max(lengths)), 0.0 if text.isascii() else 1 - without(bytes(range(128))) / size,
    ]


def _vector(column) -> np.ndarray:
    texts = utf8(column)
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient and curvature sums."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + PRIOR) + (all_g - left_g) ** 2 / (all_h - left_h + PRIOR) - all_g**2 / (all_h + PRIOR)
    if not len(gain):
        return 0.0, 0
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with up to three cuts."""
    leaves = [(0, len(g))]
    for _ in range(3):
        cuts = [(*_best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(leaves)]
        gain, at, k = max(cuts)
        if gain <= 1e-9:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PRIOR)
    return out


class Additive:
    """edges by feature, a table by feature, and tables by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        width = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(rate / (1 - rate))
        if not len(y) or y.min() == y.max():
            return
        bins = self._bins(x)
        at = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f in range(width):
                p = 1 / (1 + np.exp(-at))
                n = len(self.tables[f])
                step = RATE * _tree(np.bincount(bins[f], y - p, n), np.bincount(bins[f], p * (1 - p), n))
                self.tables[f] += step
                at += step[bins[f]]
        gains = sorted((self._quadrants(bins, at, y, a, b)[0], a, b) for a in range(width) for b in range(a))
        for _, a, b in gains[::-1][:PAIRS]:
            self.pairs[a, b] = np.zeros((len(self.tables[a]), len(self.tables[b])))
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in self.pairs.items():
                step = RATE * self._quadrants(bins, at, y, a, b)[1]
                table += step
                at += step[bins[a], bins[b]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def _quadrants(self, bins, at, y, a: int, b: int) -> tuple[float, np.ndarray]:
        """Gain and table of the pair's best single cuts taken together."""
        p = 1 / (1 + np.exp(-at))
        shape = len(self.tables[a]), len(self.tables[b])
        cell = bins[a] * shape[1] + bins[b]
        g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
        h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        gain = np.zeros(shape)
        for part_g, part_h in (
            (cg, ch), (cg[:, -1:] - cg, ch[:, -1:] - ch), (cg[-1:] - cg, ch[-1:] - ch),
            (cg[-1, -1] - cg[:, -1:] - cg[-1:] + cg, ch[-1, -1] - ch[:, -1:] - ch[-1:] + ch),
        ):
            gain += part_g**2 / (part_h + PRIOR)
        i, j = np.unravel_index(gain.argmax(), shape)
        table = np.zeros(shape)
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for columns in (slice(0, j + 1), slice(j + 1, None)):
                table[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + PRIOR)
        return float(gain[i, j]), table

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        at = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins):
            at += table[b]
        for (a, b), table in self.pairs.items():
            at += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-at))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Additive:
    """The model of at most `sample` labelled rows that are not held out; rows without a label don't count.

    An id that several documents or labels have gives a row for each pair of them, of at most `sample` in all.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("labelled_id"), F.col(label).cast("double").alias("label_of_it"))
    some = known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample)
    texts = docs.select(doc_id, text).join(F.broadcast(some), F.col(doc_id) == F.col("labelled_id"))
    made = add_columns(texts.select("labelled_id", "label_of_it", text), [text], lambda c: [_vector(c).tolist()], "x array<double>", drop=(text,))
    made = made.orderBy(F.xxhash64("labelled_id"), "labelled_id", "x").limit(sample).toArrow()  # an id may stand in many rows
    y = made.column("label_of_it").to_numpy()
    x = np.array(made.column("x").combine_chunks().flatten().to_numpy()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, made.column("labelled_id").to_numpy()))  # the same model whatever order rows come in
    return Additive(x[order], y[order])


def score(docs: DataFrame, model: Additive, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column):
        if not len(column):
            return [[], []]
        p = shared.value.score(_vector(column))
        return [p.tolist(), (p >= 0.5).astype(int).tolist()]

    return add_columns(docs, [text], run, "score double, predicted int", drop)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, drop=("text",)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

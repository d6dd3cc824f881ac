"""Quality of a text: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and so have a few pairs of features. The
tables are learned by cyclic boosting: the features take turns, and each turn adds a shallow tree
on one feature; then the pairs take turns with trees on two. A score is the sum of table entries
through the logistic function.

A null text counts as empty; an empty text has features (all zero) and a score like any other.
Without labelled rows, or with labels of one kind only, every score is the share of good labels,
0.5 if there are none. A document with several labels is learned from once per label, one with
a null label never. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from eddyfield.llm.common import held_out
from eddyfield.session import settle

FEATURES = [
    "log_bytes", "upper", "digit", "space", "newline", "sentence_mark", "bar", "symbol", "non_ascii",
    "log_words", "word_length", "short_words", "distinct_words", "top_word", "repeated_lines", "line_length",
]
BINS, PAIRS, RATE, ROUNDS, PAIR_ROUNDS, RIDGE = 32, 6, 0.1, 150, 60, 1.0

_byte = np.arange(256)
_CLASSES = [
    (_byte >= 65) & (_byte <= 90),
    (_byte >= 48) & (_byte <= 57),
    (_byte == 32) | ((_byte >= 9) & (_byte <= 13)),
    _byte == 10,
    np.isin(_byte, list(b".,;:?!")),
    _byte == ord("|"),
    np.isin(_byte, list(b"#$%&*+<>=@\\^_`{}~")),
    _byte >= 128,
]
_SUMS = np.array(_CLASSES, dtype="float64").T


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    shares = np.bincount(np.frombuffer(raw, "uint8"), minlength=256) @ _SUMS / len(raw)
    words = raw.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    return [
        np.log1p(len(raw)),
        *shares,
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        sum(times for word, times in counts.items() if len(word) <= 3) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def features_of(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


@dataclass
class Additive:
    """Tables of the model. ``edges`` cut a feature into bins; a pair uses every fourth edge."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[b[:, i] // 4, b[:, j] // 4]
        return 1 / (1 + np.exp(-total))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of consecutive bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE)
    best = int(np.argmax(gain))
    return float(gain[best] - g.sum() ** 2 / (h.sum() + RIDGE)), best + 1


def _leaves(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of ``depth`` over consecutive bins: the step of each bin."""
    gain, at = _cut(g, h)
    if depth == 0 or gain <= 1e-9:
        return np.full(len(g), RATE * g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_leaves(g[:at], h[:at], depth - 1), _leaves(g[at:], h[at:], depth - 1)])


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts the first feature and then each half by the second: gain and steps. All first
    cuts are tried, since one alone may gain nothing."""
    best, cells = -1.0, []
    for at in range(len(g) + 1):
        gain, found = 0.0, []
        for rows in (slice(0, at), slice(at, len(g))):
            if g[rows].size:
                more, cut = _cut(g[rows].sum(axis=0), h[rows].sum(axis=0))
                gain += more + g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
                found += [(rows, slice(0, cut)), (rows, slice(cut, g.shape[1]))]
        if gain > best:
            best, cells = gain, found
    step = np.zeros_like(g)
    for cell in cells:
        if g[cell].size:
            step[cell] = RATE * g[cell].sum() / (h[cell].sum() + RIDGE)
    return best - g.sum() ** 2 / (h.sum() + RIDGE), step


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    d = len(FEATURES)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.zeros(0) for j in range(d)]
    model = Additive(np.log(share / (1 - share)), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = _leaves(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
            table += step
            total += step[b[:, j]]
    coarse = b // 4
    sizes = coarse.max(axis=0) + 1

    def cells(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * sizes[j] + coarse[:, j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = {(i, j): _quarters(cells(i, j, g), cells(i, j, h))[0] for i in range(d) for j in range(i + 1, d)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    # as wide as a bin number of any text can be
    model.pair_tables = [np.zeros((len(edges[i]) // 4 + 1, len(edges[j]) // 4 + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            _, step = _quarters(cells(i, j, g), cells(i, j, h))
            table[: sizes[i], : sizes[j]] += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, features) of every document, settled: texts are read once."""
    return settle(docs.select("doc_id", held_out().alias("held_out"), features_of("text").alias("features")), "quality")


def learn(measured: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Additive:
    """Fit on a bounded sample: about ``max_rows`` labelled rows that are not held out, drawn by a hash
    of their id. Only features travel, no text."""
    known = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"))
    rows = measured.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("labelled"))
    share = max_rows / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = rows.select("doc_id", "features", "y").toPandas().sort_values(["doc_id", "y"])
    x = np.array(sample["features"].tolist(), dtype="float64").reshape(len(sample), len(FEATURES))
    return fit(x, sample["y"].to_numpy(dtype="float64"))


def score_of(model: Additive) -> Column:
    """Score of a column ``features``: vectorised additions of table entries."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), dtype="float64").reshape(len(rows), len(FEATURES))))

    return score("features")

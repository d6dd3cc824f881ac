"""Language of a text: word-first backoff.

A word that the model knows scores by its log frequency in every language. A word that it does
not know is scored by its longest character n-grams that the model knows: five characters, else
four, and so down to one. The scores of a text's words add up.

A null text, or one without a letter, is ``und`` with score 0; so is every text when no labelled
row exists. Ties go to the first language in order. Rows with a null text or lang are not learned
from. Extra columns are not read; repeated rows are judged alike; any length of text is read whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.llm.common import held_out
from eddyfield.session import rows_per_batch, settle

UNKNOWN = "und"
LONGEST = 5
LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 200_000  # unseen words that a worker remembers
COUNTED_TOGETHER = 2000  # texts whose words and n-grams a task holds at once
EVIDENCE = 16  # words that count as independent of each other


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)  # by length - 1
    table: np.ndarray | None = None  # log frequencies: a row per word or n-gram, a column per language


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words[lang].update(LETTERS.findall(text.lower()))
        for lang, counts in words.items():
            sums = [counts] + [Counter() for _ in range(LONGEST)]
            for word, times in counts.items():
                for n in range(1, LONGEST + 1):
                    for gram in _grams(word, n):
                        sums[n][gram] += times
            for n, found in enumerate(sums):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array([n] * len(found), pa.int32()), pa.array(list(found)), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "n", "gram", "times"],
                )


def learn(docs: DataFrame, max_rows: int = 2000, max_words: int = 30_000, max_grams: int = 5000) -> Model:
    """Fit on a bounded sample: of every language about ``max_rows`` labelled documents, drawn by a hash of
    their id from those that are not held out, and from them the ``max_words`` commonest words and
    ``max_grams`` commonest n-grams of each length. A rare language is learned at every size of the table."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    # settled, so that its size is known and no text is shuffled to it: a row per language
    shares = settle(rows.groupBy(F.col("lang").alias("of")).agg((F.lit(float(max_rows)) / F.count(F.lit(1))).alias("share")), "shares")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    rows = rows.join(shares, F.col("lang") == F.col("of")).filter(draw < F.col("share"))
    counts = (
        rows.select("lang", "text")
        .mapInArrow(_count, "lang string, n int, gram string, times long")
        .groupBy("lang", "n", "gram")
        .agg(F.sum("times").alias("times"))
    )
    first = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram")
    kept = counts.withColumn("rank", F.row_number().over(first)).withColumn("all", F.sum("times").over(Window.partitionBy("lang", "n")))
    kept = kept.filter(F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
    with rows_per_batch(docs.sparkSession, COUNTED_TOGETHER):
        found = kept.select("lang", "n", "gram", "times", "all").toPandas()
    model = Model(sorted(found["lang"].unique()), grams=[{} for _ in range(LONGEST)])
    column = {lang: i for i, lang in enumerate(model.languages)}
    total = {(n, lang): whole for lang, n, whole in found[["lang", "n", "all"]].drop_duplicates().itertuples(index=False)}
    rows_of: list[np.ndarray] = []
    for n, part in found.groupby("n"):
        names, where = np.unique(part["gram"].to_numpy(dtype=object), return_inverse=True)
        seen = np.full((len(names), len(column)), 0.5)
        np.add.at(seen, (where, part["lang"].map(column).to_numpy()), part["times"].to_numpy())
        whole = np.array([total.get((n, lang), 0) for lang in model.languages]) + 0.5 * len(names)
        target = model.words if n == 0 else model.grams[n - 1]
        base = sum(map(len, rows_of))
        target.update({name: base + i for i, name in enumerate(names)})
        rows_of.append(np.log(seen / whole))
    model.table = np.concatenate(rows_of).astype("float32") if rows_of else np.zeros((0, 0), "float32")
    return model


def word_score(model: Model, word: str) -> np.ndarray:
    """Log frequencies of an unseen word in every language, by its longest known n-grams."""
    for n in range(LONGEST, 0, -1):
        known = [model.grams[n - 1][g] for g in _grams(word, n) if g in model.grams[n - 1]]
        if known:
            return model.table[known].mean(axis=0)
    return np.zeros(len(model.languages), "float32")


class _Detector:
    """Judges texts by a model, which is shared and not copied; the rows of unseen words come after its own."""

    def __init__(self, model: Model):
        self.model = model
        self.base = len(model.table)
        self._clear()

    def _clear(self) -> None:
        self.unseen: dict[str, int] = {}
        self.table = np.empty((1000, len(self.model.languages)), "float32")

    def _row(self, word: str) -> int:
        place = len(self.unseen)
        if place == len(self.table):  # full
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[place] = word_score(self.model, word)
        self.unseen[word] = self.base + place
        return self.base + place

    def _rows(self, places: list[int]) -> np.ndarray:
        at = np.array(places)
        own = at < self.base
        out = np.empty((len(at), self.table.shape[1]), "float32")
        out[own] = self.model.table[at[own]]
        out[~own] = self.table[at[~own] - self.base]
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        counts = Counter(words)
        for word in [w for w in counts if not w.isalpha() and not any(map(str.isalpha, w))]:
            del counts[word]  # number signs only
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.unseen) > CACHE // 2:
            self._clear()
        known, unseen = self.model.words, self.unseen
        rows = [known[w] if w in known else unseen[w] if w in unseen else self._row(w) for w in counts]
        sums = np.fromiter(counts.values(), "float64", len(rows)) @ self._rows(rows)
        sums *= min(1.0, EVIDENCE / counts.total())
        chances = np.exp(sums - sums.max())
        best = int(np.argmax(chances))
        return self.model.languages[best], float(chances[best] / chances.sum())


def detect(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(lang, score) of the text column. The model is bounded by the limits of ``learn``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = _Detector(shared.value)
        for texts in batches:
            yield pd.DataFrame([detector(t) for t in texts], columns=["lang", "score"])

    return judge(F.col(text))

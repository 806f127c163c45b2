"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import whole_text
from lettermill.llm.samples import labelled_sample
from lettermill.llm.tokens import Memory

SLOTS = 1 << 18
SAMPLE = 6000
KEEP_AT = 0.5
REMEMBERED = 100_000
_RUNS = [(re.compile(p), s) for p, s in ((r"[^\W\d_a-zß-öø-ÿ]+", "A"), (r"[^\W\d_A]+", "a"), (r"\d+", "0"))]


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def shape(word: str) -> str:
    """A word's runs of capitals, other letters and digits as A, a and 0; other signs stay."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:8]


def word_slots(word: str) -> tuple[int, int, int]:
    return slot("w" + word.lower()), slot("s" + shape(word)), slot("e" + word[-3:])


def text_slots(words: list[str]) -> list[int]:
    """Slots for the whole text: its length, repeats of the word before, variety."""
    n = len(words)
    size = n.bit_length()
    repeats = sum(map(eq, words, words[1:])) / n if n else 0.0
    variety = len(set(words)) / n if n else 1.0
    return [slot(f"n{size}"), slot(f"r{int(10 * repeats)}"), slot(f"v{size},{int(10 * variety)}")]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: slots and values (shares of words, or 1)."""
    words = text.split()
    found: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for s in word_slots(word):
            found[s] += n / len(words)
    for s in text_slots(words):
        found[s] += 1.0
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds: P(grade >= k) = sigmoid(score - threshold k)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one column each."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int,
    epochs: int = 20, batch: int = 128, rate: float = 0.3, decay: float = 1e-6, seed: int = 7,
) -> OrdinalModel:
    """Maximum likelihood by AdaGrad. Thresholds stay ordered: each is the one before plus an exponential.

    Without rows every tail probability is a half; grades that no row has are
    given the least probability.
    """
    weights, bias = np.zeros(SLOTS, np.float64), np.zeros(n_grades - 1)
    if not len(rows):
        return OrdinalModel(weights, np.zeros(n_grades - 1))
    share = np.array([np.mean(grades >= k) for k in range(1, n_grades)]).clip(0.001, 0.999)
    thresholds = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(thresholds), 0.05))
    bias[0], bias[1:] = thresholds[0], gaps
    squares, bias_squares = np.full(SLOTS, 1e-8), np.full(n_grades - 1, 1e-8)
    order, random = np.arange(len(rows)), np.random.default_rng(seed)

    def cuts() -> np.ndarray:
        return bias[0] + np.concatenate([[0.0], np.cumsum(np.exp(bias[1:]))])

    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            slots = np.concatenate([rows[i][0] for i in some])
            values = np.concatenate([rows[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            score = np.bincount(owner, weights[slots] * values, len(some))
            below = np.concatenate([[-np.inf], cuts(), [np.inf]])
            y = grades[some]
            # P(y) = upper - lower, each the probability of a lower grade at a cut.
            upper, lower = _sigmoid(below[y + 1] - score), _sigmoid(below[y] - score)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper), lower * (1 - lower)
            error = (up - low) / p / len(some)
            gradient = np.bincount(slots, error[owner] * values, SLOTS)
            touched = np.unique(slots)
            g = gradient[touched] + decay * weights[touched]
            squares[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(squares[touched])
            by_cut = np.zeros(n_grades + 1)
            np.add.at(by_cut, y + 1, -up / p / len(some))
            np.add.at(by_cut, y, low / p / len(some))
            inner = by_cut[1:-1]
            b = np.array([inner[k:].sum() for k in range(n_grades - 1)])
            b[1:] *= np.exp(bias[1:])
            bias_squares += b * b
            bias[:] -= 0.1 * b / np.sqrt(bias_squares)
    return OrdinalModel(weights, cuts())


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> OrdinalModel:
    """A model from ``ratings`` (``doc_id``, ``label`` from 0) of at most ``sample`` documents."""

    @F.pandas_udf("struct<slots:binary,shares:binary>")
    def packed(texts: pd.Series) -> pd.DataFrame:
        both = [features(t) for t in texts]
        return pd.DataFrame({"slots": [a.tobytes() for a, _ in both], "shares": [b.tobytes() for _, b in both]})

    rows = labelled_sample(docs, ratings, sample).select("doc_id", "label", packed("text").alias("f")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    both = [(np.frombuffer(r["f"]["slots"], np.int32), np.frombuffer(r["f"]["shares"], np.float32)) for r in rows]
    grades = np.array([min(max(r["label"], 0), n_grades - 1) for r in rows], np.int64)
    return fit_ordinal(both, grades, n_grades)


def score_texts(weights: np.ndarray):
    """A function from texts to scores, whose word weights are remembered."""
    of_word = Memory(lambda w: float(weights[list(word_slots(w))].sum()), REMEMBERED)

    def score(texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            words = text.split()
            mean = sum(map(of_word.__getitem__, words)) / len(words) if words else 0.0
            out[k] = mean + weights[text_slots(words)].sum()
        return out

    return score


def quality_column(docs: DataFrame, model: OrdinalModel):
    """A column function from text to ``expected`` grade and ``tails`` (P(grade >= 1), ...)."""
    # Bounded: a weight for each slot.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected:double,tails:array<double>>")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = score_texts(shared.value.weights)
        for texts in batches:
            tails = shared.value.tails(score(texts)).round(6)
            yield pd.DataFrame({"expected": tails.sum(1).round(6), "tails": list(tails)})

    return graded


def quality_scores(docs: DataFrame, model: OrdinalModel, at_least: int = 1, keep_at: float = KEEP_AT) -> DataFrame:
    """``doc_id``, ``expected`` grade, ``tail`` = P(grade >= ``at_least``) and ``keep`` of every row.

    Whole texts are read; null and empty texts are scored by the features of a
    text without words. Repeated rows are scored each; other columns are
    ignored; no documents, no rows.
    """
    graded = quality_column(docs, model)(whole_text(docs))
    rows = docs.select(docs["doc_id"].alias("doc_id"), graded.alias("g"))
    rows = rows.select("doc_id", "g.expected", F.element_at("g.tails", at_least).alias("tail"))
    return rows.withColumn("keep", F.col("tail") >= keep_at)


def keep_quality(docs: DataFrame, model: OrdinalModel, at_least: int = 1, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches ``keep_at``, all columns kept."""
    graded = quality_column(docs, model)(whole_text(docs))
    return docs.filter(F.element_at(graded.getField("tails"), at_least) >= keep_at)

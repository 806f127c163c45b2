"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import store, whole_text
from lettermill.llm.samples import is_held_out, labelled_sample
from lettermill.llm.tokens import Memory

SLOTS = 1 << 20
FACTORS = 4
SAMPLE = 8000
LEAST_TEXTS = 5
LEAST_Z = 2.5
PREDICT_AT = 0.3
REMEMBERED = 300_000
_WORD = re.compile(r"\w+")


def terms(text: str) -> set[str]:
    """The different words of a whole text, lower-cased."""
    return set(_WORD.findall(text.lower()))


def term_slots(term: str) -> list[int]:
    """The hashed features of a term: itself and its beginnings of 4 to 8 letters."""
    parts = ["w" + term, *("p" + term[:k] for k in range(4, 9) if len(term) > k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts]


@dataclass
class FactorModel:
    """Bias, and a row for each slot in use: its weight and its factors. Row 0 is zero."""

    bias: float
    rows: dict[int, int]
    table: np.ndarray

    def term_row(self, term: str) -> np.ndarray | None:
        """A term's weight, factors and square of the factors' length; None without a slot in use."""
        found = [r for r in map(self.rows.get, term_slots(term)) if r]
        if not found:
            return None
        out = np.empty(self.table.shape[1] + 1, np.float32)
        out[:-1] = self.table[found].sum(0)
        out[-1] = out[1:-1] @ out[1:-1]
        return out


def slot_counts(texts, labels) -> np.ndarray:
    """How many texts with label 0, and with label 1, have each slot."""
    seen = np.zeros((2, SLOTS), np.int64)
    for text, label in zip(texts, labels, strict=True):
        own = {s for t in terms(text) for s in term_slots(t)}
        seen[int(label), np.fromiter(own, np.int64, len(own))] += 1
    return seen


def screen_score(zeros, ones, n_zeros, n_ones):
    """By how many standard errors a slot's share of texts differs between the labels."""
    mean = (zeros + ones) / (n_zeros + n_ones)
    spread = mean * (1 - mean) * (1 / n_zeros + 1 / n_ones)
    return (ones / n_ones - zeros / n_zeros) / spread**0.5


def pack_text(text: str, rows: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A text's slots in use as rows of the table, term by term, and how many each term has."""
    kept = [[rows[s] for s in term_slots(t) if s in rows] for t in sorted(terms(text))]
    kept = [k for k in kept if k]
    return np.array([r for k in kept for r in k], np.int32), np.array([len(k) for k in kept], np.int32)


def constant_model(share: float, factors: int = FACTORS) -> FactorModel:
    """For labels of one kind only, or none: every score is their share."""
    return FactorModel(30.0 if share else -30.0, {}, np.zeros((1, factors + 1), np.float32))


def fit_factors(
    packed: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rows: dict[int, int], factors: int = FACTORS,
    epochs: int = 15, batch: int = 64, rate: float = 0.1, ridge: float = 1e-4, seed: int = 11,
) -> FactorModel:
    """Logistic loss by AdaGrad, from packed texts.

    A text's score is the bias, the weights of its terms, and the products of
    the factors of every two of its terms; a term's weight and factors are the
    sums over its slots.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return constant_model(share, factors)
    random = np.random.default_rng(seed)
    table = np.zeros((len(rows) + 1, factors + 1))
    table[1:, 1:] = random.normal(0, 0.02, (len(rows), factors))
    squares = np.full_like(table, 1e-6)
    bias, bias_square = float(np.log(share / (1 - share))), 1e-6
    order = np.arange(len(packed))
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), batch):
            some = [i for i in order[at : at + batch] if len(packed[i][0])]
            if not some:
                continue
            slots = np.concatenate([packed[i][0] for i in some])
            sizes = np.concatenate([packed[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(packed[i][1]) for i in some])
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            term = np.add.reduceat(table[slots], firsts, axis=0)
            starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(some)))[:-1]])
            total = np.add.reduceat(term, starts, axis=0)
            own = np.add.reduceat((term[:, 1:] ** 2).sum(1), starts)
            score = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - own)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
            by_term = np.empty_like(term)
            by_term[:, 0] = error[owner]
            by_term[:, 1:] = error[owner][:, None] * (total[owner, 1:] - term[:, 1:])
            used, place = np.unique(slots, return_inverse=True)
            spread = np.repeat(by_term, sizes, axis=0)
            g = np.stack([np.bincount(place, spread[:, c], len(used)) for c in range(factors + 1)], 1)
            g += ridge * table[used]
            squares[used] += g * g
            table[used] -= rate * g / np.sqrt(squares[used])
            bias_square += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_square)
    return FactorModel(bias, rows, table.astype(np.float32))


def score_texts(model: FactorModel, remembered: int = REMEMBERED):
    """A function from texts to scores between 0 and 1. Terms' rows are remembered, up to a bound."""
    held = np.zeros((1024, model.table.shape[1] + 1), np.float32)
    used = 1  # row 0: terms without a slot in use

    def place(term: str) -> int:
        nonlocal held, used
        row = model.term_row(term)
        if row is None:
            return 0
        if used == len(held):
            held = np.concatenate([held, np.zeros_like(held)])
        held[used] = row
        used += 1
        return used - 1

    places = Memory(place, remembered)

    def score(texts) -> np.ndarray:
        nonlocal used
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            if used > remembered:
                places.clear()
                places.older = {}
                used = 1
            words = terms(text)
            at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
            total = held[np.sort(at[at > 0])].sum(0, dtype=np.float64)
            out[k] = model.bias + total[0] + 0.5 * (total[1:-1] @ total[1:-1] - total[-1])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    return score


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z,
) -> FactorModel:
    """A model from ``labels`` (``doc_id``, ``label`` 0 or 1) of at most ``sample`` documents.

    Slots are used that ``least_texts`` texts have and whose share of texts
    differs between the labels by ``least_z`` standard errors: without that the
    few labelled texts would be learned by heart. The executors count and choose
    them; only the chosen slots, and which of them each text has, come to the driver.
    """
    rows = store(labelled_sample(docs, labels, sample), "sample")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    zeros, ones = totals.get(0, 0), totals.get(1, 0)
    if not zeros or not ones:
        return constant_model(1.0 if ones else 0.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            seen += slot_counts(batch["text"], batch["label"])
        there = np.flatnonzero(seen.sum(0))
        yield pd.DataFrame({"slot": there, "zeros": seen[0, there], "ones": seen[1, there]})

    counts = rows.mapInPandas(count, "slot long, zeros long, ones long").groupBy("slot")
    counts = counts.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    score = screen_score(F.col("zeros"), F.col("ones"), F.lit(zeros), F.lit(ones))
    enough = counts.filter((F.col("zeros") + F.col("ones")).between(least_texts, zeros + ones - 1))
    chosen = sorted(r["slot"] for r in enough.filter(F.abs(score) >= least_z).select("slot").collect())
    places = {slot: k for k, slot in enumerate(chosen, 1)}
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("struct<slots:binary,sizes:binary>")
    def packed(texts: pd.Series) -> pd.DataFrame:
        both = [pack_text(t, shared.value) for t in texts]
        return pd.DataFrame({"slots": [a.tobytes() for a, _ in both], "sizes": [b.tobytes() for _, b in both]})

    found = rows.select("doc_id", "label", packed("text").alias("p")).collect()
    found.sort(key=lambda r: r["doc_id"])
    arrays = [tuple(np.frombuffer(r["p"][c], np.int32) for c in ("slots", "sizes")) for r in found]
    return fit_factors(arrays, np.array([r["label"] for r in found], np.float64), places)


def toxicity(docs: DataFrame, model: FactorModel, predict_at: float = PREDICT_AT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Only the text is read, whole; null and empty texts get the score of a text
    without terms. Repeated rows are scored each; no documents, no rows.
    """
    # Bounded by the slots that the bounded sample uses.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = score_texts(shared.value)
        for texts in batches:
            yield pd.Series(score(texts).round(6))

    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        is_held_out(docs["doc_id"]).alias("held_out"),
        scored(whole_text(docs)).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= predict_at).cast("int"))

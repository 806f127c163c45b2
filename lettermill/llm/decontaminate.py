"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.align import MATCH, local_align, local_score, score_bound
from lettermill.llm.common import whole_text

SEED_WORDS = 3
SPREAD = 1
LEAST = 0.4
PASSAGE = 30
BLOCK_CHARS = 16_000_000
_WORD = re.compile(r"\w+")
_FOUND = "array<struct<item_id:long,score:double,matched:int,item_words:int,first_word:int,end_word:int>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """A block of test items: their words as numbers, and the n-grams in them."""

    ids: list[int]
    words: list[list[int]]
    vocabulary: dict[str, int]
    grams: np.ndarray  # sorted keys of all n-grams
    size: int

    @classmethod
    def of(cls, rows: Sequence[tuple[int, str]], size: int) -> Items:
        vocabulary: dict[str, int] = {}
        words = [[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)] for _, text in rows]
        items = cls([i for i, _ in rows], words, vocabulary, np.zeros(0, np.uint64), size)
        keys = [items.keys(np.array(w, np.int64)) for w in words]
        items.grams = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]))
        return items

    def keys(self, words: np.ndarray) -> np.ndarray:
        """A number for each n-gram. Different n-grams may share one; alignment tells."""
        n = max(0, len(words) - self.size + 1)
        key = np.zeros(n, np.uint64)
        for k in range(self.size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64) + np.uint64(1)
        return key

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text as the items number them; -1 for words in no item."""
        found = words_of(text)
        return np.fromiter(map(self.vocabulary.get, found, [-1] * len(found)), np.int64, len(found))

    def hits(self, numbers: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, indexes in ``grams``) of its n-grams that are among ``grams``."""
        n = len(numbers) - self.size + 1
        if n <= 0 or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = numbers >= 0
        whole = known[:n].copy()
        for k in range(1, self.size):
            whole &= known[k : k + n]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.uint64)
        for k in range(self.size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + numbers[at + k].astype(np.uint64) + np.uint64(1)
        place = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        same = grams[place] == key
        return at[same], place[same]


def rare_seeds(items: Items, counts: np.ndarray, spread: int = SPREAD) -> dict[int, list[tuple[int, int]]]:
    """Seed key -> (item, place in it).

    Of every ``spread`` n-grams in a row the one that the corpus has least
    often is a seed, so a copied run of ``spread + size - 1`` words always has
    one, however often the corpus repeats it. A ``spread`` of 1 makes every
    n-gram a seed; a greater one loses edited copies, of which the rarest
    n-grams are those that the edits broke.
    """
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, words in enumerate(items.words):
        keys = items.keys(np.array(words, np.int64))
        often = counts[np.searchsorted(items.grams, keys)]
        chosen = set()
        for at in range(max(1, len(keys) - spread + 1) if len(keys) else 0):
            part = often[at : at + spread]
            chosen.add(at + int(np.argmin(part)))
        for at in sorted(chosen):
            seeds[int(keys[at])].append((item, at))
    return dict(seeds)


def corpus_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often the whole corpus has each n-gram of the items (a pass over all texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        total = np.zeros(len(own.grams), np.int64)
        for batch in batches:
            for text in batch["text"]:
                _, found = own.hits(own.numbers(text), own.grams)
                np.add.at(total, found, 1)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"gram": there, "n": total[there]})

    rows = docs.select(whole_text(docs).alias("text")).mapInPandas(count, "gram long, n long")
    counts = np.zeros(len(items.grams), np.int64)
    for row in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # as many as the items have
        counts[row["gram"]] = row["n"]
    return counts


def _windows(starts: list[int], length: int, slack: int) -> Iterator[tuple[int, int]]:
    """The passages that reach ``slack`` words beyond copies with these starts; those that overlap are one."""
    low, until = max(0, starts[0] - slack), starts[0] + length + slack
    for start in starts[1:]:
        if start - slack > until:
            yield low, until
            low = max(0, start - slack)
        until = start + length + slack
    yield low, until


def match_text(text: str, items: Items, grams: np.ndarray, seeds: list, least: float, passage: int = PASSAGE) -> list[dict]:
    """The best alignment of each item in one text that reaches ``least``, or scores as ``passage`` copied words do."""
    numbers = items.numbers(text)
    at, found = items.hits(numbers, grams)
    diagonals: dict[int, set[int]] = defaultdict(set)
    for place, gram in zip(at.tolist(), found.tolist(), strict=True):
        for item, start in seeds[gram]:
            diagonals[item].add(place - start)
    out = []
    for item, starts in sorted(diagonals.items()):
        words = items.words[item]
        own, length = np.array(words, np.int64), len(words)
        enough = MATCH * min(least * length, passage)
        # As many words as an alignment that scores enough can have beyond the item's.
        slack = max(0, int(MATCH * length - enough))
        best = (0, 0, 0, 0)
        for start in sorted(starts):
            if start >= 0 and numbers[start : start + length].tolist() == words:
                best = (MATCH * length, length, start, start + length)
                break
        else:
            for low, until in _windows(sorted(starts), length, slack):
                window = numbers[low:until]
                if score_bound(own, window) < enough or local_score(own, window) < max(enough, best[0] + 1):
                    continue
                score, same, first, end = local_align(words, window.tolist())
                best = (score, same, low + first, low + end)
        if best[0] and best[0] >= enough:
            out.append(
                {
                    "item_id": items.ids[item], "score": round(best[0] / (MATCH * length), 6), "matched": best[1],
                    "item_words": length, "first_word": best[2], "end_word": best[3],
                }
            )
    return out


def item_blocks(benchmark: DataFrame, size: int = SEED_WORDS, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The test items in blocks of at most ``block_chars`` characters (one item at least)."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), whole_text(benchmark).alias("text"))
    block: list[tuple[int, str]] = []
    held = 0
    for row in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        if block and held + len(row["text"]) > block_chars:
            yield Items.of(block, size)
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if block:
        yield Items.of(block, size)


def matcher(docs: DataFrame, items: Items, spread: int = SPREAD, least: float = LEAST, passage: int = PASSAGE):
    """A column function from text to the items found in it."""
    counts = corpus_counts(docs, items) if spread > 1 else np.zeros(len(items.grams), np.int64)
    seeds = rare_seeds(items, counts, spread)
    grams = np.array(sorted(seeds), np.uint64)
    lists = [seeds[int(g)] for g in grams]
    shared = docs.sparkSession.sparkContext.broadcast((items, grams, lists))

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, keys, places = shared.value
        for texts in batches:
            yield pd.Series([match_text(t, own, keys, places, least, passage) for t in texts], dtype=object)

    return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SEED_WORDS, spread: int = SPREAD,
    least: float = LEAST, block_chars: int = BLOCK_CHARS, passage: int = PASSAGE,
) -> DataFrame:
    """Test items found in documents: ``doc_id``, ``item_id``, ``score``, ``matched``,
    ``item_words``, ``first_word``, ``end_word``.

    ``score`` is the local alignment score over that of a full copy, 0 to 1;
    rows reach ``least``, or the score of ``passage`` words copied in a row
    however long the item is. One row per document row and item, for its best
    passage; words are counted from 0. Every passage with ``size`` unedited
    words in a row is aligned, however often the corpus has them. Items of fewer than ``size`` words and
    null or empty texts match nothing; repeated rows and repeated ids give
    their rows each; other columns are ignored. The items are taken in blocks
    of bounded size, each against all documents.
    """
    out = None
    for items in item_blocks(benchmark, size, block_chars):
        found = matcher(docs, items, spread, least, passage)
        rows = docs.select(docs["doc_id"].alias("doc_id"), F.explode(found(whole_text(docs))).alias("found"))
        rows = rows.select("doc_id", "found.*")
        out = rows if out is None else out.union(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], _schema(docs))
    return out


def _schema(docs: DataFrame) -> str:
    fields = _FOUND.removeprefix("array<struct<").removesuffix(">>").replace(":", " ")
    return f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}"


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SEED_WORDS, spread: int = SPREAD,
    least: float = LEAST, block_chars: int = BLOCK_CHARS, passage: int = PASSAGE,
) -> DataFrame:
    """``docs`` without the rows in which a test item is found; all columns kept.

    The cases are those of ``contaminated``; no items, no row goes.
    """
    kept = docs
    for items in item_blocks(benchmark, size, block_chars):
        found = matcher(docs, items, spread, least, passage)
        kept = kept.filter(F.size(found(whole_text(kept))) == 0)
    return kept

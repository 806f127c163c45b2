from __future__ import annotations

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lettermill.llm import phrases, queries
from lettermill.llm.common import store, text_slices
from tests.llm.helpers import DOCS, LONG, ODD, documents, rows_of

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_collocations(rows: list[tuple[str | None, str | None]], least: int, top: int = 2000) -> list[tuple]:
    totals, counts = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            totals[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[words[k : k + m]] += 1
    out = []
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if a >= least}
        gone = set()
        for g, b in often.items():
            for m in range(2, len(g)):
                for k in range(len(g) - m + 1):
                    if 100 * b >= 80 * often[g[k : k + m]]:
                        gone.add(g[k : k + m])
        found = []
        for g, a in often.items():
            if len(g) > 1 and g not in gone:
                score, _, left, right = min(
                    (2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))
                )
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for k, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, k + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


def texts(n: int, seed: int) -> list[tuple[str | None, str | None]]:
    draw = random.Random(seed)
    words = ["The", "of", "a", "é", "ÉA", "x-y", "\x1c", "w" * 70, *(f"v{k}" for k in range(12))]
    weights = [1 / (k + 1) for k in range(len(words))]
    ends = [" ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", " ! "]
    rows = []
    for _ in range(n):
        picked = draw.choices(words, weights, k=draw.randint(0, 40))
        text = "".join(w + draw.choice(ends) for w in picked) + draw.choice(["", "new york city hall", "New York state"])
        rows.append((draw.choice(["en", "de", None, "und"]), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, None, None) for k, (g, t) in enumerate(rows)], DOCS)


@pytest.mark.parametrize(
    "bounds",
    [{}, {"head": 4}, {"head": 0}, {"ranked": 3}, {"ranked": 0}, {"head": 5, "ranked": 6, "filter_bits": 15}],
)
def test_equals_brute_force_whatever_is_broadcast(spark, monkeypatch, bounds):
    """Words outside the broadcast, phrases without a rank, blobs, counts and tiles of any size."""
    rows = texts(150, 4)
    monkeypatch.setattr(phrases, "_BLOB", 50)
    found = phrases.collocations(frame(spark, rows), least=5, **bounds)
    assert found.columns == COLUMNS and rows_of(found) == plain_collocations(rows, 5)


def test_the_best_of_each_lang(spark):
    rows = texts(150, 5)
    assert rows_of(phrases.collocations(frame(spark, rows), least=4, top=7)) == plain_collocations(rows, 4, 7)


def test_tiles_and_sorted_codes_count_alike(monkeypatch):
    draw = np.random.default_rng(1)
    first, last = (draw.zipf(1.3, 20_000).clip(1, 90) - 1 for _ in range(2))
    expected = Counter(zip(first.tolist(), last.tolist(), strict=True))
    for side, tiles, dense in ((1024, 4, 1 << 30), (8, 4, 1), (8, 2, 500), (128, 1, 1)):
        monkeypatch.setattr(phrases, "_SIDE", side)
        monkeypatch.setattr(phrases, "_TILES", tiles)
        monkeypatch.setattr(phrases, "_DENSE", dense)
        a, b, n = phrases.count_pairs(first, last)
        assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(n)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == expected


def test_blobs_are_cut_at_gaps_only(monkeypatch):
    monkeypatch.setattr(phrases, "_BLOB", 3)
    ids = np.array([-1, 1, 2, 3, 4, -1, 5, -1, 6, 7, -1, 8], np.int32)
    parts = np.split(ids, phrases._cuts(ids))
    assert np.concatenate(parts).tolist() == ids.tolist()
    assert all(p[0] < 0 for p in parts) and len(parts) > 1


def test_counting_holds_little_at_a_time():
    """Memory of a count is that of a part of the words, and batches are small, however many blobs come."""
    draw = np.random.default_rng(2)
    blobs = [np.append(np.int32(-1), draw.integers(0, 700, 1 << 16, np.int32)) for _ in range(24)]
    expected, found = np.zeros((700, 700), np.int64), np.zeros((700, 700), np.int64)
    for ids in blobs:
        np.add.at(expected, (ids[1:-1], ids[2:]), 1)
    tracemalloc.start()
    try:
        for batch in phrases.counted_parts((pa.py_buffer(ids.tobytes()) for ids in blobs), 2, []):
            assert 0 < batch.num_rows <= 1 << 15
            pair, n = (column.to_numpy() for column in batch.columns)
            np.add.at(found, (pair >> 32, pair & 0xFFFFFFFF), n)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (found == expected).all() and most < 40 << 20


def test_words_hash_alike_wherever_they_stand():
    words = [f"wörd{k % 300}" for k in range(900)] + ["", "a", "b", "ab", "ba"]
    array = pa.array(words)
    hashed = phrases._hashed_words("en", array)
    by_word = dict(zip(words, hashed.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word) and hashed.tolist() == [by_word[w] for w in words]
    assert phrases._hashed_words("en", array[450:460]).tolist() == hashed[450:460].tolist()
    assert not set(phrases._hashed_words("de", array).tolist()) & set(hashed.tolist())
    assert len(phrases._hashed_words("en", array[:0])) == 0


def test_places_take_the_ids_that_were_found():
    """A word that the join did not find, or a blob of which none was, leaves gaps."""
    blobs = [np.array(ids, "<i4").tobytes() for ids in ([-1, 5, -2, -3, -4, 7, -2], [-1, -2, -1, 3], [-1, 4, -1])]
    found = pa.array([[(0 << 32) | 900, (2 << 32) | 901], None, []], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), found], ["ids", "found"])
    out = [np.frombuffer(b, "<i4").tolist() for part in phrases._put(iter([batch])) for b in part.column("ids").to_pylist()]
    assert out == [[-1, 5, 900, -1, 901, 7, 900], [-1, 3], [-1, 4, -1]]


def test_rare_words_take_time_with_the_texts(spark):
    """Many short texts of words that are not broadcast, all of them in one part."""
    rows = [("en", f"w{k % 9000} x{k % 7000} y{k % 8000}.") for k in range(40_000)]
    docs = store(frame(spark, rows).coalesce(1), "docs")
    counts = store(phrases.word_counts(docs), "words")
    vocab = store(phrases.vocabulary(counts, 1), "vocabulary")
    began = time.time()
    blobs = phrases.encode(docs, vocab.filter("id < 5"), vocab.filter("id >= 5"), 28).collect()
    took = time.time() - began
    word = {r["id"]: r["word"] for r in vocab.collect()}
    ids = [np.frombuffer(b["ids"], "<i4").tolist() for b in blobs]
    said = re.split(r"(?: \.)+ ", " ".join(word.get(i, ".") for blob in ids for i in blob).strip(" ."))
    assert Counter(said) == Counter(t.strip(".") for _, t in rows)
    assert took < 15


def test_batches_are_read_whole_in_parts():
    """Parts of a batch start inside its buffers."""
    texts_ = [f"Wörd{k} of a, text {k}" for k in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts_)})
    words = []
    for part in text_slices(batch, 40):
        codes, known, lengths = phrases._tokens(part.column("text"))
        assert len(codes) == lengths.sum()
        words += [known[c].as_py() for c in codes if c >= 0]
    assert words == [w for k in range(50) for w in (f"wörd{k}", "of", "a", "text", str(k))]


def test_odd_rows(spark):
    docs = documents(spark, ODD, "phrase")
    expected = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], 30)
    assert rows_of(phrases.collocations(docs)) == expected and any("long text of words" == r[2] for r in expected)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert len(LONG) > 100_000


def test_counts_beyond_64_bits_of_product(spark):
    rows = [([1], 9 * 10**17), ([2], 9 * 10**17), ([1, 2], 8 * 10**17)]
    grams = spark.createDataFrame(rows, "gram array<long>, f long")
    kept = phrases._outlasting(grams)
    ((_, a, left, right, score),) = map(tuple, phrases._scored(kept, grams).collect())
    assert score == 2_000_000 * a // (left + right) == 888_888


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op12_collocations(spark, sf_dir)) == plain_collocations(rows, 30)

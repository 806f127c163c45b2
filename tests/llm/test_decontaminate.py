from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import decontaminate, queries
from lettermill.llm.align import local_align, local_score, score_bound
from lettermill.llm.decontaminate import Items, words_of
from tests.llm.helpers import DOCS, LONG, ODD, documents, rows_of, texts_of

ITEM = (
    "the quick brown fox jumps over the lazy dog while seven wizards quietly box "
    "up jars of liquid and count every single one before the evening train departs"
)


def smith_waterman(a, b) -> int:
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return int(table.max())


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_score_equals_the_full_table(a, b):
    score, matched, start, end = local_align(a, b)
    assert score == smith_waterman(a, b)
    assert 0 <= start <= end <= len(b) and matched <= min(len(a), end - start)
    assert local_align(a, b, 0, len(a) + len(b))[0] == score


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def edited_copy(seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join(f"word{k}" if draw.random() < share else w for k, w in enumerate(ITEM.split()))


def test_full_edited_and_unrelated_texts(spark):
    filler = " ".join(random.Random(3).choices(ITEM.split(), k=400))
    texts = [
        (1, f"Before. {ITEM.upper()}! After."), (2, f"{filler} {edited_copy(1, 0.15)} {filler}"),
        (3, edited_copy(2, 0.2)), (4, filler), (5, " ".join(ITEM.split()[5:25])),
        (6, ITEM.replace("lazy dog", "lazy and very old dog").replace("liquid", "")),
    ]
    found = decontaminate.contaminated(documents(spark, texts), benchmark(spark, [(9, ITEM), (10, "a b"), (11, None)]))
    scores = {r["doc_id"]: r for r in found.collect()}
    assert set(scores) == {1, 2, 3, 5, 6} and {r["item_id"] for r in scores.values()} == {9}
    assert scores[1]["score"] == 1.0 and (scores[1]["first_word"], scores[1]["end_word"]) == (1, 1 + len(ITEM.split()))
    assert scores[6]["score"] > 0.85


def test_common_passages_keep_their_seeds(spark):
    """A passage that most documents repeat is not rare, and still found in all of them."""
    texts = [(k, f"intro number{k} {ITEM} outro") for k in range(200)]
    found = decontaminate.contaminated(documents(spark, texts), benchmark(spark, [(1, ITEM)]))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(200))


def test_rarer_grams_are_chosen():
    items = Items.of([(1, "a b c d e f g h")], 3)
    keys = items.keys(np.arange(8))
    counts = np.zeros(len(items.grams), np.int64)
    counts[np.searchsorted(items.grams, keys)] = [5, 1, 5, 5, 5, 0]
    assert sorted(at for places in decontaminate.rare_seeds(items, counts, 4).values() for _, at in places) == [1, 5]


def brute_force(texts: dict, items: dict, least: float) -> set:
    out = set()
    for d, text in texts.items():
        words = words_of(text or "")
        for i, item in items.items():
            own = words_of(item or "")
            if len(own) >= 3 and smith_waterman(own, words) >= least * 2 * len(own):
                out.add((d, i))
    return out


def test_query_equals_brute_force_on_a_small_fixture(spark, sf_dir):
    import duckdb

    items = dict(duckdb.execute(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet' ORDER BY 1 LIMIT 12").fetchall())
    texts = {k: t for k, t in texts_of(sf_dir).items() if len(t) < 1200}
    expected = brute_force(texts, items, decontaminate.LEAST)
    found = {(r["doc_id"], r["item_id"]) for r in queries.op4_benchmark_decontamination(spark, sf_dir).collect()}
    assert {(d, i) for d, i in found if d in texts and i in items} == expected


def test_odd_rows_and_blocks(spark):
    docs = documents(spark, [*ODD, (20, ITEM), (20, ITEM), (None, ITEM), (21, LONG + ITEM)], "item_id")
    bench = benchmark(spark, [(1, ITEM), (2, "one"), (None, ITEM + " more"), (3, "")])
    whole = rows_of(decontaminate.contaminated(docs, bench))
    assert [r[0] for r in whole if r[1] == 1] == [20, 20, 21, None]
    assert rows_of(decontaminate.contaminated(docs, bench, block_chars=10)) == whole
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    empty = spark.createDataFrame([], DOCS)
    assert decontaminate.contaminated(empty, bench).count() == 0
    none = decontaminate.contaminated(docs, bench.limit(0))
    assert none.count() == 0 and none.columns == decontaminate.contaminated(docs, bench).columns
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_scores_alone_equal_the_full_table(a, b):
    own, text = np.array(a, np.int64), np.array(b, np.int64)
    assert local_score(own, text) == smith_waterman(a, b) <= score_bound(own, text)


def every(n: int, mark: str) -> str:
    return " ".join(f"{mark}{k}" if k % n == n - 1 else w for k, w in enumerate(ITEM.split()))


def test_copies_edited_every_few_words_are_found(spark):
    """As the sole copy in the corpus, beside full copies, and as one of many alike."""
    bench = benchmark(spark, [(1, ITEM)])
    for n in (4, 5, 6):
        sole = documents(spark, [(1, f"before {every(n, 'new')} after"), (2, "nothing of it here")])
        assert [r["doc_id"] for r in decontaminate.contaminated(sole, bench).collect()] == [1]
    texts = [(k, f"intro {k} {every(4 + k % 3, f'new{k}x') if k % 4 else ITEM} outro") for k in range(80)]
    found = decontaminate.contaminated(documents(spark, texts), bench)
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(80))


def test_copies_stretched_by_inserted_words_are_found(spark):
    words = ITEM.split()
    stretched = " ".join(" ".join(words[k : k + 3]) + f" put{k} in{k} here{k}" for k in range(0, len(words), 3))
    found = decontaminate.contaminated(documents(spark, [(1, stretched)]), benchmark(spark, [(1, ITEM)])).collect()
    assert [r["score"] for r in found] == [round(smith_waterman(words, stretched.split()) / (2 * len(words)), 6)]


def test_long_passages_of_longer_items_are_found(spark):
    item = [f"term{k}" for k in range(300)]
    edited_run = [f"new{k}" if k % 5 == 4 else w for k, w in enumerate(item[50:150])]
    texts = [(1, item[100:200]), (2, edited_run), (3, item[:12]), (4, item[:15] + ["other"] * 60 + item[200:214])]
    docs = documents(spark, [(i, " ".join(["start", *words, "end"])) for i, words in texts])
    bench = benchmark(spark, [(1, " ".join(item))])
    found = {r["doc_id"]: (r["score"], r["matched"], r["first_word"], r["end_word"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {1, 2} and found[1] == (round(1 / 3, 6), 100, 1, 101)
    assert decontaminate.drop_contaminated(docs, bench).count() == 2

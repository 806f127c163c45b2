from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import packing, queries, tokens
from tests.llm.helpers import DOCS, ODD, documents, rows_of, texts_of, tokenizer

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def counted(text: str) -> int:
    return tokens.count_text(text, tokens._counts(BYTES, WHOLE))


WHOLE = tokens.whole_tokens(BYTES)
MEMORY = tokens.word_memory(WORDS)


def library_ids(name: str, text: str) -> list[int]:
    return tokenizer(name).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def libraries():
    return tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def check(libraries, text: str) -> None:
    byte_level, word_level = libraries
    assert counted(text) == len(byte_level.encode(text, add_special_tokens=False).ids), repr(text)
    expected = np.array(word_level.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tokens.word_ids(text, MEMORY) == expected, repr(text)
    ids, counts = tokens.batch_word_ids(pa.array([text, "", f"x {text}"]), MEMORY)
    assert ids[: counts[0]].tobytes() == expected and counts[1] == 0, repr(text)
    assert ids[counts[0] + 1 :].tobytes() == expected and counts.sum() == len(ids), repr(text)


def test_every_plain_character_is_cut_as_the_library_cuts_it(libraries):
    for code in [*range(0x370), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0xFB01, 0x1F600]:
        if unicodedata.category(chr(code)) != "Cs":
            for text in (f"ab{chr(code)}cd", f"1{chr(code)}", f"a {chr(code)}{chr(code)} Zé's", f"{chr(code)} x"):
                check(libraries, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z'sté\n\t  12.,!-_\x1c\xa0 <|endoftext|>İßçǅ"), max_size=40))
def test_counts_and_ids_equal_the_library(text):
    check((tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")), text)


def test_special_strings_and_spaces(libraries):
    for text in ("<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|> y", "a  b", "a   b\n\n c \n", " ", "\n ", "it's we'LL", ""):
        check(libraries, text)


def test_whole_tokens_are_proven(libraries):
    assert " the" in WHOLE and "the" in WHOLE
    assert all(len(libraries[0].encode(t, add_special_tokens=False).ids) == 1 for t in sorted(WHOLE)[::97])


def test_memory_is_bounded():
    memory = tokens.Memory(len, most=3)
    assert [memory[w] for w in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1]
    assert len(memory) <= 3


def test_token_counts_of_odd_rows(spark):
    found = tokens.count_tokens(documents(spark, ODD, "n_tokens"), BYTES)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(i, len((t or "").encode()), len(library_ids("byte_bpe_50k.json", t or ""))) for i, t in ODD]
    assert rows_of(found) == sorted(((*e, e[2] > 512) for e in expected), key=repr)
    assert tokens.count_tokens(spark.createDataFrame([], DOCS), BYTES).count() == 0


def test_query_counts_equal_the_library(spark, sf_dir):
    texts = texts_of(sf_dir)
    for row in queries.op3_token_counts(spark, sf_dir).collect():
        assert row["n_tokens"] == len(library_ids("byte_bpe_50k.json", texts[row["doc_id"]]))
        assert row["n_bytes"] == len(texts[row["doc_id"]].encode())


def verify_packing(rows, texts: list[tuple[int | None, str]], sequence: int) -> None:
    expected = []
    for doc_id, text in texts:
        ids = [*library_ids("word_bpe_49k.json", text), 0]
        for k, at in enumerate(range(0, len(ids), sequence)):
            part = np.array(ids[at : at + sequence], "<u4")
            expected.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence


def test_packing_query_keeps_every_token(spark, sf_dir):
    rows = queries.op6_best_fit_packing(spark, sf_dir).collect()
    verify_packing(rows, list(texts_of(sf_dir).items()), 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= least + 2


def test_packing_of_odd_rows(spark):
    rows = packing.pack(documents(spark, ODD, "length"), WORDS, sequence=64, with_ids=True).collect()
    verify_packing(rows, [(i, t or "") for i, t in ODD], 64)
    by_doc = {(r["doc_id"], r["start"]): r["ids"] for r in rows}
    assert by_doc[(5, 0)] == [*library_ids("word_bpe_49k.json", "one"), 0]
    assert packing.pack(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_one_length_that_all_pieces_have(spark):
    parts = spark.range(5000).selectExpr("id", "cast(700 as long) AS length")
    rows = packing.assign(parts).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5000
    assert len({r["sequence_id"] for r in rows}) == 2500


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_uses_every_piece_once(counts):
    bins = packing.plan(counts, 60)
    used = defaultdict(int)
    for lengths, times in bins:
        assert times > 0 and 0 < sum(lengths) <= 60
        for length in lengths:
            used[length] += times
    assert dict(used) == counts
    total = sum(length * n for length, n in counts.items())
    # Best fit leaves at most one sequence half empty or less.
    assert sum(t for _, t in bins) <= 2 * -(-total // 60) + 1


def test_exact_complements_come_first():
    assert packing.plan({60: 2, 35: 1, 25: 1, 40: 1, 12: 1, 8: 1, 30: 1, 15: 1, 10: 1, 5: 1}, 60) == [
        ([60], 2), ([40, 15, 5], 1), ([35, 25], 1), ([30, 12, 10, 8], 1),
    ]


def test_batches_without_words_or_rows(spark):
    """A batch of blank texts, one without rows, and partitions without any."""
    for texts in ([], [""], ["", " ", "\n"]):
        ids, counts = tokens.batch_word_ids(pa.array(texts, pa.string()), MEMORY)
        assert len(ids) == 0 and counts.tolist() == [0] * len(texts)
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a word")], "doc_id long, text string").repartition(9, "doc_id")
    rows = {r["doc_id"]: r["length"] for r in packing.pieces(docs, WORDS).collect()}
    assert rows[1] == rows[2] == 1 and rows[3] > 1
    assert packing.pieces(docs.filter("doc_id < 0"), WORDS).count() == 0

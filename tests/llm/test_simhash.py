from __future__ import annotations

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import common, queries, simhash
from lettermill.llm.components import components
from tests.conftest import plan_of
from tests.llm.helpers import DOCS, ODD, documents, rows_of, texts_of


def plain_fingerprint(text: str, words: int = 3) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    found = [w for w in low.split(" ") if w]
    shingles = [" ".join(found[k : k + words]) for k in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows: list[tuple[int | None, int]], bits: int = 2) -> list[int | None]:
    group = list(range(len(rows)))

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                group[root(i)] = root(j)
    ids: dict[int, list] = {}
    for k, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(doc_id)
    return [min((i for i in ids[root(k)] if i is not None), default=None) for k in range(len(rows))]


@given(st.text(st.sampled_from("abAÉé \t\n\x0b\x1c\xa0."), max_size=60))
def test_fingerprint_equals_the_plain_rule(text):
    assert simhash.simhash(text) == plain_fingerprint(text)


def test_fingerprint_over_several_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdef", k=300))
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.simhash(text) == plain_fingerprint(text)


def test_query_equals_brute_force(spark, sf_dir):
    rows = queries.op9_simhash_near_dedup(spark, sf_dir).collect()
    texts = texts_of(sf_dir)
    pairs = [(r["doc_id"], int(r["fingerprint"], 16)) for r in rows]
    assert all(len(r["fingerprint"]) == 16 for r in rows) and len(rows) == len(texts)
    assert all(fp == plain_fingerprint(texts[i]) for i, fp in pairs)
    assert [r["component_id"] for r in rows] == plain_groups(pairs)


def crowd_of_fingerprints(n: int) -> list[int]:
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(6)]
    out = set(base)
    while len(out) < n:
        fp = draw.choice(base)
        for _ in range(draw.randint(0, 5)):
            fp ^= 1 << draw.randrange(64)
        out.add(fp)
    return sorted(out)


def test_crowds_and_tables_give_the_same_groups(spark):
    fps = crowd_of_fingerprints(250)
    rows = [(k, fp) for k, fp in enumerate(fps)]
    signed = [(int(np.uint64(fp).astype(np.int64)),) for fp in fps]
    frame = spark.createDataFrame(signed, "fp long")
    for bits, segments in ((2, 2), (1, 2), (3, 2)):
        expected = plain_groups(rows, bits)
        for crowd in (1000, 3, 0):
            found = {r["fp"]: r["group"] for r in simhash.fingerprint_groups(frame, bits, segments, crowd).collect()}
            groups = [found[s[0]] for s in signed]
            first = {}
            assert [first.setdefault(g, k) for k, g in enumerate(groups)] == expected, (bits, crowd)


def test_exploded_probes_are_not_broadcast(spark):
    """By the size of the file, 6,000 fingerprints and their 34 probes each look small."""
    draw = random.Random(3)
    fps = common.store(spark.createDataFrame([(draw.getrandbits(63),) for _ in range(6000)], "fp long"), "fps")
    inner = [line for line in plan_of(simhash.near_links(fps)).splitlines() if "Join" in line and " Inner" in line]
    assert inner and all("SortMergeJoin" in line for line in inner)


def test_groups_are_the_same_without_broadcasts(spark, monkeypatch):
    import lettermill.llm.components as module

    fps = crowd_of_fingerprints(200)
    expected = plain_groups([(k, fp) for k, fp in enumerate(fps)])
    signed = [int(np.uint64(fp).astype(np.int64)) for fp in fps]
    docs = common.store(spark.createDataFrame([(k, fp) for k, fp in enumerate(signed)], "doc_id long, fp long"), "fps")
    for owner in (simhash, module):
        monkeypatch.setattr(owner, "shuffle_if_large", lambda df, rows=None: common.shuffle_if_large(df, most_bytes=0, rows=rows))
    monkeypatch.setattr(simhash, "broadcast_if_small", lambda df, rows=None: common.broadcast_if_small(df, most_bytes=0, rows=rows))
    for crowd in (1000, 3):
        found = {r["fp"]: r["group"] for r in simhash.fingerprint_groups(docs, crowd=crowd).collect()}
        first = {}
        assert [first.setdefault(found[s], k) for k, s in enumerate(signed)] == expected


@settings(max_examples=40)
@given(st.integers(0, 7), st.integers(1, 5))
def test_segments_leave_no_distance_out(bits, segments):
    plan = simhash.segment_plan(bits, segments)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == bits + 1


def test_odd_rows(spark):
    found = simhash.near_duplicates(documents(spark, ODD, "component_id"))
    rows = [(i, plain_fingerprint(t or "")) for i, t in ODD]
    ids = plain_groups(rows)
    expected = [(int(np.uint64(fp).astype(np.int64)), i, c) for (i, fp), c in zip(rows, ids, strict=True)]
    assert sorted(((r["fp"], r["doc_id"], r["component_id"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark, ODD, "text_key_")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(i, plain_fingerprint(t or "")) for i, t in ODD]
    ids = plain_groups(rows)
    left = kept.collect()
    assert len(left) == len(set(plain_groups([(k, fp) for k, (_, fp) in enumerate(rows)])))
    groups = dict(zip(plain_groups([(k, fp) for k, (_, fp) in enumerate(rows)]), ids, strict=True))
    assert sorted((r["doc_id"] for r in left), key=repr) == sorted(groups.values(), key=repr)
    assert sum(r["text"] == "same row twice" for r in left) == 1
    assert simhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    found = dict(rows_of(components(spark.createDataFrame(links, "u long, v long"))))
    assert {found[k] for k in range(41)} == {0}
    assert {found[k] for k in range(100, 130)} == {100} and found[301] == found[300] == 300
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, cell int, rank string"
ASKED = "vec_id % 3 = 0"


def able(rows: list[tuple]) -> list[tuple[int, np.ndarray]]:
    good = [
        (i, np.array(v, dtype=np.float32).astype(float))
        for i, v in rows
        if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
    ]
    lengths = [len(v) for _, v in good]
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if good else 0
    return [(i, v) for i, v in good if len(v) == usual]


def plain_nearest(rows: list[tuple], k: int, every: int = 3) -> dict[int, list[tuple[int, float]]]:
    good = able(rows)
    asked: dict[int, np.ndarray] = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda x: x.tolist())
    return {
        q: sorted(((i, float(np.multiply(v, w).sum())) for i, w in good if i != q), key=lambda c: (-c[1], c[0]))[:k]
        for q, v in asked.items()
    }


def found_by_query(found) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "kept") for i, v in rows], SCHEMA)


def cloud(n: int, dims: int, seed: int = 1) -> list[tuple]:
    draw = np.random.default_rng(seed)
    return [(k, row.tolist()) for k, row in enumerate(draw.normal(size=(n, dims)).astype(np.float32))]


def same(found: dict, expected: dict) -> bool:
    return found.keys() == expected.keys() and all(
        [i for i, _ in found[q]] == [i for i, _ in expected[q]]
        and np.allclose([s for _, s in found[q]], [s for _, s in expected[q]], rtol=0, atol=1e-12)
        for q in expected
    )


@pytest.mark.parametrize("block", [7, 40, 2048])
def test_all_queries_sampled_gives_brute_force(spark, block):
    """A recall of 1 over all queries must find everything, in blocks of any size; a third of the rows are copies."""
    rows = cloud(120, 6)
    rows += [(200 + k, rows[3][1]) for k in range(60)] + [(200, rows[3][1]), (201, rows[4][1])]
    found = neighbours.nearest(frame(spark, rows), ASKED, 5, 1.0, probes=1000, block=block)
    assert same(found_by_query(found), plain_nearest(rows, 5))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 0.5]), (3, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [-1.0, 0.0, 3.0]), (6, None), (9, [0.0, 0.0, 0.0]),
        (12, [1.0, None, 1.0]), (15, [nan, 1.0, 1.0]), (18, [1.0, -inf, 1.0]), (21, []), (24, [1.0, 2.0]), (None, [9.0, 9.0, 9.0]),
        (4, [2.0, 2.0, 2.0]), (4, [2.0, 2.0, 2.0]), (27, [3.0, 0.0, 0.0]), (27, [0.0, 0.0, 3.0]),
    ]
    found = neighbours.nearest(frame(spark, rows), ASKED, 20, 1.0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert same(found_by_query(found), plain_nearest(rows, 20))
    assert set(found_by_query(found)) == {0, 3, 27}


def test_no_vectors_and_no_queries(spark):
    for rows in ([], [(1, [1.0])], [(0, None)], [(0, [1.0, 1.0])]):
        assert neighbours.nearest(frame(spark, rows), ASKED).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 100))
def test_cells_come_by_falling_sum_and_once(size, seed):
    draw = np.random.default_rng(seed)
    index = neighbours.MultiIndex(draw.normal(size=(size, 2)), draw.normal(size=(size, 3)), np.ones(size * size, np.int64), 1)
    query = draw.normal(size=5)
    cells = list(index.order(query))
    sums = [index.first[c // size] @ query[:2] + index.second[c % size] @ query[2:] for c in cells]
    assert sorted(cells) == list(range(size * size))
    assert all(a >= b - 1e-12 for a, b in zip(sums, sums[1:], strict=False))
    assert len(index.probes(query)) == 1


def test_query_recall_and_scores(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    expected = plain_nearest([(r["vec_id"], r["embedding"]) for r in table], 20, 20)
    found = found_by_query(queries.op13_nearest_neighbours(spark, sf_dir))
    assert found.keys() == expected.keys()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table}
    hits = total = 0
    for q, near in found.items():
        assert len(near) == len(expected[q]) and q not in [i for i, _ in near]
        assert all(abs(vectors[q] @ vectors[i] - s) < 1e-12 for i, s in near)
        assert near == sorted(near, key=lambda c: (-c[1], c[0]))
        hits += len({i for i, _ in near} & {i for i, _ in expected[q]})
        total += len(near)
    assert hits >= 0.9 * total


def test_recall_holds_for_queries_not_sampled(spark):
    """Half the candidates at most: vectors in loose groups."""
    draw = np.random.default_rng(2)
    middles = draw.normal(size=(30, 16)) * 2
    points = middles[draw.integers(0, 30, 6000)] + draw.normal(size=(6000, 16))
    rows = [(k, p.tolist()) for k, p in enumerate(points.astype(np.float32))]
    found = found_by_query(neighbours.nearest(frame(spark, rows), "vec_id % 20 = 0", probes=60))
    expected = plain_nearest(rows, 20, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 20 * len(expected) == 0.9 * sum(map(len, found.values()))

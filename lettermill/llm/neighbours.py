"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut into halves, each half is given to its nearest centroid, and a
cell is a pair of centroids. A query takes cells in the order of the summed
inner products with their two centroids, off a heap, until enough vectors lie in
them, and those are reranked by their exact inner products. How many are enough
is measured: exact neighbours of a sample of queries must be among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lettermill.llm.common import store
from lettermill.llm.samples import least_hashed

K = 20
SAMPLE, PROBES = 16_384, 256
MOST_CENTROIDS, PER_CELL = 128, 32
RECALL = 0.95
# Rows and queries that meet in one task at a time.
BLOCK = 2048


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of both halves, vectors in each cell, and candidates a query reranks."""

    first: np.ndarray
    second: np.ndarray
    held: np.ndarray
    candidates: int

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector: the numbers of its halves' nearest centroids as one."""
        a = _nearest(vectors[:, : self.cut], self.first)
        return a * len(self.second) + _nearest(vectors[:, self.cut :], self.second)

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the query halves' inner products with the cell's centroids."""
        a, b = self.first @ query[: self.cut], self.second @ query[self.cut :]
        ranks_a, ranks_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[ranks_a].tolist(), b[ranks_b].tolist()
        width = len(b)
        heap = [(-a[0] - b[0], 0, 0)]
        while heap:
            _, i, j = heappop(heap)
            yield ranks_a[i] * width + ranks_b[j]
            # Each cell has one predecessor, whose sum is no smaller: none comes twice.
            if j + 1 < width:
                heappush(heap, (-a[i] - b[j + 1], i, j + 1))
            if not j and i + 1 < len(a):
                heappush(heap, (-a[i + 1] - b[0], i + 1, 0))

    def probes(self, query: np.ndarray, more: int = 0) -> np.ndarray:
        """The cells with vectors that a query takes until it has its candidates and ``more``."""
        held, enough, found, out = self.held, self.candidates + more, 0, []
        for cell in self.order(query):
            n = held[cell]
            if n:
                out.append(cell)
                found += n
                if found >= enough:
                    break
        return np.array(out, np.int64)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centroids.T - (centroids * centroids).sum(1) / 2, axis=1)


def centroids(points: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means; empty centroids stay where they are."""
    chosen = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, chosen)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(n)
        starts = np.concatenate(([0], np.cumsum(n)))[some]
        if points.shape[1]:
            chosen[some] = np.add.reduceat(points[order], starts, axis=0) / n[some, None]
    return chosen


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of rows that take part.

    Left out are rows without an id, and vectors that are null, zero, hold null
    or non-finite components, or have not the most common length (of several,
    the smallest): vectors of different lengths have no inner product.
    """
    vector = rows[column].cast("array<double>")
    rows = rows.select(rows[id_column].cast("long").alias("vec_id"), vector.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    some = F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~odd & some)
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), "length").select("length").first()
    return rows.filter(F.size("vector") == (usual[0] if usual else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed alike for every row, so that equal vectors tie."""
    return np.multiply(vectors, query).sum(axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the ``k`` best rows, ties to smaller ids; -inf in ``scores`` is no candidate.

    ``scores`` may be off by rounding: all that could be among the best are worked out again.
    """
    able = np.flatnonzero(scores > -np.inf)
    if len(able) > k:
        least = np.partition(scores[able], len(able) - k)[len(able) - k]
        slack = 1e-9 * max(1.0, abs(least))
        able = able[scores[able] >= least - slack]
    exact = products(vectors[able], query)
    order = np.lexsort((ids[able], -exact))[:k]
    return able[order], exact[order]


def fit_index(rows: DataFrame, queries: DataFrame, k: int, recall: float, sample: int, probes: int) -> tuple[MultiIndex, DataFrame]:
    """The index over ``rows`` (``vec_id``, ``vector``; stored), and ``rows`` with their ``cell`` and ``half``.

    Centroids are fitted on the ``sample`` vectors with the smallest hashes of
    their ids. Exact neighbours of the ``probes`` least hashed ``queries``, found
    by a pass over all rows, tell how many candidates give the ``recall``.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("hash", F.xxhash64("vec_id"))
    points = _matrix(least_hashed(hashed, "hash", sample, "vec_id", "vector").select("vector").toArrow()["vector"])
    n = rows.count()
    size = max(1, min(MOST_CENTROIDS, math.isqrt(n // PER_CELL), len(points)))
    cut = points.shape[1] // 2
    bare = MultiIndex(centroids(points[:, :cut], size), centroids(points[:, cut:], size), np.zeros(size * size, np.int64), 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            cells = pa.array(bare.cells(_matrix(batch.column("vector"))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), cells], ["vec_id", "vector", "cell"])

    indexed = rows.mapInArrow(assign, "vec_id long, vector array<double>, cell long")
    # The number makes rows with one id fall into different blocks.
    indexed = store(indexed.withColumn("number", F.monotonically_increasing_id()), "index")
    held = bare.held.copy()
    # At most the square of the number of centroids.
    for cell, count in indexed.groupBy("cell").count().collect():
        held[cell] = count
    index = MultiIndex(bare.first, bare.second, held, n)
    some = least_hashed(queries.withColumn("hash", F.xxhash64("vec_id")), "hash", probes, "vec_id").toArrow()
    ids, vectors = some["vec_id"].to_numpy(), _matrix(some["vector"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in filter(len, batches):
            own, points, cells = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector")), batch.column("cell").to_numpy()
            scores = points @ vectors.T
            for q, query in enumerate(vectors):
                at, found = _best(np.where(own == ids[q], -np.inf, scores[:, q]), own, points, query, k)
                found, at = np.concatenate((best[q][0], found)), np.concatenate((best[q][1], cells[at]))
                order = np.argsort(-found, kind="stable")[:k]
                best[q] = found[order], at[order]
        number = np.repeat(np.arange(len(ids)), [len(b[0]) for b in best])
        columns = [number, *(np.concatenate([b[k] for b in best]) for k in (0, 1))] if len(ids) else [number, np.zeros(0), number]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "score", "cell"])

    found = indexed.select("vec_id", "vector", "cell").mapInArrow(exact, "q long, score double, cell long")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"))
    found = found.withColumn("at", F.row_number().over(by_score)).filter(F.col("at") <= k).select("q", "cell").toArrow()
    needed = []
    for q, cell in zip(found["q"].to_pylist(), found["cell"].to_pylist(), strict=True):
        needed.append((q, cell))
    reach = _reach(index, vectors, needed)
    enough = int(np.quantile(reach, recall, method="higher")) if len(reach) else n
    return MultiIndex(index.first, index.second, held, max(enough, k)), indexed


def _reach(index: MultiIndex, vectors: np.ndarray, wanted: list[tuple[int, int]]) -> list[int]:
    """For each (query, cell): the vectors in cells up to and with that one, in the query's order."""
    cells: dict[int, list[int]] = {}
    for q, cell in wanted:
        cells.setdefault(q, []).append(cell)
    out = []
    for q, own in cells.items():
        left, found, at = set(own), 0, {}
        for cell in index.order(vectors[q]):
            found += int(index.held[cell])
            if cell in left:
                at[cell] = found
                left.discard(cell)
                if not left:
                    break
        out += [at[c] for c in own]
    return out


_FOUND = "query_id long, vec_id long, score double"


def _search(index: MultiIndex, k: int):
    """The best ``k`` rows of a block for each query of a block, among the cells that the query probes."""

    def run(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        asked, vectors = np.stack(queries["vector"].to_numpy()), np.stack(rows["vector"].to_numpy())
        probed = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in queries["probed"]]), axis=1)
        ids, columns = rows["vec_id"].to_numpy(), rows["cell"].to_numpy() % len(index.second)
        query_ids = queries["query_id"].to_numpy()
        scores = np.full((len(asked), len(vectors)), -np.inf)
        for column in np.unique(columns):
            who, at = np.flatnonzero(probed[:, column]), np.flatnonzero(columns == column)
            scores[np.ix_(who, at)] = asked[who] @ vectors[at].T
        out = []
        for q, query_id in enumerate(query_ids):
            row = np.where(ids == query_id, -np.inf, scores[q])
            at, exact = _best(row, ids, vectors, asked[q], k)
            out.append((np.full(len(at), query_id), ids[at], exact))
        query, found, exact = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": found, "score": exact})

    return run


def nearest(
    rows: DataFrame,
    queries: Column | str,
    k: int = K,
    recall: float = RECALL,
    sample: int = SAMPLE,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` nearest found.

    ``rows`` has ``vec_id`` and ``embedding``; ``queries`` is a condition on
    ``vec_id`` that picks rows as queries, each searched among all rows but those
    with its own id. Nearness is the inner product in double precision, ties go
    to smaller ids. ``recall`` is that on ``probes`` sampled queries; with
    fewer candidates than ``k`` all are returned.

    Rows without an id, and vectors null, zero, of unusual length or with null
    or non-finite components take no part. Of queries that share an id the
    least vector asks; rows that share an id are candidates each. Other
    columns are ignored; no vectors, no rows.

    Work is dealt in blocks of at most about ``block`` rows of one half cell and
    as many queries that probe it, so a crowded cell spreads over many tasks.
    """
    spark = rows.sparkSession
    taken = store(valid_vectors(rows), "vectors")
    asked = taken.filter(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("copies"))
    asked = store(asked, "queries")
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, indexed = fit_index(taken, asked, k, recall, sample, probes)
    width = len(index.second)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            ids, copies = batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy()
            who, halves, bits = [], [], []
            for q, query in enumerate(_matrix(batch.column("vector"))):
                cells = index.probes(query, int(copies[q]))
                marks = np.zeros((len(index.first), width), np.uint8)
                marks.reshape(-1)[cells] = 1
                some = np.flatnonzero(marks.any(axis=1))
                who += [q] * len(some)
                halves += some.tolist()
                bits += [row.tobytes() for row in np.packbits(marks[some], axis=1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who]), batch.column("vector").take(pa.array(who, pa.int64())), pa.array(halves, pa.int64()), pa.array(bits, pa.binary())],
                ["query_id", "vector", "half", "probed"],
            )

    probed = asked.repartition(spark.sparkContext.defaultParallelism * 2, "vec_id").mapInArrow(
        probe, "query_id long, vector array<double>, half long, probed binary"
    )
    probed = store(probed, "probes")
    halves = len(index.first)
    asking = dict(probed.groupBy("half").count().collect())
    row_blocks = [max(1, math.ceil(int(n) / block)) for n in index.held.reshape(halves, width).sum(1)]
    query_blocks = [max(1, math.ceil(asking.get(h, 0) / block)) for h in range(halves)]

    def blocks(counts: list[int], half: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, counts)), (half + 1).cast("int"))

    half = F.col("half")
    row_block = F.pmod(F.xxhash64("number"), blocks(row_blocks, half)).cast("int")
    query_block = F.pmod(F.xxhash64("query_id"), blocks(query_blocks, half)).cast("int")
    stored = indexed.withColumn("half", F.floor(F.col("cell") / width).cast("long")).filter(half.isin(list(asking)))
    stored = stored.withColumn("row_block", row_block).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), blocks(query_blocks, half) - 1))
    )
    probed = probed.withColumn("query_block", query_block).withColumn(
        "row_block", F.explode(F.sequence(F.lit(0), blocks(row_blocks, half) - 1))
    )
    at = ["half", "row_block", "query_block"]
    found = (
        probed.groupBy(*at)
        .cogroup(stored.select(*at, "vec_id", "vector", "cell").groupBy(*at))
        .applyInPandas(_search(index, k), _FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast(T.IntegerType())).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

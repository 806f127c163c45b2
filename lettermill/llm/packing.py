"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import store, text_slices, whole_text
from lettermill.llm.tokens import batch_word_ids, word_memory

SEQUENCE = 2048
END_ID = 0
_RANK_BITS = 48
_SLICE_BYTES = 4 << 20


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Tokenized documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its token ids and then id 0. Only documents longer than
    ``sequence`` are cut. ``with_ids`` adds the ids of each piece. Null and
    empty texts are one piece of the closing id; repeated rows come back each;
    other columns are ignored; no documents, no rows.
    """

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kept for one task: a worker takes no memory of one stage to the next.
        memory = word_memory(path)
        for batch in batches:
            for part in text_slices(batch, _SLICE_BYTES):
                yield _cut(part.column("doc_id"), *batch_word_ids(part.column("text"), memory), sequence, with_ids)
            # The batch goes before the next one is read.
            part = batch = None
        pa.default_memory_pool().release_unused()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(cut, schema)


def _cut(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, sequence: int, with_ids: bool) -> pa.RecordBatch:
    """Rows of ``pieces`` for texts whose ``ids`` stand in a row, ``counts`` of them each."""
    ends = np.cumsum(counts)
    closed = np.insert(ids, ends, END_ID).astype("<u4", copy=False)
    lengths = counts + 1
    begins = np.cumsum(lengths) - lengths
    n = -(-lengths // sequence)
    doc = np.repeat(np.arange(len(n)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * sequence
    length = np.minimum(sequence, lengths[doc] - start)
    held, at = memoryview(closed).cast("B"), begins[doc] + start
    crcs = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
    columns = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        # Pieces stand in a row, so their ends are the offsets.
        offsets = np.concatenate(([0], np.cumsum(length)))
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(closed.astype("i8"))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def _complement(count: np.ndarray, gap: int, most: int) -> list[int] | None:
    """One, two or three available lengths up to ``most`` that add up to ``gap``, larger ones first."""
    there = count > 0
    there[most + 1 :] = False
    if gap <= most and there[gap]:
        return [gap]

    def pair(total: int) -> list[int] | None:
        if total < 2:
            return None
        high = np.arange(max(total - most, (total + 1) // 2), min(most, total - 1) + 1)
        fits = there[high] & there[total - high] & ((2 * high != total) | (count[high] > 1))
        best = np.flatnonzero(fits)
        return [int(high[best[-1]]), total - int(high[best[-1]])] if len(best) else None

    if found := pair(gap):
        return found
    for a in np.flatnonzero(there[: min(most, gap - 2) + 1])[::-1]:
        if 3 * a < gap:
            break
        count[a] -= 1
        there[a] = count[a] > 0
        found = pair(gap - int(a))
        count[a] += 1
        there[a] = True
        if found:
            return [int(a), *found]
    return None


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences) for counted piece lengths.

    Exact complements first: from the longest length down, single lengths, then
    pairs and triples that fill the gap exactly are used up as often as all of
    them are available. What finds no exact partner is packed by best fit, from
    the longest down. The work depends on the number of different lengths, at
    most ``sequence``, not on the number of pieces.
    """
    count = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    bins: list[tuple[list[int], int]] = []
    for length in range(sequence, 0, -1):
        while count[length] > 0:
            if length == sequence:
                found: list[int] | None = []
            else:
                count[length] -= 1  # the one the gap is sought for
                found = _complement(count, sequence - length, length)
                count[length] += 1
            if found is None:
                break
            lengths = [length, *found]
            times = min(int(count[x]) // lengths.count(x) for x in lengths)
            for x in lengths:
                count[x] -= times
            bins.append((lengths, times))
    # Room left -> sequences begun with that room; rooms are looked up by best fit.
    begun: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(sequence, 0, -1):
        left = int(count[length])
        while left:
            room = min((r for r in begun if r >= length), default=0)
            lengths, n = begun[room].pop() if room else ([], left)
            room = room or sequence
            if room in begun and not begun[room]:
                del begun[room]
            each = room // length
            full = min(n, left // each)
            if full:
                begun.setdefault(room - each * length, []).append((lengths + [length] * each, full))
                left -= full * each
            if n > full and left and left < each:
                begun.setdefault(room - left * length, []).append((lengths + [length] * left, 1))
                left, full = 0, full + 1
            if lengths and n > full:
                begun.setdefault(room, []).append((lengths, n - full))
    return bins + [group for room in sorted(begun) for group in begun[room]]


def _ranges(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """The plan by length and rank: (key of length and first rank, first sequence, offset)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append(((length << _RANK_BITS) + rank, first - rank, offset))
            used[length] = rank + times
            offset += length
        first += times
    return pd.DataFrame(rows, columns=["key", "shift", "offset"], dtype="int64").sort_values("key")


def assign(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``parts`` (with ``length``, 1 to ``sequence``) plus ``sequence_id`` and ``offset``.

    Only the number of pieces of each length reaches the driver. Pieces of one
    length are numbered in slices (a length that a third of all pieces have is
    spread over as many tasks), and their number finds their place in the plan.
    ``parts`` is read twice: store it where it is costly. Repeated rows get a
    place each. No pieces, no rows.
    """
    spark = parts.sparkSession
    slices = min(512, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = [c for c, kind in parts.dtypes if kind in ("bigint", "int", "string")]
    sliced = parts.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    counts = sliced.groupBy("length", "slice").count()
    by_length = counts.groupBy("length").agg(F.sum("count").alias("n")).collect()
    ranges = _ranges(plan({r["length"]: r["n"] for r in by_length}, sequence))
    before = Window.partitionBy("length").orderBy("slice")
    starts = counts.select("length", "slice", (F.sum("count").over(before) - F.col("count")).alias("first"))
    own = Window.partitionBy("length", "slice").orderBy(*keys)
    ranked = (
        sliced.withColumn("rank", F.row_number().over(own))
        # At most 512 rows for each of 2048 lengths.
        .join(F.broadcast(starts), ["length", "slice"])
        .withColumn("key", F.shiftleft("length", _RANK_BITS) + F.col("first") + F.col("rank") - 1)
    )
    key, shift, offset = (ranges[c].to_numpy() for c in ("key", "shift", "offset"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(wanted: pd.Series) -> pd.DataFrame:
        k = wanted.to_numpy()
        at = np.searchsorted(key, k, side="right") - 1
        rank = k & ((1 << _RANK_BITS) - 1)
        return pd.DataFrame({"sequence_id": shift[at] + rank, "offset": offset[at]})

    placed = ranked.withColumn("place", place("key"))
    return placed.select(*parts.columns, "place.sequence_id", "place.offset")


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """``pieces`` of ``docs`` with their place: ``sequence_id`` and ``offset`` in it."""
    return assign(store(pieces(docs, path, sequence, with_ids), "pieces"), sequence)

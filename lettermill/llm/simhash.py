"""SimHash fingerprints, their near matches by multi-index hashing, and groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import broadcast_if_small, fresh, shuffle_if_large, store, whole_text
from lettermill.llm.components import components

WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = 2
CROWD = 64
_BLOCK = 1 << 16


def simhash(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number.

    A-Z are lower-cased and words are runs of anything but ASCII white space.
    Every shingle occurrence votes with its XXH64; a bit is set if more than
    half of the hashes have it. Fewer words than a shingle: one hash of the
    whole sequence. No words: zero.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    total = len(tokens) - size + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _BLOCK):
        part = tokens[start : min(total, start + _BLOCK) + size - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        hashes = np.array([digest(s, SEED) for s in joined], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def simhash_column(words: int = WORDS):
    """``simhash`` of a text column, as the signed 64-bit number of the same bits."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return fingerprint


def segment_plan(max_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    Two fingerprints within ``max_bits`` bits differ by at most its radius in
    some segment, if the radii plus one add up to ``max_bits + 1``. So the
    radii are shared out that way, larger ones first; with more segments than
    that, only ``max_bits + 1`` are made, of radius 0.
    """
    segments = max(1, min(segments, max_bits + 1))
    spare = max_bits + 1 - segments
    plan, shift = [], 64
    for k in range(segments):
        width = (64 - sum(w for _, w, _ in plan)) // (segments - k)
        shift -= width
        plan.append((shift, width, spare // segments + (k < spare % segments)))
    return plan


def ball(width: int, radius: int) -> list[int]:
    """The masks of ``width`` bits with at most ``radius`` of them set, as signed longs."""
    masks = [
        sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)
    ]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _masks(width: int, radius: int) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < 64 else fp


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints within ``max_bits`` bits.

    ``fps`` has one row per distinct ``fp``. Every segment has a table from its
    value to fingerprints; a probe looks up each value of a small Hamming ball
    about its own, and complete distances are verified. Buckets of more than
    ``crowd`` fingerprints would meet in pairs, so whoever lies in one or
    probes one is linked another way, without loss: two fingerprints are within
    d bits exactly if a point within ceil(d/2) of one is within floor(d/2) of
    the other. Such fingerprints name all points about them, and those at one
    point (at most a ball's size, whatever the bucket's) link to one of them.
    """
    plan = segment_plan(max_bits, segments)
    fp = F.col("fp")
    slots, probes = None, None
    for k, (shift, width, radius) in enumerate(plan):
        own = _segment(fp, shift, width)
        slot = fps.select(F.lit(k).alias("segment"), own.alias("key"), "fp")
        probe = fps.select("fp", F.explode(_masks(width, radius)).alias("mask")).select(
            F.lit(k).alias("segment"), own.bitwiseXOR(F.col("mask")).alias("key"), fp.alias("probe")
        )
        slots = slot if slots is None else slots.union(slot)
        probes = probe if probes is None else probes.union(probe)
    crowds = store(
        slots.groupBy("segment", "key").count().filter(F.col("count") > crowd).select("segment", "key"),
        "crowds",
    )
    at = ["segment", "key"]
    n_crowds = crowds.count()
    few = broadcast_if_small(crowds, rows=n_crowds)
    # Spark would size the probes as if each fingerprint had one.
    balls = sum(len(ball(width, radius)) for _, width, radius in plan)
    probes = shuffle_if_large(probes.join(few, at, "left_anti"), rows=fps.count() * balls)
    pairs = (
        probes.join(slots.join(few, at, "left_anti"), at)
        .filter("probe <> fp")
        .filter(F.bit_count(F.col("probe").bitwiseXOR(fp)) <= max_bits)
        .select(F.greatest("probe", "fp").alias("u"), F.least("probe", "fp").alias("v"))
    )
    if not n_crowds:
        return pairs.distinct()
    crowded = None
    for k, (shift, width, radius) in enumerate(plan):
        keys = (
            crowds.filter(F.col("segment") == k)
            .select("key", F.explode(_masks(width, radius)).alias("mask"))
            .select(F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
            .distinct()
        )
        keys = broadcast_if_small(keys, rows=n_crowds * len(ball(width, radius)))
        met = fps.withColumn("key", _segment(fp, shift, width)).join(keys, "key", "left_semi").select("fp")
        crowded = met if crowded is None else crowded.union(met)
    points = crowded.distinct().select("fp", F.explode(_masks(64, (max_bits + 1) // 2)).alias("mask"))
    centre = F.min(F.when(F.bit_count("mask") <= max_bits // 2, fp))
    stars = (
        points.groupBy(fp.bitwiseXOR(F.col("mask")).alias("point"))
        .agg(centre.alias("v"), F.collect_list("fp").alias("members"))
        .filter(F.col("v").isNotNull() & (F.size("members") > 1))
        .select(F.explode("members").alias("u"), "v")
        .filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    return pairs.union(stars).distinct()


def fingerprint_groups(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """``fp`` and ``group`` (a fingerprint of the group) for each distinct ``fp``."""
    distinct = store(fps.select("fp").filter("fp is not null").distinct(), "fingerprints")
    linked = components(near_links(distinct, max_bits, segments, crowd))
    linked = shuffle_if_large(linked.withColumnRenamed("node", "fp"), rows=distinct.count())
    return distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("group")
    )


def near_duplicates(
    docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints that
    differ in at most ``max_bits`` bits; null where every document reachable
    has a null id. Null texts read as empty; empty texts have fingerprint zero
    and link like any other. Repeated rows come back as often as they are
    given. Other columns of ``docs`` are ignored. No documents, no rows.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), simhash_column(words)(whole_text(docs)).alias("fp"))
    rows = store(rows, "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    groups = shuffle_if_large(store(fingerprint_groups(least, max_bits, segments, crowd), "groups"))
    ids = least.join(groups, "fp").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return shuffle_if_large(rows).join(groups.join(ids, "group").select("fp", "component_id"), "fp")


def drop_near_duplicates(
    docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD
) -> DataFrame:
    """``docs`` with one row left of each near-duplicate group, all columns kept.

    The row with the smallest ``doc_id`` stays (any row with an id before one
    with none); of several with that id, the one whose text has the smallest
    hash, and one copy of repeated rows. Null and empty texts are one group.
    """
    text = whole_text(docs)
    row = F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "fp", F.col("copies").alias("copies")
    )
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_key"), simhash_column(words)(text).alias("fp")
    )
    rows = store(rows.groupBy("doc_id", "text_key", "fp").agg(F.count("*").alias("copies")), "simhash")
    groups = store(fingerprint_groups(rows, max_bits, segments, crowd), "groups")
    n_rows = rows.count()
    grouped = shuffle_if_large(rows, rows=n_rows).join(groups, "fp")
    kept = store(grouped.groupBy("group").agg(F.min(row).alias("row")).select("group", "row.*"), "kept")
    key, id_key = fresh(docs, "text_key_"), fresh(docs, "id_key_")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    of_kept = kept.select("group", F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    of_kept = shuffle_if_large(of_kept, rows=n_rows)
    # Rows to go, and rows of which one of several stays: those are put back below.
    gone = grouped.join(of_kept, "group").filter(~is_kept | (F.col("copies") > 1))
    gone = store(gone.select(F.col("text_key").alias(key), F.col("doc_id").alias(id_key)), "gone")
    several = kept.filter("copies > 1").select(F.col("text_key").alias(key), F.col("doc_id").alias(id_key))
    keyed = docs.withColumn(f"{key}own", F.xxhash64(text))
    same = (F.col(f"{key}own") == F.col(key)) & keyed["doc_id"].eqNullSafe(F.col(id_key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = keyed.join(broadcast_if_small(gone), same, "left_anti").select(*columns)
    if several.isEmpty():
        return rest
    back = keyed.join(broadcast_if_small(several), same, "left_semi").dropDuplicates([f"{key}own", "doc_id"])
    return rest.union(back.select(*columns))

"""Merkle manifest of a table: one tree of row digests a group, one tree over the groups.

Leaves find their places by rank queries on bitmaps: per group, the ids present
are a sparse bitmap of 64-bit words, OR-merged as they are aggregated; a popcount
directory holds the bits before each word. So rows are joined with their word
and never sorted. Then slots of neighbouring places meet in arrays, which reduce
several levels at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import broadcast_if_small, running_total, store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 8
_WORD_BITS = 6
_REPEATS = 1 << 12


def field_text(value: Column) -> Column:
    """A value as it goes into a digest: its length in UTF-8 bytes, a colon, itself; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the values' texts in a row, as lowercase hex."""
    return F.sha2(F.concat(*values), 256)


def row_digest(df: DataFrame, fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """The leaf of a row; ``changed`` gives other values for named fields."""
    return digest(*[field_text(changed.get(name, df[name])) for name in fields])


def _group_key(value: Column) -> Column:
    """A text that orders null first, then UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _word(doc_id: Column) -> Column:
    return F.shiftright(doc_id, _WORD_BITS)


def _bit(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit((1 << _WORD_BITS) - 1).cast("long")).cast("int")


def rank_directory(ids: DataFrame) -> DataFrame:
    """Bitmap words and their directory from ``ids`` (``grp``, ``id`` not null and distinct, ``copies``).

    One row per 64 neighbouring ids of which at least one is there: ``grp``,
    ``word``, ``bits``, ``extras`` (bits that stand for several rows, and how many
    more) and ``before``, the rows of smaller words, groups before included.
    Absent words cost nothing, so sparse ids take no more rows than there are ids.
    """
    one = F.lit(1).cast("long")
    extra = F.when(F.col("copies") > 1, F.struct(_bit(F.col("id")).alias("bit"), (F.col("copies") - 1).alias("more")))
    words = ids.groupBy("grp", _word(F.col("id")).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", one, _bit(F.col("id")))).alias("bits"),
        F.sum("copies").alias("held"),
        F.collect_list(extra).alias("extras"),
    )
    return running_total(words, ["grp", "word"], "held", "before").drop("held")


def rank_in_word(doc_id: Column, bits: Column, extras: Column) -> Column:
    """Rows of smaller ids within the word: a popcount below the id's bit, and their extra rows."""
    bit = _bit(doc_id)
    ones = F.lit((1 << 63) - 1).cast("long")
    below = F.call_function("shiftrightunsigned", ones, F.lit(63) - bit)
    more = F.aggregate(extras, F.lit(0).cast("long"), lambda n, e: n + F.when(e["bit"] < bit, e["more"]).otherwise(0))
    return F.bit_count(bits.bitwiseAND(below)) + more


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``pos`` in their group (the first of equal rows), and the groups with their sizes ``n``."""
    ids = store(leaves.groupBy("grp", "id").agg(F.sum("copies").alias("copies"), F.count("*").alias("kinds")), "ids")
    directory = rank_directory(ids.filter("id is not null"))
    groups = store(
        ids.groupBy("grp").agg(
            F.sum("copies").alias("n"), F.coalesce(F.sum(F.expr("if(id is null, copies, 0)")), F.lit(0)).alias("no_id")
        ),
        "groups",
    )
    # Rows without an id lead their group and are not in the directory.
    starts = running_total(groups.withColumn("with_id", F.col("n") - F.col("no_id")), ["grp"], "with_id", "start")
    starts = store(starts.select("grp", "no_id", "start"), "starts")
    directory = directory.join(broadcast_if_small(starts, 128), "grp").select(
        "grp", "word", "bits", "extras", (F.col("before") - F.col("start") + F.col("no_id")).alias("before")
    )
    # Ids with different rows: their rows are ordered by digest.
    shared = store(ids.filter("kinds > 1 or id is null").select("grp", "id"), "shared")
    same = F.col("l.grp").eqNullSafe(F.col("s.grp")) & F.col("l.id").eqNullSafe(F.col("s.id"))
    few = broadcast_if_small(shared, 128)
    lone = leaves.alias("l").join(few.alias("s"), same, "left_anti").withColumn("at", F.lit(0).cast("long"))
    several = leaves.alias("l").join(few.alias("s"), same, "left_semi")
    if shared.isEmpty():
        rows = lone
    else:
        run = store(running_total(several, ["grp", "id", "leaf"], "copies", "run"), "several")
        first = run.groupBy("grp", "id").agg(F.min("run").alias("first")).alias("s")
        at = run.alias("l").join(first, same).select("l.*", (F.col("run") - F.col("first")).alias("at"))
        rows = lone.unionByName(at.drop("run"))
    known = rows.filter("id is not null").withColumn("word", _word(F.col("id"))).join(directory, ["grp", "word"])
    rank = F.col("before") + rank_in_word(F.col("id"), F.col("bits"), F.col("extras")) + F.col("at")
    known = known.withColumn("pos", rank).drop("word", "bits", "extras", "before", "at")
    unknown = rows.filter("id is null").withColumn("pos", F.col("at")).drop("at")
    return known.unionByName(unknown), groups.select("grp", "n")


def _spread(rows: DataFrame) -> DataFrame:
    """Each of equal rows at its own place; many are first cut into runs, which go to different tasks."""
    most = F.lit(_REPEATS).cast("long")
    runs = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, most)
    single = rows.filter("copies = 1").drop("copies")
    many = rows.filter("copies > 1").withColumn("from_", F.explode(runs)).repartition("grp", "pos", "from_")
    upto = F.least(F.col("copies"), F.col("from_") + most) - 1
    many = many.withColumn("copy_", F.explode(F.sequence(F.col("from_"), upto)))
    many = many.withColumn("pos", F.col("pos") + F.col("copy_")).drop("copies", "from_", "copy_")
    return single.unionByName(many)


def _depth(n: Column) -> Column:
    """Levels above ``n`` nodes: the binary digits of ``n - 1``."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _parents(nodes: Column) -> Column:
    """The next level: digests of every two nodes in a row, the last one alone if it is odd."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def grow(nodes: DataFrame, payload: tuple[str, ...], levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (``grp``, ``n``, ``pos`` 0 to n - 1, ``digest`` and payload columns).

    A step takes every ``2 ** levels`` neighbouring slots as one array, keyed by
    the group and the place's upper bits, and reduces them by up to ``levels``
    levels. Returns the steps' tables (slots and levels of each array) and
    ``grp``, ``n``, ``digest`` of the roots. No key holds more than an array.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    steps = []
    for k in range(max(1, math.ceil(max(most - 1, 0).bit_length() / levels))):
        slot = F.col("pos").bitwiseAND(F.lit((1 << levels) - 1).cast("long")).cast("int").alias("slot")
        kept = payload if k == 0 else ()
        arrays = (
            nodes.groupBy("grp", F.shiftright("pos", levels).alias("chunk"))
            .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(slot, "digest", *kept))).alias("slots"))
            .withColumn("todo", F.greatest(F.lit(0), F.least(F.lit(levels), _depth(F.col("n")) - k * levels)))
            .withColumn("level0", F.transform("slots", lambda s: s["digest"]))
        )
        for level in range(levels):
            below = F.col(f"level{level}")
            pairs = _parents(below)
            arrays = arrays.withColumn(f"level{level + 1}", F.when(F.col("todo") > level, pairs).otherwise(below))
        arrays = store(arrays, "slots")
        steps.append(arrays)
        nodes = arrays.select("grp", "n", F.col("chunk").alias("pos"), F.get(f"level{levels}", F.lit(0)).alias("digest"))
    return steps, nodes.select("grp", "n", "digest")


def paths(steps: list[DataFrame], tops: DataFrame, payload: tuple[str, ...], levels: int = LEVELS) -> DataFrame:
    """``grp``, ``digest``, the payload and ``path`` of every leaf, and further columns of ``tops``.

    ``tops`` has ``grp`` and the ``path`` above each root. A path is an array from
    the leaf up of ``left`` (the sibling stands left) and ``digest`` (null: no sibling).
    """
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    above = tops.withColumn("chunk", F.lit(0).cast("long"))
    for k, step in reversed(list(enumerate(steps))):
        slot = F.col("s.slot")
        own = F.array(
            *[
                F.struct(
                    (F.shiftright(slot, level).bitwiseAND(F.lit(1)) == 1).alias("left"),
                    F.get(f"level{level}", F.shiftright(slot, level).bitwiseXOR(F.lit(1))).alias("digest"),
                )
                for level in range(levels)
            ]
        )
        kept = payload if k == 0 else ()
        # The last step's arrays hold whole trees, so its chunk is 0.
        rows = step.join(above, ["grp", "chunk"]).withColumn("s", F.explode("slots"))
        above = rows.select(
            "grp",
            (F.shiftleft("chunk", levels) + slot).alias("chunk"),
            F.concat(F.slice(own, F.lit(1), F.col("todo")), F.col("path")).alias("path"),
            F.col("s.digest").alias("digest"),
            *[F.col(f"s.{c}") for c in kept],
            *carried,
        )
        if k:
            above = above.drop("digest")
    return above.drop("chunk")


def proof(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(
        path,
        leaf,
        lambda node, s: F.when(s["digest"].isNull(), digest(node))
        .when(s["left"], digest(s["digest"], node))
        .otherwise(digest(node, s["digest"])),
    )


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, levels: int = LEVELS, other_leaf: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``path`` and ``other``.

    Leaves of one ``lang`` ascend by ``doc_id``; every two neighbouring nodes, the
    last one alone if it is odd, become one until one remains, the subroot.
    Subroots in the order of ``lang`` give the root likewise. ``other`` is
    ``other_leaf`` of the row, for checks against the tree; null by default.

    Rows without an id come first within their lang, and rows that share an id
    are ordered by leaf. Equal rows have a leaf each. A null lang is a group of
    its own, before all others; null fields and empty texts differ in the leaf.
    Other columns are ignored; no documents, no rows.
    """
    other = F.lit(None).cast("string") if other_leaf is None else other_leaf
    leaves = docs.select(
        _group_key(docs["lang"]).alias("grp"),
        docs["doc_id"].cast("long").alias("id"),
        row_digest(docs, fields).alias("leaf"),
        other.alias("other"),
    )
    # Equal leaves stand for equal rows.
    leaves = leaves.groupBy("grp", "id", "leaf").agg(F.min("other").alias("other"), F.count("*").alias("copies"))
    placed, groups = _placed(store(leaves, "leaves"))
    payload = ("id", "other")
    nodes = _spread(placed).withColumnRenamed("leaf", "digest").join(broadcast_if_small(groups, 128), "grp")
    steps, roots = grow(nodes, payload, levels)
    roots = store(roots, "roots")
    ordered = running_total(roots.withColumn("one", F.lit(1)), ["grp"], "one", "pos")
    over, root = grow(
        ordered.select(F.lit(0).alias("grp"), F.lit(roots.count()).cast("long").alias("n"), "pos", "digest", F.col("grp").alias("name")),
        ("name",),
        levels,
    )
    tops = root.select("grp", F.col("digest").alias("root"), F.array().cast("array<struct<left:boolean,digest:string>>").alias("path"))
    tops = store(
        paths(over, tops, ("name",), levels).select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), "root"),
        "tops",
    )
    found = paths(steps, tops, payload, levels)
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path", "other")


def tampered_leaf(docs: DataFrame, one_in: int = 7, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose ``n_chars`` is one more, where ``one_in`` divides the id's crc32; else null."""
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % one_in == 0
    more = docs["n_chars"].cast("decimal(38,0)") + 1
    return F.when(chosen, row_digest(docs, fields, n_chars=more))


def verify(found: DataFrame) -> DataFrame:
    """``manifest`` rows with ``proof_sha256``, ``folded_root`` and ``verified``.

    The row's ``other`` leaf, where it is not null, is folded in place of its own.
    """
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    rows = found.withColumn("proof_sha256", proof(F.col("path"))).withColumn("folded_root", folded)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

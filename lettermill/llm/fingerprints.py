"""Document fingerprints: threshold-scaled sketches of word shingles, by columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.text import let
from lettermill.llm.common import whole_text

WORDS = 5
ONE_IN = 8
DIGITS = 16
SPACES = r"[\x09-\x0D\x20]+"


def threshold(one_in: int = ONE_IN) -> str:
    """The hexadecimal bound below which one in ``one_in`` hashes lies."""
    return f"{(1 << 4 * DIGITS) // one_in:0{DIGITS}x}"


def _hash(split: Column, at: Column, words: int) -> Column:
    """MD5 of the shingle at a place counted from 0."""
    parts = [x for k in range(words) for x in (F.lit(" "), F.get(split, at + k))]
    return F.md5(F.concat(*parts[1:]))


def sketch(text: Column, words: int = WORDS, one_in: int = ONE_IN) -> Column:
    """Sorted hashes of the text's shingles that lie below a fixed fraction of all hashes.

    Words are runs of anything but ASCII white space, shingles ``words`` of them
    joined by blanks (fewer words: all of them), hashes the first 16 digits of
    their MD5. A text of which no hash lies below the bound keeps its least
    hash alone, so that short texts compare too. No words: an empty sketch. A
    sketch grows with its text, and the sketch of several texts is the sorted
    union of theirs without hashes above the bound (but for the least one).
    """
    bound = threshold(one_in)

    def of(split: Column) -> Column:
        n = F.size(split)
        places = F.sequence(F.lit(0), n - words)
        cut = lambda h: F.substring(h, 1, DIGITS)
        low = F.filter(places, lambda i: _hash(split, i, words) < bound)
        kept = F.array_sort(F.array_distinct(F.transform(low, lambda i: cut(_hash(split, i, words)))))
        least = F.array(cut(F.array_min(F.transform(places, lambda i: _hash(split, i, words)))))
        few = F.when(n > 0, F.array(cut(F.md5(F.concat_ws(" ", split))))).otherwise(F.array().cast("array<string>"))
        return F.when(n < words, few).otherwise(let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(least)))

    return let(F.filter(F.split(text, SPACES), lambda w: w != ""), of)


def merge(left: Column, right: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of two texts taken together (their shingles, not those across the seam)."""
    both = F.array_sort(F.array_union(left, right))
    low = F.filter(both, lambda h: h < threshold(one_in))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def resemblance(left: Column, right: Column) -> Column:
    """Estimated share of common shingles among all of two texts; two empty sketches: 1."""
    all_ = F.size(F.array_union(left, right))
    return F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / all_)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of one text's shingles that the other has; of an empty sketch: 1."""
    own = F.size(part)
    return F.when(own == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / own)


def with_next(docs: DataFrame, mark: Callable[[Column], Column], slices: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``mark`` of the text, and ``next_text`` and ``next_mark`` of the
    next row by descending ``doc_id`` (after the last: of the first).

    The ids are cut at approximate quantiles into ``slices`` of about equal
    size, each ordered by itself, and the first row of every slice is put
    behind the slice before it as a guest: one shuffle of the texts, and no
    task sees more than a slice. Ties are ordered by the text. Rows without an
    id have no place in the order: they are their own next.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    placed = rows.filter("doc_id is not null")
    slices = slices or min(2048, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / slices for k in range(1, slices)] or [0.5]
    cuts = placed.agg(F.percentile_approx("doc_id", shares, 10 * slices + 1000)).first()[0]
    number = _below(F.col("doc_id"), sorted(set(cuts or [])))
    sliced = placed.withColumn("slice", number).withColumn("guest", F.lit(0))
    # One row for each slice, at most ``slices``: its first id.
    heads = {r["slice"]: r["head"] for r in sliced.groupBy("slice").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    if order:
        follows = [(heads[b], a) for a, b in zip(order, order[1:] + order[:1], strict=True)]
        visits = spark.createDataFrame(follows, "doc_id bigint, slice int")
        first = Window.partitionBy("slice").orderBy("text")
        guests = (
            placed.join(F.broadcast(visits), "doc_id")
            .withColumn("rank", F.row_number().over(first))
            .filter("rank = 1")
            .select("doc_id", "text", "slice", F.lit(1).alias("guest"))
        )
        sliced = sliced.unionByName(guests)
    by_id = Window.partitionBy("slice").orderBy("guest", F.desc("doc_id"), "text")
    paired = (
        sliced.withColumn("mark", mark(F.col("text")))
        .withColumn("next_text", F.lead("text").over(by_id))
        .withColumn("next_mark", F.lead("mark").over(by_id))
        .filter("guest = 0")
    )
    alone = rows.filter("doc_id is null").withColumn("mark", mark(F.col("text")))
    alone = alone.withColumn("next_text", F.col("text")).withColumn("next_mark", F.col("mark"))
    columns = ["doc_id", "text", "mark", "next_text", "next_mark"]
    return paired.select(columns).union(alone.select(columns))


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the value, by halving."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > bounds[middle], half(middle + 1, high)).otherwise(half(low, middle))

    return half(0, len(bounds))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by as many first ones (or all) of the next."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """``doc_id`` and ``sketch`` of every row, null texts as empty; other columns are ignored."""
    return docs.select(docs["doc_id"].alias("doc_id"), sketch(whole_text(docs), words, one_in).alias("sketch"))


def edit_probe(docs: DataFrame, words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """Sketches of all texts and of their edited texts, and how alike they are.

    Columns ``doc_id``, ``text``, ``edited`` (see ``edited``), ``sketch``,
    ``edited_sketch``, ``next_sketch``. Null and empty texts have empty
    sketches and stay empty when edited; rows without an id are their own
    next, repeated rows follow each other in the order of their texts; other
    columns are ignored; no documents, no rows.
    """
    paired = with_next(docs, lambda text: sketch(text, words, one_in))
    changed = paired.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return changed.select(
        "doc_id", "text", "edited", F.col("mark").alias("sketch"),
        sketch(F.col("edited"), words, one_in).alias("edited_sketch"), F.col("next_mark").alias("next_sketch"),
    )

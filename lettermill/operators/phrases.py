"""Finding the entries of a phrase table in texts.

A short table becomes literals of the plan and needs no shuffle; at most
``small_rows`` rows of it are fetched to find out. A longer table is joined on
an anchor, the start of each phrase; no pair of text and phrase is formed
without a shared anchor. Its rows and bytes are checked: within bounds it is
broadcast, beyond them both sides are salted and shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lettermill.functions.text import first_rule, head, let, or_empty, pin, text_array
from lettermill.session import work_dir

SMALL_ROWS = 500
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 64
ANCHOR_CHARS = 3
BLOCK_CHARS = 512


def _rows_if_small(table: DataFrame, small_rows: int) -> list[Row] | None:
    """All rows of a short table, or None: never more than the bound is fetched."""
    rows = table.limit(small_rows + 1).collect() if small_rows else [None]
    return rows if len(rows) <= small_rows else None


def plain_words(text: Column) -> Column:
    """Letters and digits of a text as words joined by single spaces."""
    return F.trim(F.regexp_replace(or_empty(text), r"[^\p{L}\p{N}]+", " "))


def _stored(table: DataFrame, purpose: str) -> DataFrame:
    """A table that several steps read, worked out once."""
    path = work_dir(table.sparkSession, purpose)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _sizes(table: DataFrame, text: str, also: str, longest: Column) -> Row:
    """Rows and bytes of a stored table, and the size of its longest phrase."""
    size = F.octet_length(text) + F.coalesce(F.octet_length(also), F.lit(0))
    return table.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.max(longest).alias("longest")
    ).first()


def _fits(sizes: Row, rows: int) -> bool:
    return sizes["rows"] <= rows and (sizes["bytes"] or 0) <= BROADCAST_BYTES


def _salted_join(pieces: DataFrame, table: DataFrame, spread: str) -> DataFrame:
    """Pieces of text with the table rows that share their anchor, both sides shuffled.

    A frequent word may be the anchor of a third of all pieces. They are spread
    over ``SALTS`` tasks by the text they are from, each holding its own copy of
    the anchor's rows; the hint keeps the copies from being broadcast.
    """
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), ["__anchor", "__salt"]).drop("__salt")


def with_candidates(
    texts: DataFrame,
    gazetteer: DataFrame,
    text: Column,
    text_chars: int | None = None,
    small_rows: int = SMALL_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    out: str = "org_candidates",
) -> DataFrame:
    """Add the gazetteer names found in each text, in text order, longest first at a place.

    ``gazetteer`` has one column ``name``. Names match as whole words and with
    their case; names of the same words are all found. What is found depends on a
    row's text alone, so all forms give one answer, whatever ids repeat or are
    missing. A long gazetteer joins the texts back by a hash of the text, so hand over
    only the columns that are needed. A named-entity model can take this
    operator's place: any ``array<string>`` in text order will do.
    """
    named = pin(gazetteer.select(F.col("name").alias("__name")), "__words", plain_words(F.col("__name")))
    names = named.filter(F.col("__words") != "").distinct()
    searched = head(or_empty(text), text_chars)

    def order_and_name(found: Column) -> Column:
        return F.array_distinct(F.transform(F.array_sort(found), lambda f: f["__name"]))

    few = _rows_if_small(names, small_rows)
    if few is not None:
        plain = texts.withColumn("__plain", plain_words(searched))
        padded = plain.withColumn("__padded", F.concat(F.lit(" "), "__plain", F.lit(" ")))
        words = text_array([f" {row['__words']} " for row in few])
        labels = text_array([row["__name"] for row in few])
        table = F.arrays_zip(words.alias("words"), labels.alias("name"))
        placed = F.transform(
            F.filter(table, lambda n: F.contains(F.col("__padded"), n["words"])),
            lambda n: F.struct(
                F.instr(F.col("__padded"), n["words"]).alias("at"),
                (-F.length(n["words"])).alias("size"),
                n["name"].alias("__name"),
            ),
        )
        return padded.withColumn(out, order_and_name(placed)).drop("__plain", "__padded")

    anchored = names.withColumn("__anchor", F.split_part("__words", F.lit(" "), F.lit(1)))
    table = _stored(anchored, "gazetteer")
    sizes = _sizes(table, "__words", "__name", F.size(F.split("__words", " ")))
    key = F.md5(searched)
    words = texts.select(key.alias("__key"), F.split(plain_words(searched), " ").alias("__w"))
    placed = words.select(
        # The outer form: the other one makes Spark split every text once more to
        # leave out empty arrays first.
        "__key", "__w", F.posexplode_outer("__w").alias("at", "__anchor")
    )
    rest = F.concat(F.array_join(F.slice("__w", F.col("at") + 1, sizes["longest"] or 1), " "), F.lit(" "))
    if _fits(sizes, broadcast_rows):
        # Only words that begin a name are put together with those behind them.
        met = placed.join(F.broadcast(table), "__anchor").withColumn("__rest", rest)
    else:
        met = _salted_join(placed.select("__key", "at", "__anchor", rest.alias("__rest")), table, "__key")
    # The first place of each name is enough, however often a text repeats it.
    first = (
        met.filter(F.startswith("__rest", F.concat("__words", F.lit(" "))))
        .groupBy("__key", "__words", "__name")
        .agg(F.min("at").alias("at"))
    )
    found = first.groupBy("__key").agg(
        F.collect_list(
            F.struct("at", (-F.length("__words")).alias("size"), F.col("__name"))
        ).alias("__found")
    )
    return (
        texts.withColumn("__key", key)
        .join(found, "__key", "left")
        .select(
            *texts.columns, F.coalesce(order_and_name(F.col("__found")), text_array([])).alias(out)
        )
    )


def _substrings_of(text: Column, chars: int) -> Callable[[Column], Column]:
    return lambda start: F.substring(text, start, F.lit(chars))


def _blocks(text: Column, longest: int) -> Column:
    """The text in blocks, each with what a keyword that begins in it can reach of the next.

    A substring is counted off from the start of its string, so all substrings of
    a text take the square of its length; those of its blocks do not.
    """
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{max(BLOCK_CHARS, longest)}}}"), F.lit(0))

    def reaching(blocks: Column) -> Column:
        def more(at: Column) -> Column:
            return F.substring(F.coalesce(F.get(blocks, at + 1), F.lit("")), 1, longest - 1)

        return F.transform(blocks, lambda block, at: F.concat(block, more(at)))

    return let(cut, reaching)


def with_first_rule(
    texts: DataFrame,
    rule_table: DataFrame,
    text: Column,
    default: str,
    small_rows: int = SMALL_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    out: str = "job_board",
) -> DataFrame:
    """Add the value of the first rule, by priority, whose keyword occurs in the text.

    ``rule_table`` has ``priority, keyword, value``; keywords match anywhere in
    the lower-cased text. Without rules every text has the default. A long rule
    table takes time in proportion to a text's length.
    """
    table = rule_table.select(
        F.col("priority").alias("priority"),
        F.col("keyword").alias("__keyword"),
        F.col("value").alias("__value"),
    ).filter(or_empty(F.col("keyword")) != "")
    lower = F.lower(or_empty(text))

    few = _rows_if_small(table, small_rows)
    if few is not None:
        ordered = sorted((row["priority"], row["__keyword"], row["__value"]) for row in few)
        lowered = texts.withColumn("__lower", lower)
        value = first_rule(F.col("__lower"), [rule[1:] for rule in ordered], default)
        return lowered.withColumn(out, value).drop("__lower")

    anchor_chars = F.least(F.length("__keyword"), F.lit(ANCHOR_CHARS))
    anchored = table.withColumn("__anchor", F.substring("__keyword", F.lit(1), anchor_chars))
    table = _stored(anchored, "rules")
    sizes = _sizes(table, "__keyword", "__value", F.length("__keyword"))
    if not sizes["rows"]:
        return texts.withColumn(out, F.lit(default))
    key = F.md5(lower)
    # The key is worked out below the blocks, once a text and not once a block.
    lowered = texts.select(key.alias("__key"), lower.alias("__lower"))
    blocks = F.explode_outer(_blocks(F.col("__lower"), sizes["longest"]))
    blocks = lowered.select("__key", blocks.alias("__block"))
    pieces = None
    # At most ANCHOR_CHARS rows; a length that no keyword has is not looked for.
    for (chars,) in sorted(table.select(F.length("__anchor")).distinct().collect()):
        # Short keywords are their own anchor: each different piece of a block counts
        # once, so no letter that stands everywhere is met at every place.
        longest = chars if chars < ANCHOR_CHARS else sizes["longest"]
        starts = F.when(
            F.length("__block") >= chars, F.sequence(F.lit(1), F.length("__block") - chars + 1)
        )
        part = F.transform(starts, _substrings_of(F.col("__block"), longest))
        some = blocks.select("__key", F.explode_outer(F.array_distinct(part)).alias("__rest"))
        some = some.select("__key", "__rest", F.substring("__rest", 1, chars).alias("__anchor"))
        pieces = some if pieces is None else pieces.unionByName(some)
    if _fits(sizes, broadcast_rows):
        met = pieces.join(F.broadcast(table), "__anchor")
    else:
        met = _salted_join(pieces, table, "__key")
    found = (
        met.filter(F.startswith("__rest", F.col("__keyword")))
        .groupBy("__key")
        .agg(F.min_by("__value", F.struct("priority", "__keyword")).alias("__found"))
    )
    return (
        texts.withColumn("__key", key)
        .join(found, "__key", "left")
        .select(*texts.columns, F.coalesce("__found", F.lit(default)).alias(out))
    )

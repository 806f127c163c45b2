"""A multinomial Bayes classifier: one pass of token counts, all of it joins and sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.scoring import UNKNOWN, top_label, unless_blank
from lettermill.functions.text import or_empty, text_array
from lettermill.operators.phrases import _stored, plain_words
from lettermill.sources.files import split_known_labels

# Bounds of what is broadcast: words, and the bytes of all of them.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
# Longer words are the last to be broadcast.
_WORD_BYTES = 64


def tokens(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(plain_words(F.lower(or_empty(text))), " "), lambda w: w != "")


@dataclass
class BayesModel:
    """``counts``: ``token`` and ``counts`` (one number a label); ``texts`` and ``words``: totals a label."""

    labels: list[str]
    counts: DataFrame
    texts: list[int]
    words: list[int]
    vocabulary: int


def train_bayes(labelled: DataFrame, labels: Sequence[str] = tuple(rules.REJECTION_LABELS)) -> BayesModel:
    """Count the tokens of ``text`` by ``label``; rows with an unknown label are left out."""
    known, _ = split_known_labels(labelled, labels)
    each = known.select("label", tokens(F.col("text")).alias("__words"))
    each = each.select("label", F.explode_outer("__words").alias("token")).filter("token IS NOT NULL")
    # Counted by token and label first: a word that every text has is one row a task.
    counted = each.groupBy("token", "label").count()
    by_label = [F.sum(F.when(F.col("label") == label, F.col("count")).otherwise(0)) for label in labels]
    # Stored: the totals and every use of the model read it.
    counts = _stored(counted.groupBy("token").agg(F.array(*by_label).alias("counts")), "counts")
    texts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    totals = counts.agg(
        F.count(F.lit(1)).alias("vocabulary"),
        *[F.sum(F.col("counts")[k]).alias(f"words{k}") for k in range(len(labels))],
    ).first()
    return BayesModel(
        list(labels), counts, [texts.get(label, 0) for label in labels],
        [totals[f"words{k}"] or 0 for k in range(len(labels))], totals["vocabulary"],
    )


def save_bayes(model: BayesModel, path: str) -> BayesModel:
    """Write a model and return it as read back, so that its counts are worked out once."""
    spark = model.counts.sparkSession
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    totals = [(k, *row) for k, row in enumerate(zip(model.labels, model.texts, model.words, strict=True))]
    frame = spark.createDataFrame(totals, "place int, label string, texts long, words long")
    frame.withColumn("vocabulary", F.lit(model.vocabulary)).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return load_bayes(spark, path)


def load_bayes(spark: SparkSession, path: str) -> BayesModel:
    totals = sorted(spark.read.parquet(f"{path}/totals").collect(), key=lambda r: r["place"])
    return BayesModel(
        [r["label"] for r in totals], spark.read.parquet(f"{path}/counts"),
        [r["texts"] for r in totals], [r["words"] for r in totals], totals[0]["vocabulary"],
    )


def _head(model: BayesModel, broadcast_rows: int) -> tuple[Column, bool]:
    """Which words are broadcast, the most frequent that the bounds admit, and whether those are all.

    Frequency goes by levels of about 4%, of which at most some thousand reach the driver.
    """
    seen = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    level = F.floor(F.log2(F.greatest(seen, F.lit(1)).cast("double")) * 16).cast("int")
    level = F.when(F.octet_length("token") <= _WORD_BYTES, level).otherwise(-1)
    sizes = F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("token")).alias("bytes")
    words, size, least = 0, 0, None
    for row in sorted(model.counts.groupBy(level.alias("level")).agg(*sizes).collect(), reverse=True):
        words, size = words + row["words"], size + row["bytes"]
        if words > broadcast_rows or size > BROADCAST_BYTES:
            return (F.lit(False) if least is None else level >= least), False
        least = row["level"]
    return F.lit(True), True


def apply_bayes(
    model: BayesModel, df: DataFrame, text: str = "text", out: str = "label", score: str = "score",
    threshold: float = rules.LABEL_THRESHOLD, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the likeliest label of each text and its probability; labels never seen in training have none.

    The result depends on the text alone: tokens are summed by a hash of the
    text, and a text that occurs several times counts as one. The most frequent
    words, at most ``broadcast_rows`` and 32 MB, go to every task; only words of a
    text that are not among them are joined with the rest of the vocabulary.
    """
    # Never null, and known to be so: else the join would test the whole text for it in a filter.
    key = F.coalesce(F.unhex(F.md5(or_empty(F.col(text)))), F.lit(b""))
    n = len(model.labels)
    seen = [k for k in range(n) if model.texts[k]]
    if not seen:
        nothing = F.lit(None).cast("double").alias(score)
        return df.select("*", F.lit(UNKNOWN).alias(out), nothing)
    total = sum(model.texts)
    # The key and the words are worked out below the generator, once a text; its outer form
    # keeps Spark from splitting every text once more to leave out empty ones.
    keyed = df.select(key.alias("__key"), tokens(F.col(text)).alias("__words"))
    keyed = keyed.select("__key", F.posexplode_outer("__words").alias("__at", "token")).filter("token IS NOT NULL")
    # Copies of a text are told by its first word, so sums and copies come from one pass.
    first = F.count_if(F.col("__at") == 0).alias("__copies")
    in_head, whole = _head(model, broadcast_rows)
    weights = model.counts.select(
        "token", in_head.alias("__head"),
        *[F.log((F.col("counts")[k] + 1) / (model.words[k] + model.vocabulary)).alias(f"__w{k}") for k in seen],
    )
    unknown = {k: -math.log(max(1, model.words[k] + model.vocabulary)) for k in seen}
    known = [F.coalesce(f"__w{k}", F.lit(unknown[k])) for k in seen]
    # Checked rows and bytes: words stay where they are.
    met = keyed.join(F.broadcast(weights.filter("__head").drop("__head")), "token", "left")
    if whole:
        # A task sends one row a text.
        sums = met.groupBy("__key").agg(first, *[F.sum(w).alias(f"__s{k}") for k, w in zip(seen, known, strict=True)])
    else:
        # A task sends one row for all broadcast words of a text and one for each other word. The
        # first goes by the text's key, spelled as no word is: nulls would all meet in one task.
        own = F.concat(F.lit(" "), F.hex("__key"))
        each = met.withColumn("token", F.when(F.col(f"__w{seen[0]}").isNull(), F.col("token")).otherwise(own))
        each = each.groupBy("__key", "token").agg(
            first, F.count(F.lit(1)).alias("__n"), *[F.sum(f"__w{k}").alias(f"__s{k}") for k in seen]
        )
        rest = weights.filter("NOT __head").drop("__head")
        summed = [
            F.sum(F.coalesce(f"__s{k}", F.col("__n") * w)).alias(f"__s{k}") for k, w in zip(seen, known, strict=True)
        ]
        sums = each.join(rest, "token", "left").groupBy("__key").agg(F.sum("__copies").alias("__copies"), *summed)
    prior = [math.log(model.texts[k] / total) if k in seen else None for k in range(n)]
    likely = [
        F.col(f"__s{k}") / F.col("__copies") + prior[k] if k in seen else F.lit(None).cast("double") for k in range(n)
    ]
    logs = sums.withColumn("__logs", F.array(*likely)).withColumn("__most", F.array_max("__logs"))
    rest = F.aggregate(
        "__logs", F.lit(0.0), lambda s, x: s + F.coalesce(F.exp(x - F.col("__most")), F.lit(0.0))
    )
    chances = F.transform("__logs", lambda x: F.coalesce(F.exp(x - F.col("__most")), F.lit(0.0)) / F.col("__rest"))
    scored = logs.withColumn("__rest", rest).select("__key", chances.alias("__chances"))
    # A text without words has the shares of the labels.
    shares = F.array(*[F.lit(model.texts[k] / total) for k in range(n)])
    # Blank texts are told before the join, which then needs no text unless the caller keeps it.
    blank = unless_blank(F.col(text), F.lit(None).cast("string"))
    found = df.withColumns({"__key": key, "__blank": blank}).join(scored, "__key", "left")
    found = found.withColumn("__chances", F.coalesce("__chances", shares))
    label = top_label(text_array(model.labels), F.col("__chances"), threshold)
    return found.select(
        *df.columns, F.coalesce("__blank", label).alias(out), F.array_max("__chances").alias(score)
    )

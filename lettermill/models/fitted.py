"""A text classifier fitted with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.scoring import label_id, top_label, unless_blank
from lettermill.functions.text import first_words, or_empty, text_array
from lettermill.sources.files import split_known_labels

SEED = 42
TRAIN_SHARE = 0.85


def _drawn(share: float, columns: Sequence[str], seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) < int(share * 1_000_000)


def split_rows(df: DataFrame, share: float, *columns: str, seed: int = SEED):
    """A random split that depends only on a row's content and the seed.

    A lost task that runs again puts each row where it was, and no sort is needed.
    """
    first = _drawn(share, columns, seed)
    return df.filter(first), df.filter(~first)


def _shorten(df: DataFrame, text: str, words: int | None) -> DataFrame:
    return df.withColumn("__short", first_words(or_empty(F.col(text)), words))


def train(
    labelled: DataFrame,
    epochs: int = 3,
    steps_per_epoch: int = 10,
    labels: Sequence[str] = tuple(rules.REJECTION_LABELS),
    words: int | None = None,
    features: int = 1 << 14,
    id_columns: Sequence[str] = ("text",),
) -> tuple[PipelineModel, list[float]]:
    """Fit on 85% of ``text, label``; keep the epoch with the lowest held-out loss.

    Rows with an unknown label are left out. The texts are read once: only their
    word counts are kept for the passes that follow. Returns the model and each
    epoch's held-out log loss.
    """
    known, _ = split_known_labels(labelled, labels)
    marked = known.withColumns(
        {
            "__label": label_id(F.col("label"), labels).cast("double"),
            "__train": _drawn(TRAIN_SHARE, id_columns, SEED),
        }
    )
    tokenizer = RegexTokenizer(inputCol="__short", outputCol="__tokens", pattern=r"[^\p{L}\p{N}']+")
    counter = HashingTF(inputCol="__tokens", outputCol="__counts", numFeatures=features)
    counts = PipelineModel([tokenizer, counter]).transform(_shorten(marked, "text", words))
    counts = counts.select("__label", "__train", "__counts").persist()
    evaluator = MulticlassClassificationEvaluator(
        labelCol="__label", predictionCol="__prediction", metricName="logLoss"
    )
    losses: list[float] = []
    best = None
    try:
        weights = IDF(inputCol="__counts", outputCol="features").fit(counts.filter("__train"))
        weighted = weights.transform(counts)
        for epoch in range(1, epochs + 1):
            model = LogisticRegression(
                labelCol="__label",
                family="multinomial",
                maxIter=epoch * steps_per_epoch,
                regParam=0.01,
                predictionCol="__prediction",
                probabilityCol="probability",
            ).fit(weighted.filter("__train"))
            loss = evaluator.evaluate(model.transform(weighted.filter("NOT __train")))
            if best is None or loss < min(losses):
                best = model
            losses.append(loss)
    finally:
        counts.unpersist()
    return PipelineModel([tokenizer, counter, weights, best]), losses


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_exists(spark: SparkSession, path: str) -> bool:
    """Whether a saved model lies at the path, on whatever file system it names."""
    try:
        return not spark.read.text(f"{path}/metadata").isEmpty()
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return False


def apply_model(
    model: PipelineModel,
    df: DataFrame,
    text: str = "text",
    out: str = "label",
    threshold: float = rules.LABEL_THRESHOLD,
    labels: Sequence[str] = tuple(rules.REJECTION_LABELS),
    words: int | None = None,
    score: str | None = None,
) -> DataFrame:
    """Add the label of each text, and its score when ``score`` names a column."""
    scored = model.transform(_shorten(df, text, words)).select(
        *df.columns, vector_to_array("probability").alias("__scores")
    )
    label = top_label(text_array(labels), F.col("__scores"), threshold)
    found = {out: unless_blank(F.col(text), label)}
    if score is not None:
        found[score] = F.array_max("__scores")
    return scored.withColumns(found).drop("__scores")

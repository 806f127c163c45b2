"""Small tables for the operators' tests."""

from __future__ import annotations

import zlib
from functools import cache

import duckdb
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long text of words " * 30_000


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], extra: str | None = None) -> DataFrame:
    """Documents with the given ids and texts; ``extra`` names a clashing column."""
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 1 else f"src{k % 2}", None) for k, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame if extra is None else frame.selectExpr("*", f"'kept' AS {extra}")


# Null id, null text, empty and white texts, a very long one, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "no id here at all"), (None, None), (4, LONG), (5, "one"),
    (6, "tie of ids"), (6, "tie of other texts"), (7, "same row twice"), (7, "same row twice"), (8, "üñí\x1c　 <|endoftext|> x"),
]


@cache
def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts_of(sf_dir: str) -> dict[int, str]:
    return dict(duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


def labels_of(sf_dir: str, column: str) -> dict[int, int]:
    return dict(duckdb.execute(f"SELECT doc_id, {column} FROM '{sf_dir}/labels.parquet'").fetchall())


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2

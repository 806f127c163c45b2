"""URL filters: a blocked Bloom filter before an exact join, and host and path rules, by columns only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import fresh, store

BITS_EACH = 16
HASHES = 6
BLOCK_BITS = 256
WORD_BITS = 64
BROADCAST_BYTES = 64 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without a host mark."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and ``m.``, and path without a closing slash or ``.html``; null without a host."""
    short = F.regexp_replace(host(url), r"^(?:www|m)\.", "")
    clean = F.regexp_replace(path(url), r"(?:\.html|/+)\z", "")
    return F.when(short != "", F.concat(short, clean))


def rule_for(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of the rules (host, path, verdict) that fit, as ``rule`` and ``verdict``; else null.

    A rule fits its host and all subdomains if the path starts with its own.
    """
    out = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _words() -> int:
    return BLOCK_BITS // WORD_BITS


def _marks(key: Column, hashes: int) -> list[Column]:
    """The bits of a key in its block, a mask for each word of the block."""
    bits = [F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(BLOCK_BITS)).cast("int") for k in range(hashes)]
    out = []
    for w in range(_words()):
        mask = F.lit(0).cast("long")
        for bit in bits:
            here = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(WORD_BITS)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.floor(bit / WORD_BITS) == w, here).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, blocks: int, hashes: int = HASHES) -> DataFrame:
    """The filter of ``listed.key``: one row ``block``, ``w0``, ``w1``, ... for each block in use."""
    key = F.col("key")
    marked = listed.select(
        _block(key, blocks).alias("block"), *[m.alias(f"w{w}") for w, m in enumerate(_marks(key, hashes))]
    )
    return marked.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(_words())])


def listed_urls(
    rows: DataFrame, key: Column, listed: DataFrame, bits_each: int = BITS_EACH, hashes: int = HASHES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``rows`` with a column ``listed``: whether ``key`` is among ``listed.key``.

    The filter's blocks are looked up first; only rows whose bits are all set
    go on to the exact join, which removes false positives. The filter is
    broadcast if its counted blocks take at most ``broadcast_bytes``, else
    joined by block. A null key is never listed; keys may repeat on both
    sides; an empty list lists nothing. The rows keep their columns.
    """
    keys = store(listed.select("key").filter("key is not null").distinct(), "listed")  # read three times
    n = keys.count()
    blocks = max(1, -(-n * bits_each // BLOCK_BITS))
    filter_ = bloom(keys, blocks, hashes)
    if blocks * (8 + BLOCK_BITS // 8) <= broadcast_bytes:
        filter_ = F.broadcast(filter_)
    own, block = fresh(rows, "url_key"), fresh(rows, "url_block")
    words = [fresh(rows, f"url_w{w}") for w in range(_words())]
    for w, name in enumerate(words):
        filter_ = filter_.withColumnRenamed(f"w{w}", name)
    keyed = rows.withColumn(own, key)
    keyed = keyed.withColumn(block, _block(F.col(own), blocks))
    met = keyed.join(filter_.withColumnRenamed("block", block), block, "left")
    passes = F.col(own).isNotNull()
    for name, mark in zip(words, _marks(F.col(own), hashes), strict=True):
        passes = passes & (F.coalesce(F.col(name), F.lit(0).cast("long")).bitwiseAND(mark) == mark)
    flag, given = fresh(rows, "url_listed"), [F.col(f"`{c}`") for c in rows.columns]
    exact = keys.select(F.col("key").alias(own), F.lit(True).alias(flag))
    possible = met.filter(passes).join(exact, own, "left")
    stopped = met.filter(~passes).select(*given, F.lit(False).alias("listed"))
    return possible.select(*given, F.coalesce(F.col(flag), F.lit(False)).alias("listed")).union(stopped)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]],
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` of every row of ``pages``.

    The longest rule that fits decides; where none does, a page is blocked if
    its canonical url is among ``listed.key``. A null url, or one without
    ``://``, has an empty host and path, fits no rule, is not listed and so
    allowed. Repeated rows are judged each; other columns are ignored.
    """
    rows = pages.select(
        pages["page_id"].alias("page_id"), host(pages["url"]).alias("host"), path(pages["url"]).alias("path"),
        canonical(pages["url"]).alias("canonical"),
    )
    judged = listed_urls(rows, F.col("canonical"), listed)
    found = rule_for(F.col("host"), F.col("path"), rules)
    fallback = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", fallback).alias("verdict"), "listed",
    )

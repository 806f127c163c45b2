"""Collocations: frequent phrases of two to four words, scored by how they hold together.

Words get ids by frequency, so pairs that occur much lie in a corner of the
square of id pairs. That corner is cut into tiles, and a tile with many
occurrences is counted in place, one array cell a pair; all else is counted as
sorted codes. Frequent pairs are ranked anew and take the place of the first
word for triples, and so on. Tasks count what they read, Spark adds up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import broadcast_if_small, running_total, store, text_slices, whole_text

LONGEST, LEAST, TOP = 4, 30, 2000
# Bounds of what is broadcast: words and their bytes, phrases with a rank, bits of the filter.
HEAD, HEAD_BYTES = 1 << 18, 64
RANKED = 1 << 19
FILTER_BITS = 28
# A tile is _SIDE x _SIDE cells, the tiled corner _TILES x _TILES tiles.
_SIDE, _TILES, _DENSE = 1 << 10, 4, 1 << 16
# Words counted at a time, and rows of a batch that a task hands over: both bound its memory.
_SLICE_BYTES, _TOKENS, _BLOB, _ROWS = 2 << 20, 1 << 18, 1 << 16, 1 << 15
_SALTS = 64
# Numbers of phrases without a rank start here.
_UNRANKED = 1 << 30
_BREAKS = r"[.,;:!?\x0A-\x0D]"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of every token (-1: a break between pieces), the codes' words, and tokens a row."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), _BREAKS, " . ")
    lists = pc.ascii_split_whitespace(marked)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    words = encoded.dictionary
    # A blank at either end of a text gives an empty token: a break as well.
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for odd in ("", "."):
        at = pc.index(words, pa.scalar(odd, words.type)).as_py()
        codes[codes == at] = -1
    return codes, words, lengths


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word`` and ``n`` of every word; null is ``und`` among langs and empty among texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, _SLICE_BYTES):
                langs = pc.dictionary_encode(part.column("lang"))
                codes, words, lengths = _tokens(part.column("text"))
                lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
                keep = codes >= 0
                keys, n = np.unique(lang[keep] * max(1, len(words)) + codes[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(keys // max(1, len(words)))),
                        words.take(pa.array(keys % max(1, len(words)))),
                        pa.array(n, pa.int64()),
                    ],
                    ["lang", "word", "n"],
                )
            # The batch goes before the next one is read.
            part = batch = None
        pa.default_memory_pool().release_unused()

    rows = docs.select(_lang(docs).alias("lang"), whole_text(docs).alias("text"))
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit("und"))


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """``id``, ``lang``, ``word``, ``n`` of words that occur ``least`` times; ids from 0 by falling ``n``."""
    often = counts.filter(F.col("n") >= least).withColumn("falling", -F.col("n")).withColumn("one", F.lit(1))
    return running_total(often, ["falling", "lang", "word"], "one", "id").select("id", "lang", "word", "n")


def _hashed_words(lang: str, words: pa.Array) -> np.ndarray:
    """A number for each word of a lang, which must not be null. Different words may share one; a join tells."""
    words = words.cast(pa.string())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    letters = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    ends = ends - ends[0]
    with np.errstate(over="ignore"):
        # Sums of bytes by the powers of an odd number; those of its inverse take a word's place out again.
        sums = np.concatenate(([np.uint64(0)], np.cumsum(letters * _powers(_BASE, len(letters)))))
        hashed = (sums[ends[1:]] - sums[ends[:-1]]) * _powers(_INVERSE, len(letters) + 1)[ends[:-1]]
    return _mixed(hashed, np.array([zlib.crc32(lang.encode("utf-8", "surrogatepass"))]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, ``base``, its square ..., ``n`` of them, modulo 2 ** 64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def _tail_filter(tail: DataFrame, n: int, filter_bits: int) -> Filter:
    """Hashed bits of the ``n`` words that are not broadcast, never without one that is there."""

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        langs = pc.dictionary_encode(batch.column("lang"))
        lang, out = langs.indices.to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.uint64)
        for k, name in enumerate(langs.dictionary.to_pylist()):
            mine = lang == k
            out[mine] = _hashed_words(name, batch.column("word").filter(pa.array(mine)))
        return out

    return Filter.of(tail.select("lang", "word"), hashed, n, filter_bits)


def encode(docs: DataFrame, head: DataFrame, tail: DataFrame | None, filter_bits: int) -> DataFrame:
    """``ids``: word ids of many texts in a row as 32-bit numbers, -1 between pieces and for other words.

    Words of ``head`` are broadcast. Those that may be in ``tail``, by a filter,
    stand as -2 and less, for the places in their blob's list of such words, until
    a join has found their ids: neither texts nor other words are shuffled.
    """
    table = head.select("lang", "word", "id").orderBy("id").toArrow()
    langs = pc.unique(table["lang"]).to_pylist()
    by_lang = {k: table.filter(pc.equal(table["lang"], k)).combine_chunks() for k in langs}
    known_words = {k: (pa.array(t["word"].to_pylist(), pa.string()), t["id"].to_numpy()) for k, t in by_lang.items()}
    n_tail = 0 if tail is None else tail.count()
    held = _tail_filter(tail, n_tail, filter_bits) if n_tail else None
    near = docs.sparkSession.sparkContext.broadcast((known_words, held))

    def ids_of(part: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
        """Ids of the part's words, and the words that may be in the tail: -2 - k is the k-th of them."""
        head_words, tail_filter = near.value
        codes, words, lengths = _tokens(part.column("text"))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        langs = pc.dictionary_encode(part.column("lang"))
        lang = langs.indices.to_numpy(zero_copy_only=False)[rows]
        ids = np.full(len(codes), -1, np.int32)
        own_langs, own_words, n_own = [pa.array([], pa.string())], [pa.array([], pa.string())], 0
        for k, name in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero((lang == k) & (codes >= 0))
            number = np.full(len(words), -1, np.int32)
            if name in head_words:
                known, numbers = head_words[name]
                at = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
                number = np.where(at >= 0, numbers[at], -1).astype(np.int32)
            if tail_filter is not None:
                there = np.zeros(len(words), bool)
                there[codes[mine]] = True
                other = np.flatnonzero(there & (number < 0))
                other = other[tail_filter.may_hold(_hashed_words(name, words.take(pa.array(other))))]
                number[other] = -2 - n_own - np.arange(len(other))
                own_langs.append(pa.array([name] * len(other), pa.string()))
                own_words.append(words.take(pa.array(other)).cast(pa.string()))
                n_own += len(other)
            ids[mine] = number[codes[mine]]
        # A gap before each text.
        spaced = np.full(len(ids) + len(lengths), -1, np.int32)
        spaced[np.arange(len(ids)) + rows + 1] = ids
        own = pa.StructArray.from_arrays([pa.concat_arrays(own_langs), pa.concat_arrays(own_words)], ["lang", "word"])
        return _one_gap(spaced), own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, _SLICE_BYTES):
                ids, own = ids_of(part)
                blobs, lists = [], []
                for blob in np.split(ids, _cuts(ids)):
                    waits = blob < -1
                    places, numbers = np.unique(-2 - blob[waits], return_inverse=True)
                    blob[waits] = -2 - numbers
                    blobs.append(blob.astype("<i4").tobytes())
                    lists.append(places)
                columns = [pa.array(blobs, pa.binary())]
                if n_tail:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), own.take(pa.array(np.concatenate(lists)))))
                yield pa.RecordBatch.from_arrays(columns, ["ids", "own"][: len(columns)])
            part = batch = None
        pa.default_memory_pool().release_unused()

    rows = docs.select(_lang(docs).alias("lang"), whole_text(docs).alias("text"))
    if not n_tail:
        return rows.mapInArrow(run, "ids binary")
    blobs = rows.mapInArrow(run, "ids binary, own array<struct<lang:string,word:string>>")
    blobs = store(blobs.withColumn("blob", F.monotonically_increasing_id()), "blobs")
    wanted = blobs.select("blob", F.posexplode("own").alias("k", "w")).select("blob", "k", "w.lang", "w.word")
    rare = broadcast_if_small(tail.select("lang", "word", "id"), 256, rows=n_tail)
    # Place and id in one number.
    found = wanted.join(rare, ["lang", "word"]).select(
        "blob", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("id").cast("long")).alias("found")
    )
    found = found.groupBy("blob").agg(F.collect_list("found").alias("found")).hint("merge")
    return blobs.select("blob", "ids").join(found, "blob", "left").select("ids", "found").mapInArrow(_put, "ids binary")


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs with the ids of their list's words in place; words without one are gaps."""
    for batch in batches:
        for blob, found in zip(batch.column("ids"), batch.column("found"), strict=True):
            # Copied: the buffer is not to be written to.
            ids = np.frombuffer(blob.as_buffer(), "<i4").copy()
            waits = ids < -1
            if waits.any():
                at = -2 - ids[waits]
                numbers = np.full(int(at.max()) + 1, -1, np.int32)
                if found.is_valid:
                    pairs = found.values.to_numpy()
                    numbers[pairs >> 32] = pairs & 0xFFFFFFFF
                ids[waits] = numbers[at]
            yield pa.RecordBatch.from_arrays([pa.array([_one_gap(ids).tobytes()], pa.binary())], ["ids"])
    pa.default_memory_pool().release_unused()


def _one_gap(ids: np.ndarray) -> np.ndarray:
    """``ids`` with one gap for several in a row, which say no more."""
    gap = ids == -1
    return ids[~(gap & np.concatenate(([False], gap[:-1])))]


def _cuts(ids: np.ndarray) -> list[int]:
    """Where to cut ``ids`` into parts of at least ``_BLOB`` words: at gaps, so that no phrase is cut."""
    gaps, out, at = np.flatnonzero(ids == -1), [], 0
    while (k := int(np.searchsorted(gaps, at + _BLOB))) < len(gaps):
        at = int(gaps[k])
        out.append(at)
    return out


def _mixed(hashed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from the hash of its beginning and its last word."""
    with np.errstate(over="ignore"):
        out = (hashed ^ (word.astype(np.uint64) + np.uint64(1))) * _MIX
        return out ^ (out >> np.uint64(29))


def _slot(hashed: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashed * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """Hashed bits of some rows, never without one that is there."""

    def __init__(self, bits: int, held: np.ndarray):
        self.bits, self.held = bits, held

    @classmethod
    def of(cls, rows: DataFrame, hashed: Callable[[pa.RecordBatch], np.ndarray], n: int, most_bits: int) -> Filter:
        """The filter of ``n`` rows, of which ``hashed`` gives a batch's hashes; 2 ** ``most_bits`` bits at most."""
        bits = int(min(most_bits, max(15, (16 * n).bit_length())))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = np.unique(_slot(hashed(batch), bits))
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 15), pa.array(slot & 0x7FFF)], ["bucket", "bit"])

        marks = rows.mapInArrow(mark, "bucket long, bit long")
        maps = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
        held = np.zeros(1 << (bits - 3), np.uint8)
        for bucket, part in zip(maps["bucket"].to_pylist(), maps["bits"].to_pylist(), strict=True):
            held[bucket << 12 : (bucket + 1) << 12] = np.frombuffer(part, np.uint8)
        return cls(bits, held)

    def may_hold(self, hashed: np.ndarray) -> np.ndarray:
        slot = _slot(hashed, self.bits)
        return (self.held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


class Often:
    """What tasks know of the frequent phrases of some length, bounded at every size.

    ``filter``: hashed bits of all of them, never without one that is there.
    ``codes``: those with a rank, as (rank of the beginning, last word), and their ranks.
    """

    def __init__(self, filter: Filter, codes: np.ndarray, ranks: np.ndarray):
        self.filter, self.codes, self.ranks = filter, codes, ranks

    def rank(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Ranks of phrases, -1 without one."""
        if not len(self.codes):
            return np.full(len(first), -1, np.int64)
        code = (first << 32) | last
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((first >= 0) & (self.codes[at] == code), self.ranks[at], -1)


def often(grams: DataFrame, words: int, below: list[Often], ranked: int, filter_bits: int) -> Often:
    """The bounded knowledge of ``grams`` (``w0``, ``w1``, ..., ``n``), of which ``below`` is that of shorter ones.

    At most ``ranked`` of the most frequent reach the driver, and the filter's bits.
    """
    names = [f"w{k}" for k in range(words)]
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted(grams.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in levels:
        if total + row["count"] > ranked:
            break
        total, least = total + row["count"], row["level"]

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(words)]
        out = columns[0].astype(np.uint64)
        for column in columns[1:]:
            out = _mixed(out, column)
        return out

    filter = Filter.of(grams.select(*names), hashed, sum(r["count"] for r in levels), filter_bits)
    if least is None:
        return Often(filter, np.zeros(0, np.int64), np.zeros(0, np.int64))
    top = grams.filter(level >= least).select(*names, "n").toArrow()
    columns = [top[name].to_numpy().astype(np.int64) for name in names]
    order = np.lexsort([*reversed(columns), -top["n"].to_numpy()])
    first = columns[0][order]
    for k in range(1, words - 1):
        first = below[k - 1].rank(first, columns[k][order])
    known = first >= 0
    codes = (first[known] << 32) | columns[-1][order][known]
    by_code = np.argsort(codes)
    return Often(filter, codes[by_code], np.flatnonzero(known)[by_code])


def count_pairs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of ranks and how often each occurs.

    Pairs of small ranks fall into tiles; a tile with enough of them is counted
    by direct address. The others are sorted codes with run lengths.
    """
    out = []
    corner = _SIDE * _TILES
    near = (first < corner) & (last < corner)
    sparse = ~near
    if near.any():
        tile = np.where(near, (first // _SIDE) * _TILES + last // _SIDE, -1)
        for k in np.flatnonzero(np.bincount(tile[near], minlength=1) >= _DENSE):
            mine = tile == k
            cell = (first[mine] % _SIDE) * _SIDE + last[mine] % _SIDE
            n = np.bincount(cell, minlength=_SIDE * _SIDE)
            at = np.flatnonzero(n)
            out.append((k // _TILES * _SIDE + at // _SIDE, k % _TILES * _SIDE + at % _SIDE, n[at]))
            tile[mine] = -1
        sparse |= tile >= 0
    codes, n = np.unique((first[sparse] << 32) | last[sparse], return_counts=True)
    out.append((codes >> 32, codes & 0xFFFFFFFF, n))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def count_phrases(ids: np.ndarray, words: int, known: list[Often]) -> list[np.ndarray]:
    """Columns ``w0``, ``w1``, ..., ``n`` of the phrases of ``words`` words in ``ids`` that may be frequent.

    Phrases are pairs of their beginning and their last word. Beginnings with a
    rank are told apart by it; others get a number for the time of the count.
    """
    starts = len(ids) - words + 1
    if starts <= 0:
        return [np.zeros(0, np.int64)] * (words + 1)
    at = np.flatnonzero(ids[:starts] >= 0)
    for k in range(1, words):
        at = at[ids[at + k] >= 0]
    if words > 2:
        # Both the phrase without its last and without its first word must be frequent.
        for shift in (0, 1):
            hashed = ids[at + shift].astype(np.uint64)
            for k in range(1, words - 1):
                hashed = _mixed(hashed, ids[at + shift + k])
            at = at[known[words - 3].filter.may_hold(hashed)]
    first = ids[at].astype(np.int64)
    for k in range(1, words - 1):
        first = known[k - 1].rank(first, ids[at + k].astype(np.int64))
    if words > 2:
        other = first < 0
        if other.any():
            begin = np.stack([ids[at[other] + k] for k in range(words - 1)], 1)
            first[other] = _UNRANKED + _numbered(begin)
        # Where each beginning stands, to spell it again.
        different, where = np.unique(first, return_index=True)
    first, last, n = count_pairs(first, ids[at + words - 1].astype(np.int64))
    if words == 2:
        return [first, last, n]
    begins = at[where[np.searchsorted(different, first)]]
    return [*(ids[begins + k].astype(np.int64) for k in range(words - 1)), last, n]


def _numbered(rows: np.ndarray) -> np.ndarray:
    """A number for each row of small non-negative numbers, the same for equal rows."""
    out = np.unique(rows[:, 0], return_inverse=True)[1].astype(np.int64)
    for k in range(1, rows.shape[1]):
        out = np.unique((out << 32) | rows[:, k], return_inverse=True)[1].astype(np.int64)
    return out


def counted_parts(blobs: Iterator[pa.Buffer], words: int, known: list[Often]) -> Iterator[pa.RecordBatch]:
    """Phrases of blobs, two words a code, in batches of at most ``_ROWS`` rows.

    ``_TOKENS`` words and the rest of a blob are counted at a time.
    """

    def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # A blob ends before a gap, and the next begins with it.
        *columns, n = count_phrases(np.concatenate(parts), words, known)
        columns = [*(_pair(*columns[k : k + 2]) for k in range(0, words, 2)), n]
        for at in range(0, len(n), _ROWS):
            rows = [pa.array(c[at : at + _ROWS], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(rows, _codes(words) + ["n"])

    parts, held = [], 0
    for blob in blobs:
        # Copied: the batch's memory is not kept.
        parts.append(np.frombuffer(blob, "<i4").copy())
        held += len(parts[-1])
        if held >= _TOKENS:
            yield from counted(parts)
            parts, held = [], 0
    if parts:
        yield from counted(parts)
    del parts
    # The worker outlives the task.
    pa.default_memory_pool().release_unused()


def _pair(first: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    return first if last is None else (first << 32) | last


def _codes(words: int) -> list[str]:
    return [f"c{k}" for k in range(0, words, 2)]


def phrase_counts(blobs: DataFrame, words: int, least: int, known: Broadcast | None) -> DataFrame:
    """``w0``, ``w1``, ... and ``n`` of all phrases of ``words`` words that occur ``least`` times."""
    codes = _codes(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers = (blob.as_buffer() for batch in batches for blob in batch.column("ids"))
        yield from counted_parts(buffers, words, known.value if known else [])

    rows = blobs.mapInArrow(run, ", ".join(f"{c} long" for c in [*codes, "n"]))
    # Two words a code: a task's table of phrases and the shuffle are of few numbers.
    counts = rows.groupBy(*codes).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    spelled = []
    for k in range(words):
        code = F.col(f"c{k - k % 2}")
        if k % 2:
            code = code.bitwiseAND(0xFFFFFFFF)
        elif k + 1 < words:
            code = F.shiftright(code, 32)
        spelled.append(code.alias(f"w{k}"))
    return counts.select(*spelled, "n")


def _named(df: DataFrame, id_column: str, head: DataFrame, tail: DataFrame | None, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` of the vocabulary row whose id is in ``id_column``.

    Frequent words, which many rows share, are broadcast (at most ``HEAD``).
    """
    same = F.col(id_column) == F.col("id")
    out = df.join(F.broadcast(head.select("id", *names)), same).drop("id")
    if tail is None:
        return out
    rest = df.join(F.broadcast(head.select("id")), same, "left_anti")
    return out.unionByName(rest.join(tail.select("id", *names), same).drop("id"))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, head: int = HEAD, ranked: int = RANKED, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each lang's best phrases.

    A-Z are lower-cased; texts fall into pieces at ``.,;:!?`` and line breaks,
    and pieces into words at blanks and tabs. ``n`` counts a lang's words and
    ``a`` a phrase's occurrences, ``least`` at the least. ``l`` and ``r`` are those of the
    two parts at the cut with the smallest score, floor(2,000,000 a / (l + r)).
    A phrase goes if a longer one holds it and occurs 0.8 times as often. ``top`` by
    score, then ``a``, both falling, then the phrase in byte order.

    A null lang is ``und``, null and empty texts hold no words, repeated rows
    count each, other columns are ignored; no documents, no rows. ``head``,
    ``ranked`` and ``filter_bits`` bound what is broadcast; results don't depend on them.
    """
    counts = store(word_counts(docs), "words")
    totals = store(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    vocab = store(vocabulary(counts, least), "vocabulary")
    near = store(vocab.filter((F.col("id") < head) & (F.octet_length("word") <= HEAD_BYTES)), "head")
    tail = vocab.join(F.broadcast(near.select("id")), "id", "left_anti")
    tail = None if tail.isEmpty() else store(tail, "tail")
    blobs = store(encode(docs, near, tail, filter_bits), "ids")
    context = docs.sparkSession.sparkContext
    known, tables = [], [vocab.select(F.array("id").alias("gram"), F.col("n").alias("f"))]
    for words in range(2, LONGEST + 1):
        grams = phrase_counts(blobs, words, least, context.broadcast(known) if known else None)
        grams = store(grams, f"phrases{words}")
        tables.append(grams.select(F.array(*[f"w{k}" for k in range(words)]).alias("gram"), F.col("n").alias("f")))
        if words < LONGEST:
            known = [*known, often(grams, words, known, ranked, filter_bits)]
    frequent = tables[0]
    for t in tables[1:]:
        frequent = frequent.union(t)
    kept = store(_outlasting(frequent), "kept")
    named = _named(
        _scored(kept, frequent).withColumn("w0", F.col("gram")[0]), "w0", near, tail, "lang"
    ).drop("w0")
    best = named.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS)))
    by_score = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    # All that tie with the last go on, until the words are known.
    best = store(best.withColumn("at", F.rank().over(by_score)).filter(F.col("at") <= top).drop("at", "salt"), "best")
    spelled = _named(
        best.select("gram", F.posexplode("gram").alias("k", "wk")), "wk", near, tail, "word"
    )
    spelled = spelled.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    rows = best.join(spelled, "gram").select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return rows.join(broadcast_if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _outlasting(frequent: DataFrame) -> DataFrame:
    """Phrases of two words and more that no longer phrase holds almost as often."""
    longer = frequent.filter(F.size("gram") > 2)
    sizes = F.sequence(F.lit(2), F.size("gram") - 1)
    parts = longer.withColumn("size_", F.explode(sizes))
    parts = parts.withColumn("from_", F.explode(F.sequence(F.lit(1), F.size("gram") - F.col("size_") + 1)))
    held = parts.groupBy(F.slice("gram", F.col("from_"), F.col("size_")).alias("gram")).agg(F.max("f").alias("longer"))
    rows = frequent.filter(F.size("gram") > 1).join(held, "gram", "left")
    wide = "decimal(38,0)"
    gone = F.col("longer").cast(wide) * 100 >= F.col("f").cast(wide) * 80
    return rows.filter(~F.coalesce(gone, F.lit(False))).select("gram", F.col("f").alias("a"))


def _scored(kept: DataFrame, frequent: DataFrame) -> DataFrame:
    """``gram``, ``a`` and the ``score``, ``l`` and ``r`` of the cut with the smallest score."""
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    cuts = cuts.withColumn("left_", F.slice("gram", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("right_", F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")))
    lefts = frequent.select(F.col("gram").alias("left_"), F.col("f").alias("l"))
    rights = frequent.select(F.col("gram").alias("right_"), F.col("f").alias("r"))
    met = cuts.join(lefts, "left_").join(rights, "right_")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000bd) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    return met.groupBy("gram", "a").agg(least).select("gram", "a", "cut.l", "cut.r", "cut.score")

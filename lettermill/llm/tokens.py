"""Token counts and token ids of whole texts by public tokenizer files.

Texts fall into chunks at white space whose tokens do not depend on each
other, and most chunks of a corpus repeat. So each Python worker keeps a
bounded memory of chunks, and the tokenizer's merges run for new ones only.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import whole_text

REMEMBERED = 300_000
WORDS, PIECES = 100_000, 50_000
# Characters of the longest key that is remembered.
LONGEST = 64

# Unicode white space, as the tokenizers read \s.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Characters for which the patterns below and the tokenizers' normalizers are known to
# agree with the library (a test goes through all of them). Others go to the library.
_PLAIN = [*range(0x00, 0x130), *range(0x131, 0x180), *range(0x2000, 0x205F)]
_UNUSUAL = re.compile("[^\\x00-\\u012f\\u0131-\\u017f\\u2000-\\u205e]|<\\|")

# White space beyond ASCII as Arrow's patterns write it; a single sign that ends a clause behind a letter.
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SENTENCE_SIGN = r"([a-z])([.,])([ \n]|$)"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PIECES = re.compile(
    f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD_PIECES = re.compile(f"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORDS = re.compile(f"[^{_SPACE}]+")
_ODD_SPACE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


@cache
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for 256 and up in order.
    """
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


def byte_letters(piece: str) -> str:
    """A piece of text as a byte-level vocabulary spells it."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_byte_letters())


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memory(dict):
    """A dictionary that works out what it lacks, of at most twice ``most`` keys.

    When it is full it starts anew, but what it held stays at hand until it is
    full again: so keys that come often are worked out once, and rare ones go.
    Long keys are never kept, so its bytes are bounded as well.
    """

    def __init__(self, find: Callable, most: int = REMEMBERED):
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.most:
            self.older = {}
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def whole_tokens(path: str) -> frozenset[str]:
    """The strings of a byte-level vocabulary that the library encodes alone as one token.

    A vocabulary string need not be one: its merges may end elsewhere, or the
    pattern may cut it. Each is encoded once, so the shortcut is proven.
    """
    library = tokenizer(path)
    letters = {v: k for k, v in _byte_letters().items()}
    strings = []
    for spelled in library.get_vocab():
        try:
            strings.append(bytes(letters[c] for c in spelled).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # a special token, or part of a character
    found = library.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1)


def count_chunk(chunk: str, path: str, whole: frozenset[str]) -> int:
    """Tokens of a chunk: whole tokens count directly, other pieces are merged."""
    if _UNUSUAL.search(chunk):
        return len(tokenizer(path).encode(chunk, add_special_tokens=False).ids)
    merge = tokenizer(path).model.tokenize
    return sum(1 if p in whole else len(merge(byte_letters(p))) for p in _BYTE_PIECES.findall(chunk))


@cache
def _counts(path: str, whole: frozenset[str]) -> Memory:
    return Memory(lambda chunk: count_chunk(chunk, path, whole))


def count_text(text: str, counts: Memory) -> int:
    """Tokens of a whole text.

    A blank belongs to the word behind it. Cutting at every blank gives the
    same pieces as the tokenizer's pattern unless a blank stands in a longer
    run of white space; such texts are cut by the pattern's white-space rules.
    """
    if not text:
        return 0
    if "  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
        return sum(map(counts.__getitem__, _CHUNKS.findall(text)))
    first, *rest = text.split(" ")
    return (counts[first] if first else 0) + sum(map(counts.__getitem__, [" " + w for w in rest]))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    The tokenizer is a byte-level file of the ``tokenizers`` library with the
    usual pattern (white space joins the word behind it). Counts equal the
    library's with its defaults, so a special token's string in a text is one
    token. Null and empty texts have 0 tokens; repeated rows are counted each;
    other columns are ignored; no documents, no rows. The table of whole tokens
    is worked out once by the driver and sent to the executors; it is bounded
    by the vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _counts(path, whole.value)
        for texts in batches:
            yield pd.Series([count_text(t, counts) for t in texts], dtype="int64")

    text = whole_text(docs)
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        counted(text).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def word_pieces(word: str) -> list[str]:
    """A plain word's pieces as the word-level vocabulary spells them."""
    low = word.lower()
    if word.isascii():
        # The common cases without the pattern: letters alone, or with one sign behind.
        if word.isalpha():
            return [low]
        if word[:-1].isalpha():
            return [low[:-1], byte_letters(low[-1])]
    return [byte_letters(p) for p in _WORD_PIECES.findall(low)]


def word_memory(path: str) -> Memory:
    """Token ids of words, as unsigned 32-bit little-endian numbers; new ones are worked out and remembered."""
    library = tokenizer(path)
    merge = library.model.tokenize
    pieces = Memory(lambda p: array("I", [t.id for t in merge(p)]).tobytes(), PIECES)

    def find(word: str) -> bytes:
        if _UNUSUAL.search(word):
            return array("I", library.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(pieces.__getitem__, word_pieces(word)))

    return Memory(find, WORDS)


def word_ids(text: str, memory: Memory) -> bytes:
    """Token ids of a whole text, as unsigned 32-bit numbers in the machine's order (little-endian).

    For tokenizers that lower-case and drop white space, as ``word_bpe_49k.json``:
    the ids of a text are those of its words in a row.
    """
    words = _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()
    return b"".join(map(memory.__getitem__, words))


def batch_word_ids(texts: pa.Array, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """``word_ids`` of many texts in a row, and the number of ids of each.

    Arrow cuts the texts and finds the different words; only those meet Python,
    and Arrow puts their ids where the words stand.
    """
    words_in, encoded = _different_words(texts)
    if not len(encoded):
        return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
    found = pa.array([memory[w] for w in encoded.dictionary.to_pylist()], pa.large_binary())
    placed = found.take(encoded.indices)
    bounds = np.frombuffer(placed.buffers()[1], np.int64, len(placed) + 1)
    ids = np.frombuffer(placed.buffers()[2] or b"", "<u4", bounds[-1] // 4)
    return ids, np.diff(bounds[np.cumsum(words_in)] // 4, prepend=0)


def _different_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of words of each text, and all words in a row by their places among the different ones.

    Two steps make words alike that have the same ids: A-Z are lower-cased, but
    not in texts with what may be a special token, and a single full stop
    or comma behind a letter becomes a word of its own, as the pattern has it.
    """
    special = pc.match_substring(texts, "<|")
    parted = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
    parted = pc.replace_substring_regex(parted, _WIDE_SPACE, " ")
    parted = pc.replace_substring_regex(parted, _SENTENCE_SIGN, r"\1 \2\3")
    lists = pc.ascii_split_whitespace(parted)
    words_in = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return words_in, pc.dictionary_encode(lists.flatten())

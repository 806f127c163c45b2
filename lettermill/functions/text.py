"""Text helpers on columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Python counts as white space, as a list for trimming and as a class.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RARE_SPACE = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_LITERAL_START = re.compile(r"[A-Za-z](?![?*{])")
# A bar that is, or could be, outside every bracket.
_TOP_LEVEL_BAR = re.compile(r"\\[()|]|^[^(]*\||\)[^(]*\|")


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with Python's reading of ``\\s``, ``\\w``, ``\\d``, case and dot.

    ``U`` makes classes Unicode-aware and ``d`` lets the dot match everything
    but a line feed.
    """
    return f"(?U{'i' if ignore_case else ''}d)" + pattern.replace(r"\s", SPACE)


def any_pattern(patterns: Sequence[str]) -> str:
    """One pattern that matches where any of them does.

    Where all start with a letter, a look at the first letter spares trying
    them one by one at most places, which more than halves the time.
    """
    either = "|".join(patterns)
    if all(_LITERAL_START.match(p) and not _TOP_LEVEL_BAR.search(p) for p in patterns):
        firsts = "".join(sorted({p[0].lower() for p in patterns}))
        either = f"(?=[{firsts}])(?:{either})"
    return java_pattern(either)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used.

    Spark writes an expression out again wherever a function names it, and
    inside a lambda works it out again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def or_default(text: Column, default: str) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def head(text: Column, chars: int | None) -> Column:
    """The first code points of a text, or all of it for ``None``."""
    return text if chars is None else F.substring(text, 1, chars)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(or_empty(text)) == ""


def squeeze(text: Column) -> Column:
    """Words of a text joined by single spaces.

    The wide class costs three times the plain one, so only text with rare
    white space is searched for it.
    """
    plain = F.regexp_replace(strip(text), r"\s+", " ")
    return let(
        plain,
        lambda t: F.when(t.rlike(_RARE_SPACE), F.regexp_replace(t, f"{SPACE}+", " ")).otherwise(t),
    )


def first_words(text: Column, words: int | None) -> Column:
    """The first words of a text joined by single spaces; ``None`` keeps all."""
    squeezed = squeeze(text)
    return squeezed if words is None else F.substring_index(squeezed, " ", words)


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return let(text, lambda t: F.exists(text_array(phrases), lambda p: F.contains(t, p)))


def _by_common_part(phrases: Sequence[str], chars: int = 5) -> dict[str, list[str]]:
    """Phrases under a short part they share: the part shared by most comes first."""
    left, groups = list(dict.fromkeys(phrases)), {}
    while left:
        parts = Counter(
            part for p in left for part in {p[i : i + chars] for i in range(max(1, len(p) - chars + 1))}
        )
        part = max(parts, key=lambda x: (parts[x], x))
        groups[part] = [p for p in left if part in p]
        left = [p for p in left if part not in p]
    return groups


def count_contained(text: Column, phrases: Sequence[str]) -> Column:
    """How many different listed phrases occur in the text.

    A phrase is looked for only where a part it shares with others occurs,
    which halves the time on ordinary text. A literal array keeps the generated
    code small however long the list is.
    """
    if not phrases:
        return F.lit(0)
    groups = F.array(
        *[
            F.struct(F.lit(part).alias("part"), text_array(members).alias("phrases"))
            for part, members in _by_common_part(phrases).items()
        ]
    )

    def count(t: Column) -> Column:
        def add(total: Column, group: Column) -> Column:
            found = F.size(F.filter(group["phrases"], lambda p: F.contains(t, p)))
            return total + F.when(F.contains(t, group["part"]), found).otherwise(F.lit(0))

        return F.aggregate(groups, F.lit(0), add)

    return let(text, count)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose keyword occurs in the text."""
    if not rules:
        return F.lit(default)
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rules])
    hits = let(text, lambda t: F.filter(table, lambda r: F.contains(t, r["k"])))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["v"], F.lit(default))


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters cannot make Spark compute again.

    The optimizer copies a filter's condition below the projection that computes
    its columns, with every inner projection written out in full: a filter on
    the mail category then rebuilds the text for each of some sixty phrase
    tests. A filter is never moved below the generator that makes its column.
    """
    staged = df.withColumn("__pinned", value)
    kept = [F.col(f"`{column}`") for column in df.columns if column != name]
    return staged.select(*kept, F.explode(F.array("__pinned")).alias(name))

"""HTML to text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.functions.text import let

# --- fixed values: what the numeric references 128 to 159 stand for ----------
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
# --- end of fixed values ----------------------------------------------------

_GAP = "\u0001"
_KEPT = "\u0002"
# The inside of a tag up to its end: a value in quotes may hold ">". What is not closed
# reaches to the end of the text, as in a browser; so nothing is searched twice. The
# matcher recurses once a value, so beyond some hundred the plain rule holds.
_INSIDE = r"""(?:(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+){0,400}+(?:>|\z)|[^>]*+(?:>|\z))"""
_HIDDEN_TAG = rf"<(?:script|style)\b{_INSIDE}"
_HIDDEN = "|".join(rf"{tag}\b{_INSIDE}(?:.*?</{tag}\s*+>|.*+)" for tag in ("script", "style"))
_TAG = rf"!--(?:.*?-->|.*+)|/?[a-z]{_INSIDE}|[!?][^>]*+(?:>|\z)"
_MARKUP = rf"(?is)<(?:{_HIDDEN}|{_TAG})"

# The standard's named references: most end in a semicolon, old ones need none.
_CLOSED = {name: char for name, char in html5.items() if name.endswith(";")}
_OPEN = {name: char for name, char in html5.items() if not name.endswith(";")}
_OPEN_NAMES = "|".join(sorted(_OPEN, key=len, reverse=True))


def _table(references: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(references)), T.MapType(T.StringType(), T.StringType()))


def _named_references(text: Column) -> Column:
    """Replace only the references a text has: looking for all of them takes longer."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([a-zA-Z][a-zA-Z0-9]*;)"), 1))

    def replace(done: Column, name: Column) -> Column:
        char = F.try_element_at(_table(_CLOSED), name)
        return F.coalesce(F.replace(done, F.concat(F.lit("&"), name), char), done)

    return F.aggregate(names, text, replace)


def _open_references(text: Column) -> Column:
    """The same for old names without a semicolon, the longest name first."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(f"&({_OPEN_NAMES})"), 1))
    longest_first = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))

    def replace(done: Column, name: Column) -> Column:
        return F.replace(
            done, F.concat(F.lit("&"), name), F.try_element_at(_table(_OPEN), name)
        )

    return F.aggregate(longest_first, text, replace)


def _character(number: Column) -> Column:
    """The text of a numeric reference, by the standard's rules."""
    is_hex = F.lower(F.substring(number, 1, 1)) == "x"
    digits = F.ltrim(F.when(is_hex, F.substring(number, 2, F.length(number))).otherwise(number), F.lit("0"))
    value = F.when(
        F.length(digits) <= 8,
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.nullif(digits, F.lit(""))),
    ).cast("long")

    def text_of(code: Column) -> Column:
        replaced = (
            code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        )
        dropped = (
            code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
            | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE)
        )
        return (
            F.when(replaced, "\ufffd")
            .when(code.between(128, 159), F.substring(F.lit(WINDOWS_1252), code.cast("int") - 127, F.lit(1)))
            .when(dropped, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    return let(value, text_of)


def _numeric_references(text: Column) -> Column:
    pieces = F.split(text, "&#(?=[0-9]|[xX][0-9a-fA-F])")
    number = "^([0-9]+|[xX][0-9a-fA-F]+);?"

    def decode(piece: Column) -> Column:
        return F.concat(
            _character(F.regexp_extract(piece, number, 1)), F.regexp_replace(piece, number, "")
        )

    return F.concat(
        F.element_at(pieces, 1),
        F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decode), ""),
    )


def decode_references(text: Column) -> Column:
    """Character references as the characters they name.

    Ampersands wait as a control character, so that what they form with the
    text behind them is not read as a reference.
    """
    def decode(t: Column) -> Column:
        named = let(let(t, _named_references), _open_references)
        return F.when(
            F.contains(t, F.lit("&")),
            let(named, lambda n: F.when(F.contains(n, F.lit("&#")), _numeric_references(n)).otherwise(n)),
        ).otherwise(t)

    waiting = F.regexp_replace(text, "&(?:amp|AMP);?", _GAP)
    return F.replace(let(waiting, decode), F.lit(_GAP), F.lit("&"))


def html_text(html: Column, keep_hidden: bool = False) -> Column:
    """Text nodes joined by one space, without comments.

    Scripts and styles are left out, or with ``keep_hidden`` stay as they are
    written, as text nodes of their own.
    """
    if not keep_hidden:
        marked = F.regexp_replace(F.regexp_replace(html, _MARKUP, _GAP), f"{_GAP}+", _GAP)
        return decode_references(F.replace(F.btrim(marked, F.lit(_GAP)), F.lit(_GAP), F.lit(" ")))
    pieces = F.regexp_extract_all(html, F.lit(rf"{_MARKUP}|[^<]++|<"), F.lit(0))

    def node(piece: Column) -> Column:
        inside = F.regexp_replace(piece, rf"(?is)^{_HIDDEN_TAG}|</(?:script|style)\s*+>\z", "")
        hidden = piece.rlike(rf"(?is)^{_HIDDEN_TAG}")
        # Their ampersands wait, as they begin no reference.
        return (
            F.when(hidden, F.replace(inside, F.lit("&"), F.lit(_KEPT)))
            .when(piece.rlike(r"(?is)^<[a-z/!?]"), "")
            .otherwise(piece)
        )

    nodes = F.filter(F.transform(pieces, node), lambda n: n != "")
    return F.replace(decode_references(F.array_join(nodes, " ")), F.lit(_KEPT), F.lit("&"))


def html_text_parsed(html: Column) -> Column:
    """All text nodes, those of scripts and styles too."""
    return html_text(html, keep_hidden=True)

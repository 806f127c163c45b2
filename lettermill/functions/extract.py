"""What one e-mail says: role, kind of rejection, company and job board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill import rules
from lettermill.functions.text import (
    any_pattern,
    contains_any,
    first_rule,
    java_pattern,
    let,
    or_empty,
    squeeze,
    strip,
    text_array,
)


def mail_text(subject: Column, body: Column, body_chars: int | None) -> Column:
    body = or_empty(body) if body_chars is None else F.substring(or_empty(body), 1, body_chars)
    return F.concat(or_empty(subject), F.lit(". "), body)


def role_title(
    text: Column,
    pattern: str = rules.ROLE_PATTERN,
    whole_words: bool = False,
    first_letters: str | None = rules.ROLE_FIRST_LETTERS,
) -> Column:
    """The first role title, its white space squeezed; empty where there is none.

    ``whole_words`` stops matches inside a word, such as the one in "misread".
    ``first_letters`` are all letters a title can start with; give None with a
    pattern of another kind.
    """
    if whole_words:
        pattern = rf"\b(?:{pattern})\b"
    if first_letters:
        pattern = f"(?=[{first_letters}])(?:{pattern})"
    return squeeze(F.regexp_extract(text, java_pattern(pattern), 0))


def rejection_type(
    text: Column,
    hard: Sequence[str] = tuple(rules.HARD_REJECTION_PATTERNS),
    soft: Sequence[str] = tuple(rules.SOFT_REJECTION_PATTERNS),
) -> Column:
    """Hard patterns win over soft ones."""
    hard_label, soft_label, other = rules.REJECTION_LABELS
    return (
        F.when(text.rlike(any_pattern(hard)), hard_label)
        .when(text.rlike(any_pattern(soft)), soft_label)
        .otherwise(other)
    )


def sender_domain(sender: Column) -> Column:
    return F.lower(F.regexp_extract(or_empty(sender), java_pattern(r"@([\w.-]+)"), 1))


def sender_company(
    sender: Column, noise: Sequence[str] = tuple(rules.SENDER_DOMAIN_NOISE)
) -> Column:
    """The second-level label of the sender's domain, capitalised.

    Empty for mail and hiring services and where there is no domain.
    """
    def name(domain: Column) -> Column:
        label = F.coalesce(F.try_element_at(F.split(domain, "\\."), F.lit(-2)), domain)
        capitalised = let(
            label,
            lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2_000_000_000)),
        )
        return F.when(contains_any(domain, noise), "").otherwise(capitalised)

    return let(sender_domain(sender), name)


def job_board(
    sender: Column,
    boards: Sequence[tuple[str, str]] = tuple(rules.JOB_BOARDS),
    default: str = rules.DEFAULT_BOARD,
) -> Column:
    return first_rule(F.lower(or_empty(sender)), boards, default)


def first_entity(
    candidates: Column, noise: Sequence[str] = tuple(rules.ENTITY_NOISE), min_chars: int = 3
) -> Column:
    """The first candidate that is long enough and no noise word; else empty."""
    trimmed = F.transform(F.coalesce(candidates, text_array([])), strip)
    kept = F.filter(
        trimmed,
        lambda c: (F.length(c) >= min_chars) & ~F.array_contains(text_array(noise), F.lower(c)),
    )
    return or_empty(F.try_element_at(kept, F.lit(1)))


def confidence(company: Column, role: Column, board: Column) -> Column:
    """0.4 for a company, 0.4 for a role, 0.2 for a known board."""
    def points(found: Column, worth: float) -> Column:
        return F.when(found, F.lit(worth)).otherwise(F.lit(0.0))

    total = (
        points(company != "", 0.4)
        + points(role != "", 0.4)
        + points(board != rules.DEFAULT_BOARD, 0.2)
    )
    return total.cast("float")

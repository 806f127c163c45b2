"""Mail dates and display dates; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import let

# --- fixed values: month names and zone names of mail dates -----------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}
# --- end of fixed values ----------------------------------------------------

_MAIL_DATE = (
    r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{2}|\d{4})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[a-z]{1,4})?\s*(?:\(.*\))?\s*$"
)
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def utc_text(ts: Column) -> Column:
    """An instant as ``yyyy-MM-dd HH:mm:ss[.f]`` in UTC."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    whole = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000))
    rest = F.pmod(F.unix_micros(ts), F.lit(86_400_000_000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole.cast("int"))
    clock = (epoch + F.make_dt_interval(secs=(rest / F.lit(1_000_000)).cast("decimal(18,6)"))).cast(
        "string"
    )
    return F.concat(day.cast("string"), F.substring(clock, 11, 20))


def iso_instant(text: Column) -> Column:
    """ISO-8601 text to an instant; text without an offset is UTC; else null."""
    full = F.trim(text)
    for pattern, replacement in (
        (r"^(.{10})$", "$1T00:00"),
        (r"^(.{16})(?!:)", "$1:00"),
        (r"^(.{19}(?:\.\d+)?)$", "$1Z"),
        (r"([+-]\d{2})(\d{2})$", "$1:$2"),
    ):
        full = F.regexp_replace(full, pattern, replacement)
    return F.when(F.trim(text).rlike(_ISO), F.try_to_timestamp(full))


def display_date(text: Column) -> Column:
    """ISO text as ``yyyy-MM-dd HH:mm UTC``; text that is no date is kept."""
    shown = let(
        iso_instant(text),
        lambda ts: F.concat(F.substring(utc_text(ts), 1, 16), F.lit(" UTC")),
    )
    return F.coalesce(shown, text)


def mail_date_to_iso(text: Column) -> Column:
    """A mail header date as ISO-8601 with its own offset; other text is kept.

    The offset ``-0000`` and a missing zone both mean an unknown zone, and
    give text without an offset.
    """
    fields = F.split(F.regexp_replace(text, _MAIL_DATE, "$1|$2|$3|$4|$5|$6|$7"), r"\|")
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    months = F.array(*[F.lit(m) for m in MONTHS])

    def local_and_offset(parts: Column) -> Column:
        day, month, year, hour, minute, second, given = (
            F.get(parts, F.lit(i)) for i in range(7)
        )
        century = F.when(F.length(year) == 4, "").when(year > F.lit("68"), "19").otherwise("20")
        number = F.array_position(months, F.lower(month)).cast("string")
        zone = F.when(given.rlike(r"^[+-]"), given).otherwise(
            F.coalesce(F.try_element_at(names, F.upper(given)), F.lit("-0000"))
        )
        offset = F.when(zone == "-0000", "").otherwise(
            F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))
        )
        two = [F.lpad(x, 2, "0") for x in (number, day, hour, second)]
        local = F.concat(
            century, year, F.lit("-"), two[0], F.lit("-"), two[1], F.lit("T"),
            two[2], F.lit(":"), minute, F.lit(":"), two[3],
        )
        return F.array(local, offset)

    def iso(both: Column) -> Column:
        is_date = F.try_to_timestamp(F.concat(both[0], F.lit("Z"))).isNotNull()
        return F.when(is_date, F.concat(both[0], both[1]))

    found = F.when(text.rlike(_MAIL_DATE), let(let(fields, local_and_offset), iso))
    return F.coalesce(found, text)

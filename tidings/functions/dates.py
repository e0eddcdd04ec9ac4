"""Date functions: published date, normalisers for the date styles in use, ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import is_digits, let, strip, zero_pad

# Date patterns and month names. Digits and spaces are those of Unicode, (?U).
PUBLISHED_PATTERN = r"(?U)(\d{4})[.-](\d{1,2})[.-](\d{1,2})"
YEAR_FIRST_PATTERN = r"(?U)(\d{4})[-./년]\s*(\d{1,2})[-./월]\s*(\d{1,2})"
MONTH_NAME_PATTERN = r"(?U)([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})"
DIGITS_PATTERN = r"(?U)(\d+)"
DATE_MARKS = "년월일/-"
MONTHS = {
    "Jan": "01", "Feb": "02", "Mar": "03", "Apr": "04", "May": "05", "Jun": "06",
    "Jul": "07", "Aug": "08", "Sep": "09", "Oct": "10", "Nov": "11", "Dec": "12",
}
UNKNOWN_MONTH = "01"

#: Decimal digits of other scripts, which a cast does not read.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isdecimal())
PLAIN_DIGITS = "".join(str(int(c)) for c in OTHER_DIGITS)


def _with_match(text: Column, pattern: str, build) -> Column:
    """``build`` of the first match, which is looked up once; null without a match.

    ``build`` gets a function from group number to text; it searches the short match only.
    """

    def from_match(match: Column) -> Column:
        return F.when(
            match.isNotNull(), build(lambda group: F.regexp_extract(match, pattern, group))
        )

    return let(F.regexp_substr(text, F.lit(pattern)), from_match)


def published_at(text: Column) -> Column:
    """Midnight UTC of the first date anywhere in the text; null if none or impossible."""

    def midnight(group) -> Column:
        year, month, day = [F.translate(group(g), OTHER_DIGITS, PLAIN_DIGITS).cast("int") for g in (1, 2, 3)]
        zero = F.lit(0)
        made = F.try_make_timestamp(
            year, month, day, zero, zero, zero.cast("decimal(8,6)"), F.lit("UTC")
        )
        return F.when(year >= 1, made)

    return _with_match(text, PUBLISHED_PATTERN, midnight)


def _dotted(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws(".", year, zero_pad(month), zero_pad(day))


def _dotted_parts(parts: Column, original: Column) -> Column:
    """Join three digit strings; two-digit years belong to this century."""

    def joined(p: Column) -> Column:
        year = F.get(p, 0)
        full_year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        return F.when(F.size(p) >= 3, _dotted(full_year, F.get(p, 1), F.get(p, 2)))

    return F.coalesce(let(parts, joined), original)


def date_year_first(text: Column) -> Column:
    """``2026년 2월 9일`` or ``2026-2-9 14:30`` to ``2026.02.09``; otherwise unchanged."""
    dotted = _with_match(text, YEAR_FIRST_PATTERN, lambda g: _dotted(g(1), g(2), g(3)))
    return F.coalesce(dotted, text)


def date_from_parts(text: Column) -> Column:
    """Split at date marks and dots and join the first three all-digit parts."""
    dots = F.translate(text, DATE_MARKS, "." * len(DATE_MARKS))
    parts = F.filter(F.transform(F.split(dots, r"\."), strip), is_digits)
    return _dotted_parts(parts, text)


def date_from_digit_runs(text: Column) -> Column:
    """Join the first three runs of digits."""
    return _dotted_parts(F.regexp_extract_all(text, F.lit(DIGITS_PATTERN), F.lit(1)), text)


def date_month_name(text: Column) -> Column:
    """``Feb 9, 2026`` to ``2026.02.09``; unknown month names count as January."""
    months = F.create_map(*[F.lit(part) for pair in MONTHS.items() for part in pair])

    def dotted(group) -> Column:
        name = F.initcap(F.substring(group(1), 1, 3))
        month = F.coalesce(F.try_element_at(months, name), F.lit(UNKNOWN_MONTH))
        return _dotted(group(3), month, group(2))

    return F.coalesce(_with_match(text, MONTH_NAME_PATTERN, dotted), date_year_first(text))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text with offset; the fraction is written only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    offset = F.date_format(ts.cast("timestamp"), "xxx")
    shown = F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(whole, shown, offset)

"""Column helpers. Everything here stays a native Spark expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

MONEY = "decimal(38,9)"


# ---- text ---------------------------------------------------------------------------
def extract(col: Column, pattern: str) -> Column:
    """First capture group, NULL (not '') when the pattern does not match."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def contains_any_case(haystack: Column, needle: str) -> Column:
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def slug(group: Column, title: Column, fallback: str) -> Column:
    """First word of the group, a dot, then the dashed title cut to 40 characters."""
    head = F.regexp_replace(F.lower(F.element_at(F.split(group, r"\s+"), 1)), "[^a-z0-9]", "")
    dashed = F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-")
    tail = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 40)
    return F.concat(F.coalesce(F.nullif(head, F.lit("")), F.lit(fallback)), F.lit("."), tail)


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def normalize_id(col: Column) -> Column:
    """Digits of an id as a number; anything unusable becomes NULL."""
    return F.nullif(digits(col), F.lit("")).try_cast("bigint")


def whole_text(col: Column) -> Column:
    """A rounded number as text without a trailing '.0'."""
    return F.round(col).cast("decimal(38,0)").cast("string")


def label_of(col: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Look a code up in a small fixed map; unknown codes stay as they are by default."""
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(table[col], col if default is None else default)


def rank_in(col: Column, order: Sequence[str], missing: int = 999) -> Column:
    """Zero-based position in an explicit order; unlisted values sort last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), col) - 1
    return F.when(pos >= 0, pos).otherwise(F.lit(missing)).cast("int")


def impression_share(col: Column) -> Column:
    """'<10%', '46%' or '0.46' as a fraction."""
    number = F.regexp_extract(col, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.contains(col, F.lit("%")), number / 100).otherwise(number)


def is_floored(col: Column) -> Column:
    return F.startswith(F.trim(col), F.lit("<"))


def money_text(col: Column) -> Column:
    """'$1,234' or '-$1,234', rounded to whole units."""
    sign = F.when(col < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, F.format_number(F.abs(F.round(col)), 0))


def percent_text(col: Column) -> Column:
    """Half-up like the other money texts; printf-style rounding differs between engines."""
    return F.concat((F.round(col * 100).cast("decimal(38,0)")).cast("string"), F.lit("%"))


# ---- numbers ------------------------------------------------------------------------
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(col: Column) -> Column:
    """A plain decimal number; casts alone would also accept '5d' or 'NaN'."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def number_or_zero(col: Column) -> Column:
    return F.coalesce(number(col), F.lit(0.0))


def parse_money(col: Column) -> Column:
    """'USD 9458.925231' -> 9458.925231000 (last token, scale 9, half-even); junk -> NULL."""
    token = F.element_at(F.split(F.trim(col), r"\s+"), -1)
    exact = F.nullif(token, F.lit("")).try_cast("decimal(38,18)")
    return F.bround(exact, 9).cast(MONEY)


def from_micros(col: Column) -> Column:
    return col / F.lit(1_000_000)


def ratio(num: Column, den: Column) -> Column:
    """NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """0 on a zero denominator."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


# ---- time ---------------------------------------------------------------------------
def clock_hour(col: Column) -> Column:
    """'3PM' -> 15, '12AM' -> 0, junk -> NULL."""
    return F.hour(F.try_to_timestamp(col, F.lit("ha")))


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def whole_days_between(start: Column, end: Column) -> Column:
    """Completed 24-hour periods, not calendar days."""
    return F.timestamp_diff("DAY", start, end)


def epoch_text(col: Column) -> Column:
    """Epoch seconds as UTC text."""
    return F.date_format(F.timestamp_seconds(col.cast("double")), "yyyy-MM-dd HH:mm:ss")


def since(date_col: Column, as_of: Column, days: int) -> Column:
    """Trailing window with no upper bound."""
    return date_col >= F.date_sub(as_of, days)


def local_date(ts: Column, zone: str | Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


# ---- arrays -------------------------------------------------------------------------
def add_element(arr: Column, value: Column) -> Column:
    base = F.coalesce(arr, F.array().cast("array<string>"))
    return F.array_union(base, F.array(value))


def drop_element(arr: Column, value: Column) -> Column:
    base = F.coalesce(arr, F.array().cast("array<string>"))
    return F.filter(base, lambda x: x != value)


def has_capability(caps: Column, wanted: str) -> Column:
    caps = F.coalesce(caps, F.array().cast("array<string>"))
    return F.array_contains(caps, "*") | F.array_contains(caps, wanted)

"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
NULL_TEXTS = ["", "nan", "null", "none", "na"]

# Timestamp patterns of the log formats, tried in this order.
TIME_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSS"]


def is_null_text(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(NULL_TEXTS)


def is_null_number(c: Column) -> Column:
    """Text nulls, and -1, which stands for a missing code."""
    return is_null_text(c) | F.coalesce(number(c) == -1, F.lit(False))


def number(c: Column) -> Column:
    """A double, or null where the text is none."""
    return c.try_cast("double")


def rounded(c: Column, digits: int) -> Column:
    """A double at so many digits as SQL engines on binary numbers round: the scaled double, halves away from zero. F.round takes the shortest decimal text instead."""
    return F.round(c * 10.0**digits) / 10.0**digits


def naive_timestamp(c: Column) -> Column:
    """A timestamp without zone: an offset or Z is dropped, not applied."""
    bare = F.regexp_replace(F.trim(c), r"(Z|[+-]\d{2}:?\d{2})$", "")
    parsed = [F.try_to_timestamp(bare, F.lit(p)) for p in TIME_PATTERNS]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def text_list(c: Column) -> Column:
    """A list written with single or double quotes as an array; [] for anything else."""
    return F.coalesce(F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>"))


def hash_vector(c: Column, size: int = 16) -> Column:
    """`size` values in [-1, 1] from the md5 of a text, two hex digits each."""
    h = F.md5(c.cast("string"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1)


def attribute_vector(c: Column, numeric: bool, size: int = 16) -> Column:
    """A declared numeric attribute as one value, any other as its hash; missing ones as zeros of that width."""
    if numeric:
        return F.array(F.coalesce(number(c), F.lit(0.0)))
    return F.coalesce(hash_vector(c, size), F.array_repeat(F.lit(0.0), size))


def time_of_day(ts: Column) -> list[Column]:
    return [(F.hour(ts) / 24).alias("hour_part"), (F.minute(ts) / 60).alias("minute_part"), (F.weekday(ts) / 7).alias("weekday_part")]


def entropy(shares: Column) -> Column:
    """Natural-log entropy of an array of shares."""
    return -F.aggregate(F.filter(shares, lambda p: p > 1e-15), F.lit(0.0), lambda s, p: s + p * F.log(p))

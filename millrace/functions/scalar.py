"""Scalar expressions with the engine's semantics; all are built-in expressions inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """A double; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_mod(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.try_mod(a, b)


def strict_string(value: Column, kind: str) -> Column:
    """``value`` if its type, named by ``kind``, is a string type; else a type error, as for upper(1)."""
    if kind not in ("string",) and not kind.startswith(("varchar", "char")):
        raise TypeError(f"a string is needed, not {kind}")
    return value


def upper(value: Column, kind: str = "string") -> Column:
    return F.upper(strict_string(value, kind))


def lower(value: Column, kind: str = "string") -> Column:
    return F.lower(strict_string(value, kind))


def like(value: Column, pattern: str) -> Column:
    """LIKE on the text of any value."""
    return value.cast("string").like(pattern)


def between_symmetric(value: Column, a: Column, b: Column) -> Column:
    return value.between(F.least(a, b), F.greatest(a, b))


def epoch(seconds: Column) -> Column:
    """A timestamp without zone from seconds since 1970 in UTC."""
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def parse_timestamp(text: Column) -> Column:
    """``YYYY-MM-DD`` with an optional ``HH:MM:SS``; null for other text."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def format_timestamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def vector(*parts: Column) -> Column:
    return F.array(*[p.cast("double") for p in parts])


def checked_sqrt(value: Column) -> Column:
    """The square root; a negative number is an error."""
    return F.when(value < 0, F.raise_error(F.lit("square root of a negative number")).cast("double")).otherwise(F.sqrt(value))

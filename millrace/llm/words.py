"""Words of a text: maximal runs of characters other than space and U+0009..U+000D, A-Z lower-cased.

Both are plain byte operations on UTF-8: ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at exactly those six characters.
"""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same words as a pattern, for Spark and other SQL engines.
PATTERN = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def utf8(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column's values as bytes (null stays null)."""
    values = batch.column(column)
    return values.cast(pa.large_binary()) if pa.types.is_large_string(values.type) else values.cast(pa.binary())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("long")

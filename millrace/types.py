"""SQL type names and table schemas."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed names of the SQL surface.  Decimals are doubles unless a precision is asked for with ``exact_decimals``; character lengths are kept as metadata only.
NAMES = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "tinyint": T.ByteType(), "int1": T.ByteType(),
    "smallint": T.ShortType(), "int2": T.ShortType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(),
    "bigint": T.LongType(), "int8": T.LongType(),
    "decimal": T.DoubleType(), "numeric": T.DoubleType(), "dec": T.DoubleType(),
    "real": T.DoubleType(), "float": T.DoubleType(), "float4": T.DoubleType(), "float8": T.DoubleType(), "double": T.DoubleType(), "double precision": T.DoubleType(),
    "varchar": T.StringType(), "char": T.StringType(), "text": T.StringType(), "character varying": T.StringType(), "nvarchar": T.StringType(), "bpchar": T.StringType(), "clob": T.StringType(),
    "timestamp": T.TimestampNTZType(), "date": T.TimestampNTZType(), "datetime": T.TimestampNTZType(),
    "vector": T.ArrayType(T.DoubleType()),
}


def sql_type(text: str, exact_decimals: bool = False) -> tuple[T.DataType, int | None]:
    """The Spark type of a SQL type such as ``varchar(20)`` and its length, if it has one."""
    m = re.fullmatch(r"\s*([a-z][a-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text.lower())
    if not m or m[1] not in NAMES:
        raise ValueError(f"unknown type {text!r}")
    if m[1] == "vector" and not m[2]:
        raise ValueError("a vector needs a length")
    if exact_decimals and m[2] and m[1] in ("decimal", "numeric", "dec"):
        return T.DecimalType(int(m[2]), int(m[3] or 0)), None
    return NAMES[m[1]], int(m[2]) if m[2] else None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type_name: str
    nullable: bool = True
    default: object = None

    @property
    def type(self) -> T.DataType:
        return sql_type(self.type_name)[0]


@dataclass(frozen=True)
class Schema:
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = field(default=())

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("column names repeat")
        missing = set(self.primary_key) - {c.name for c in self.columns}
        if missing:
            raise ValueError(f"no such key columns: {sorted(missing)}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable and c.name not in self.primary_key) for c in self.columns])

    def conform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with this schema's columns in order: absent ones get their default, values are cast by ANSI rules, vectors must have their length."""
        have = {c.lower(): c for c in rows.columns}
        out = []
        for c in self.columns:
            value: Column = F.col(f"`{have[c.name.lower()]}`") if c.name.lower() in have else F.lit(c.default)
            value = value.cast(c.type)
            length = sql_type(c.type_name)[1]
            if isinstance(c.type, T.ArrayType):
                value = F.when(value.isNull() | (F.size(value) == length), value).otherwise(F.raise_error(F.lit(f"{c.name} takes vectors of {length}")).cast(c.type))
            out.append(value.alias(c.name))
        return rows.select(*out)

"""Changes to tables as pure functions: DataFrames in, the state afterwards out."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import written

#: Fixed limit of cascades.
MAX_DEPTH = 10


@dataclass(frozen=True)
class ForeignKey:
    parent: str
    key: str
    child: str
    column: str
    on_delete: str = "CASCADE"

    def __post_init__(self) -> None:
        if self.on_delete not in ("CASCADE", "RESTRICT", "SET_NULL"):
            raise ValueError(f"unknown rule {self.on_delete}")


def holds(predicate: Column) -> Column:
    """True only where the predicate is; null counts as false."""
    return F.coalesce(predicate, F.lit(False))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT ... SELECT: columns by position, cast to the table's types."""
    if len(rows.columns) != len(table.columns):
        raise ValueError(f"{len(table.columns)} columns are needed, not {len(rows.columns)}")
    renamed = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return table.unionByName(renamed.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(table.schema)]))


def with_keys(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with null keys replaced by the numbers after the table's greatest key, in the given order.

    Numbers are dealt in two steps, counts of ranges first, so that a large insert is not sorted in one task; the rows are written
    with their range in between, because both steps must see the same ranges.
    """
    missing = F.col(key).isNull()
    kind = rows.schema[key].dataType
    greatest = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).unionByName(rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("m"))).agg(F.max("m").alias("m"))
    new = rows.where(missing).repartitionByRange(*order).sortWithinPartitions(*order)
    new = written(new.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "new-rows")
    inside = new.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy("__m")))
    before = inside.groupBy("__p").agg(F.count("*").alias("__n"))
    start = before.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("__s"))
    numbered = inside.join(start, "__p").crossJoin(F.broadcast(greatest)).withColumn(key, (F.col("m") + F.coalesce("__s", F.lit(0)) + F.col("__i")).cast(kind))
    return rows.where(~missing).unionByName(numbered.select(*rows.columns))


def update(table: DataFrame, predicate: Column, **values: Column) -> DataFrame:
    """All expressions see the row as it was."""
    hit = holds(predicate)
    return table.select(*[F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema])


def delete(table: DataFrame, predicate: Column) -> DataFrame:
    return table.where(~holds(predicate))


def affected(table: DataFrame, predicate: Column) -> int:
    return table.where(holds(predicate)).count()


class RestrictError(ValueError):
    pass


class DepthError(ValueError):
    pass


def delete_cascade(tables: dict[str, DataFrame], keys: Sequence[ForeignKey], table: str, predicate: Column) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables afterwards, deleted rows by table): rows of ``table`` that the predicate holds for go, and rows of other tables that depend on them.

    Keys are followed from table to table, at most ``MAX_DEPTH`` deep, by semi joins (what goes) and anti joins (what stays); all stays lazy.  RESTRICT
    raises if a dependent row exists, SET_NULL empties its column.  Dependent rows that lie deeper raise too: none becomes an orphan.
    """
    after = dict(tables)
    gone: dict[str, DataFrame] = {}

    def remove(name: str, doomed: DataFrame, kept: DataFrame, depth: int) -> None:
        after[name] = kept
        gone[name] = gone[name].unionByName(doomed) if name in gone else doomed
        for k in keys:
            if k.parent != name:
                continue
            lost = doomed.select(F.col(k.key).alias("__k")).where("__k is not null").distinct()
            child = after[k.child]
            match = child[k.column] == lost["__k"]
            hit = child.join(lost, match, "left_semi")
            if k.on_delete == "RESTRICT":
                if not hit.isEmpty():
                    raise RestrictError(f"{k.child}.{k.column} still refers to deleted rows of {name}")
            elif k.on_delete == "SET_NULL":
                marked = child.join(lost, match, "left")
                after[k.child] = marked.select(*[(F.when(F.col("__k").isNull(), F.col(c)) if c == k.column else F.col(c)).alias(c) for c in child.columns])
            elif depth == MAX_DEPTH:
                if not hit.isEmpty():
                    raise DepthError(f"{k.child}.{k.column} refers to deleted rows of {name}, {MAX_DEPTH} tables down")
            else:
                remove(k.child, hit, child.join(lost, match, "left_anti"), depth + 1)

    remove(table, tables[table].where(holds(predicate)), delete(tables[table], predicate), 0)
    return after, gone


def violations(table: DataFrame, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), old: DataFrame | None = None) -> DataFrame:
    """(rule, n): broken NOT NULL and UNIQUE rules with the number of rows or keys that break them.  With ``old``, ``table`` holds rows to be added to it,
    and keys of both break a rule too; keys of old rows are not compared with one another."""
    checks = [table.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"not null {c}").alias("rule"), "n") for c in not_null]
    for u in unique:
        keys = table.dropna(subset=list(u)).groupBy(*u).agg(F.count("*").alias("n"))
        twice = keys.where("n > 1").select(*u)
        if old is not None:
            taken = keys.select(*u).join(old.select(*u), list(u), "left_semi")
            twice = twice.unionByName(taken).distinct()
        checks.append(twice.agg(F.count("*").alias("n")).select(F.lit(f"unique {', '.join(u)}").alias("rule"), "n"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.where("n > 0")

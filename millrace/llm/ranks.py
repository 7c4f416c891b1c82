"""Numbers of rows inside groups, without taking a group into one task.

Rows are sorted over all tasks by group and order; each task numbers its own runs, and only runs that begin in a task before need an offset.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import cut


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], key: str, name: str) -> DataFrame:
    """(key, name): each row's number from 1 on among the rows of its group in that order, which must be total.  ``key`` is a long that names the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            first = np.append(0, np.flatnonzero(g[1:] != g[:-1]) + 1)
            begin = np.repeat(first, np.diff(np.append(first, len(g))))
            nth = np.arange(len(g)) - begin + 1
            if last is not None and g[0] == last:
                nth[begin == 0] += held
            last, held = g[-1], int(nth[-1])
            yield pa.record_batch([b.column("key"), b.column("g"), pa.array(np.full(len(g), part, np.int32)), pa.array(nth)], ["key", "g", "part", "nth"])

    by = [*[F.col(c) for c in group], *order]
    placed = cut(rows, "ranked")  # finding ranges reads the rows once more
    dealt = placed.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(key).alias("key"), F.xxhash64(*group).alias("g"))
    numbered = cut(dealt.mapInArrow(run, "key long, g long, part int, nth long"), "numbered")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("g", "part").agg(F.max("nth").alias("n")).withColumn("offset", F.sum("n").over(before)).where("offset is not null").drop("n")
    return numbered.join(offsets, ["g", "part"], "left").select(F.col("key").alias(key), (F.col("nth") + F.coalesce("offset", F.lit(0))).alias(name))

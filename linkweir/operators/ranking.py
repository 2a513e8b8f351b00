"""Numbers, places and average ranks over whole tables, without a task that holds a group or all rows.

Rows are dealt out by ranges of the order and sorted in their ranges; each range counts on its own, and what the ranges
before it hold is added. Those sums are one row a range, so only they pass one task and are broadcast. The sorted ranges are
written once, as a second sampling of the ranges would cut them elsewhere.

Rows with equal keys of the order stay in one range; ``numbered`` takes further columns to part them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkweir.sources.scratch import written

#: monotonically_increasing_id has the partition above these bits and the row inside it below.
_ROW_BITS = 33


def _ranges(rows: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _before(totals: DataFrame) -> DataFrame:
    """(_range, _base): what the ranges before each one hold. One row a range."""
    base = F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return totals.select("_range", base.alias("_base"))


def numbered(rows: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... over all rows in the order. Rows that tie in all of it are numbered in any order."""
    at = F.monotonically_increasing_id()
    cut = _ranges(rows, order, parts).withColumn("_at", at)
    cut = written(cut.select("*", F.shiftright("_at", _ROW_BITS).alias("_range")), "numbered")
    base = _before(cut.groupBy("_range").agg(F.count("*").alias("_total")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return cut.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + inside + 1).drop("_range", "_at", "_base")


def places(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in the order among rows of equal keys, and ``<name>_of``: how many those are. Null is a key like others."""
    all_rows = numbered(rows, [F.col(k) for k in keys] + order, "_number", parts)
    first = all_rows.groupBy(*keys).agg(F.min("_number").alias("_first"), F.count("*").alias(f"{name}_of"))
    first = first.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first", f"{name}_of")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = all_rows.join(first, same).withColumn(name, F.col("_number") - F.col("_first"))
    return out.drop("_number", "_first", *(f"_k{i}" for i in range(len(keys))))


def running_totals(counts: DataFrame, order: list[str], n: str, name: str = "through", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``n`` over all rows up to this one in the order, which tells rows apart."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.schema)

    def run(batches):
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            through = total + np.cumsum(b.column(n).to_numpy(zero_copy_only=False).astype(np.int64))
            total = int(through[-1]) if len(through) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(through), pa.array(np.full(len(through), part, np.int64))], [*b.schema.names, "_in", "_range"])

    cut = written(_ranges(counts, [F.col(c) for c in order], parts).mapInArrow(run, fields + "_in long, _range long"), "running")
    base = _before(cut.groupBy("_range").agg(F.max("_in").alias("_total")))
    return cut.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_in", "_base")


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str = "r", parts: int | None = None) -> DataFrame:
    """Adds ``name``, the rank of ``value`` among rows of equal keys, ties sharing the mean of their places, and ``ties``, how many share it.

    A histogram of the distinct values is what is ranked: what lies below a value is a running total less what the keys
    before hold, and half of the ties. Keys and values are not null; the rows meet their value's rank in a join that splits
    frequent values."""
    histogram = rows.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    through = running_totals(histogram, [*keys, value], "ties", "_through", parts)
    start = through.groupBy(*keys).agg(F.min(F.col("_through") - F.col("ties")).alias("_start"))
    ranked = through.join(start, keys) if keys else through.crossJoin(F.broadcast(start))
    rank = (F.col("_through") - F.col("ties") - F.col("_start")) + (F.col("ties") + 1) / 2
    return rows.join(ranked.select(*keys, value, rank.alias(name), "ties"), [*keys, value])

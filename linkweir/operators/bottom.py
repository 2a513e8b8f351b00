"""The first rows of every stratum in an order, without a sort of any stratum.

Each task keeps, of the rows that it sees, the first ``k`` of every stratum: it holds rows until they are twice what it may
keep, sorts them and lets the rest go. What the tasks kept meets in rounds, first in some parts of each stratum, then in the
stratum, so a shuffle carries at most tasks x strata x k rows and the last task of a stratum sees ``PARTS`` x k of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts of a stratum that meet before it does; rows that a task holds before it sorts for the first time.
PARTS, HELD = 16, 20_000


def _first(table: pa.Table, strata: list[str], order: list[str], k: str) -> pa.Table:
    """The first rows of each stratum; nulls come first and are a stratum."""
    code = np.zeros(table.num_rows, np.int64)
    for s in strata:
        column = pc.dictionary_encode(table.column(s).combine_chunks(), null_encoding="encode")
        code = code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    keys = [("_code", "ascending"), *((c, "ascending") for c in order)]
    at = pc.sort_indices(table.append_column("_code", pa.array(code)), keys, null_placement="at_start").to_numpy()
    code = code[at]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
    place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    limit = table.column(k).to_numpy()[at]
    return table.take(pa.array(at[place < limit]))


def _keep(rows: DataFrame, strata: list[str], order: list[str], k: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, HELD
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > most:
                kept = _first(pa.Table.from_batches(held), strata, order, k)
                held, n = kept.to_batches(), kept.num_rows
                most = max(HELD, 2 * n)
        if held:
            yield from _first(pa.Table.from_batches(held), strata, order, k).to_batches()

    return rows.mapInArrow(run, rows.schema)


def least(rows: DataFrame, strata: list[str], order: list[str], k: str) -> DataFrame:
    """Of each stratum the first rows in the order, ascending with nulls first; column ``k``, equal in a stratum and not
    null, says how many. The order tells the rows of a stratum apart, else any of those that tie may stay. Adds ``nth``, from 1."""
    some = _keep(rows, strata, order, k)
    parts = some.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = _keep(parts.repartition(*strata, "_part"), strata, order, k).drop("_part")
    nth = F.row_number().over(W.partitionBy(*strata).orderBy(*order))
    return some.withColumn("nth", nth).where(F.col("nth") <= F.col(k))

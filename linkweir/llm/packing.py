"""Packing into optimal length buckets.

The global histogram of lengths, a row for each length that occurs, goes to the driver, where dynamic programming chooses
among these lengths the bucket boundaries that make the padding least (the lengths' sum is the same for all choices). Padded
totals satisfy the quadrangle inequality, so the best last boundary moves one way as the texts grow longer, and each layer
of the programme is solved by halving: all middles of a level at once, in n log n steps for n lengths and exact integers.
The histogram has no more rows than the longest document has words, 16 bytes each, however many documents there are.
Documents get the least boundary not below their length; inside a bucket, batches hold as many documents as fit the token
budget when padded to the boundary, and at least one.

To number documents without one task for each bucket, a bucket is dealt out by a hash of the id into chunks of about
``CHUNK_ROWS`` documents, and batches form inside a chunk in the order of doc_id; only a chunk's last batch can be short.
Null lengths count as 0 and lengths below 0 as 0; a null id is packed like any other; repeated rows are packed each; an
empty table gives no rows. Very long texts are a bucket and a batch of their own if that pads less. Columns of the
documents other than doc_id, and text or what ``length`` reads, are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import words_column

BUCKETS, TOKEN_BUDGET, CHUNK_ROWS = 16, 32_768, 10_000
#: Stands for no way; sums with it stay below 2**63.
_NONE = 1 << 62


def _layer(cost: np.ndarray, edges: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padded total of the first j lengths for each j, with one more bucket than ``cost`` has, and where that bucket begins: the first of equal places."""
    n = len(edges)
    new, choice = np.full(n + 1, _NONE), np.zeros(n + 1, np.int64)
    new[0] = 0
    first, last, low, high = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
    while len(first):
        middle = (first + last) // 2
        sizes = np.minimum(high, middle - 1) - low + 1
        starts = np.cumsum(sizes) - sizes
        begin = np.arange(sizes.sum()) - np.repeat(starts - low, sizes)
        j = np.repeat(middle, sizes)
        way = cost[begin] + edges[j - 1] * (total[j] - total[begin])
        least = np.minimum.reduceat(way, starts)
        best = np.minimum.reduceat(np.where(way == np.repeat(least, sizes), begin, n), starts)
        new[middle], choice[middle] = least, best
        parts = (np.concatenate([first, middle + 1]), np.concatenate([middle - 1, last]), np.concatenate([low, best]), np.concatenate([best, high]))
        some = parts[0] <= parts[1]
        first, last, low, high = (p[some] for p in parts)
    return new, choice


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Boundaries, of at most ``buckets``, with the least padded total, from ascending lengths; of equal choices the shorter lower buckets."""
    n = len(lengths)
    edges = np.asarray(lengths, np.int64)
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    cost, back = np.full(n + 1, _NONE), []
    cost[0] = 0
    for _ in range(min(buckets, n)):
        cost, choice = _layer(cost, edges, total)
        back.append(choice)
    out, j = [], n
    for choice in reversed(back):
        if j:
            out.append(int(edges[j - 1]))
            j = int(choice[j])
    return sorted(out)


def _by_bucket(boundaries: list[int], values: list[int], length: Column) -> Column:
    out = F.lit(values[-1] if values else 0)
    for b, v in reversed(list(zip(boundaries[:-1], values[:-1]))):
        out = F.when(length <= b, F.lit(v)).otherwise(out)
    return out


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, length, bucket, bucket_len, batch_id, slot and padding of every document.

    ``length`` defaults to the words of ``text`` and one end."""
    length = F.size(words_column(F.col("text"))) + 1 if length is None else length
    rows = docs.select("doc_id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"))
    hist = rows.groupBy("length").agg(F.count("*").alias("count")).toPandas().sort_values("length")
    edges, counts = hist["length"].to_numpy(np.int64), hist["count"].to_numpy(np.int64)
    bounds = best_boundaries(edges, counts, buckets)
    sizes = np.bincount(np.searchsorted(bounds, edges), weights=counts, minlength=max(1, len(bounds))) if bounds else np.zeros(1)
    n = F.col("length")
    rows = rows.withColumns({
        "bucket": _by_bucket(bounds, list(range(len(bounds))), n).cast("int"),
        "bucket_len": _by_bucket(bounds, bounds, n).cast("long"),
        "rows_of_batch": _by_bucket(bounds, [max(1, token_budget // max(1, b)) for b in bounds], n).cast("int"),
        "chunk": F.pmod(F.xxhash64("doc_id", "length"), _by_bucket(bounds, [max(1, -(-int(s) // chunk_rows)) for s in sizes], n).cast("long")).cast("int"),
    })
    place = F.row_number().over(W.partitionBy("bucket", "chunk").orderBy("doc_id", "length")) - 1
    rows = rows.withColumn("place", place)
    return rows.select(
        "doc_id", "length", "bucket", "bucket_len",
        F.concat_ws("-", "bucket", "chunk", F.floor(F.col("place") / F.col("rows_of_batch")).cast("long")).alias("batch_id"),
        (F.col("place") % F.col("rows_of_batch")).cast("int").alias("slot"), (F.col("bucket_len") - n).alias("padding"),
    )

"""Importance resampling towards a target's distribution of hashed n-grams.

An integer word dictionary stands for the words: a worker gives every distinct word an id, a block of texts becomes one
array of ids, and an n-gram is the id of its distinct prefix beside the id of its last word. The distinct tuples of a block
come from one sort; each one's bytes, put together again from the dictionary's words and a space, are hashed once, going on
from its prefix's hash, and its bucket is joined back to all its places through the sort's inverse. So no n-gram is made as
a string or hashed again for a repetition, and no n-gram leaves its task: a task gives at most one count a bucket. The
dictionary is a worker's own and starts anew when it is full, since a table of all words grows with the corpus; ids and
blocks never change a result.

Two passes read the texts: one counts buckets of the corpus and of the target, one weighs documents by the buckets' gains,
of which there is a fixed number. Ranks of the draw are numbers over range partitions.

Null and blank texts have no features and weight 0. A document without an id has a weight, but no score, and is neither
drawn nor counted among those that can be. Rows that repeat an id are documents of their own, with equal noise; of equal
rows either may come first. An empty corpus gives no rows, an empty target counts 0 everywhere. Kept columns with the name
of a result are left out.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweir.operators.ranking import numbered

from .common import kept_columns

#: Words that a worker's dictionary holds before it starts anew; words of texts that are taken as one block.
DICTIONARY, BLOCK = 500_000, 2_000_000
#: A-Z to a-z; other ASCII but digits and letters to a space, which parts words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Dictionary(dict):
    """Words to ids 0, 1, 2 ...: a word that is looked up for the first time gets the next one."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


@lru_cache(maxsize=1)
def dictionary() -> Dictionary:
    """The worker process's own dictionary: it serves all its tasks."""
    return Dictionary()


def _fresh(book: Dictionary) -> None:
    if len(book) > DICTIONARY:
        book.clear()
        book.words.clear()


def feature_buckets(ids: np.ndarray, sizes: np.ndarray, words: list[bytes], longest: int, buckets: int):
    """For each length of n-grams: distinct tuples' buckets, which of them each n-gram is, and of which document it is.

    ``ids`` are the words of documents of the given ``sizes``, one after another."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    prefix = np.zeros(len(ids), np.int64)  # of the n-gram that ends before each word: the empty one
    hashes = [0]
    for n in range(1, longest + 1):
        at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])  # where an n-gram of one document begins
        distinct, inverse = np.unique(prefix[at] << 32 | ids[at + n - 1], return_inverse=True)
        befores, lasts = (distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist()
        joint = hashes if n == 1 else [zlib.crc32(b" ", h) for h in hashes]
        hashes = [zlib.crc32(words[w], joint[p]) for p, w in zip(befores, lasts)]
        yield np.array(hashes, np.int64) % buckets, inverse, doc[at]
        prefix = np.zeros(len(ids), np.int64)
        prefix[at] = inverse


def _blocks(batches, columns: list[str]):
    """Kept columns, word ids and sizes of blocks of documents."""
    book = dictionary()
    held, ids, sizes, n = [], [], [], 0
    for b in batches:
        _fresh(book) if not n else None
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            for t in part.column("_text").to_pylist():
                words = words_of(t)
                ids.append(np.fromiter(map(book.__getitem__, words), np.int64, len(words)))
                sizes.append(len(words))
                n += len(words)
            held.append(part.select(columns))
            if n > BLOCK:
                yield held, np.concatenate(ids), np.array(sizes), book.words
                held, ids, sizes, n = [], [], [], 0
                _fresh(book)
    if held:
        yield held, np.concatenate(ids), np.array(sizes), book.words


def bucket_counts(texts: DataFrame, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; buckets without any have no row."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for _, ids, sizes, words in _blocks(batches, []):
            for bucket, inverse, _ in feature_buckets(ids, sizes, words, longest, buckets):
                np.add.at(counts, bucket, np.bincount(inverse, minlength=len(bucket)))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    return texts.select(F.col("text").alias("_text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of all buckets, from counts: 1000 times the logarithm of the smoothed target's share over the corpus's."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.ln(share)).alias("gain"))


def document_weights(docs: DataFrame, gains: np.ndarray, longest: int = 2, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id), n_words, n_features and weight, the floored mean of the features' ``gains``."""
    columns = kept_columns(docs, columns, ("n_words", "n_features", "weight"))
    gains = np.asarray(gains, np.int64)

    def run(batches):
        for held, ids, sizes, words in _blocks(batches, columns):
            total, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for bucket, inverse, doc in feature_buckets(ids, sizes, words, longest, len(gains)):
                n += np.bincount(doc, minlength=len(sizes))
                np.add.at(total, doc, gains[bucket][inverse])
            kept = pa.Table.from_batches(held).combine_chunks()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            made = [pa.array(sizes.astype(np.int64)), pa.array(n), pa.array(weight)]
            arrays = [pa.concat_arrays(kept.column(c).chunks) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, *made], [*columns, "n_words", "n_features", "weight"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, fields + "n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """Noise of a document in units of the weights, from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = 10_000, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id) with n_features, weight, score and rank: of the documents with ``min_words`` words the
    ``percent`` of highest score, 1, 2, 3 ... ; null for those not drawn. Ties go to the smaller doc_id."""
    made = ("n_words", "n_features", "weight", "score", "rank")
    columns = kept_columns(docs, columns, made)
    found = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    gains = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row a bucket
        gains[r["bucket"]] = r["gain"]
    rows = docs.select(F.struct(*columns).alias("_kept"), F.col("doc_id").alias("_id"), "text")
    scored = document_weights(rows, gains, longest, ["_kept", "_id"]).withColumn("score", F.col("weight") + gumbel(F.col("_id")))
    can = F.coalesce(F.col("score").isNotNull() & (F.col("n_words") >= min_words), F.lit(False))
    placed = numbered(scored.withColumn("_can", can), [F.col("_can").desc(), F.col("score").desc(), F.col("_id").asc()], "rank")
    n = placed.agg(F.floor(F.lit(percent) * F.count_if("_can") / 100).alias("_drawn"))
    rank = F.when(F.col("_can") & (F.col("rank") <= F.col("_drawn")), F.col("rank"))
    return placed.crossJoin(F.broadcast(n)).select("_kept.*", "n_features", "weight", "score", rank.alias("rank"))


def sql(percent: int = 25, min_words: int = 20, buckets: int = 10_000) -> str:
    """The same draw (features of one and two words) as DuckDB SQL, with crc32 as a fold over bytes."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
fd AS (SELECT i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM d),
fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM b),
v AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)),
c0 AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
v2 AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda k: ('0x' || h[2 * k + 1:2 * k + 2])::BIGINT)),
  lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % {buckets} AS bucket FROM v, c0),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN v2 USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN v2 USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM fd)::DOUBLE + {buckets}) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM fb)::DOUBLE + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT i, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fd JOIN v2 USING (f) JOIN g USING (bucket) GROUP BY i),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || sha256('7:' || doc_id::VARCHAR)[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (i)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {min_words} AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {min_words} AND score IS NOT NULL
  AND place <= {percent} * (SELECT count(*) FROM z WHERE n_words >= {min_words} AND score IS NOT NULL) // 100 THEN place END AS rank FROM r"""

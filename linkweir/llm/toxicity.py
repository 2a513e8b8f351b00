"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Character 4- to 6-grams of the lower-cased text (white-space runs as one space, one space at either end) are hashed to 64
bits and taken as present or absent. From the labelled sample each n-gram has a smoothed log ratio of its share of the toxic
and of the clean documents; the n-grams whose ratio stands out of chance are the features, with the ratio as their value. A
logistic regression over them, fitted by Adam steps in numpy on the driver with both classes weighing alike, gives the score.
A text longer than ``WINDOW`` is scored by half-overlapping windows, whose evidence is averaged as a likelihood ratio, so
that neither collisions nor chance hits grow with the text.

The sample has at most ``PER_CLASS`` documents of either class. Scoring reads
every whole text, one Arrow batch at a time. Null and empty texts get the score of a text without features; a null id
stays null, ids may be of any type; repeated rows are scored alike; ties in the choice of features are broken by key. Without training
rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, join_sample, kept_columns, labelled_sample, materialize

SIZES = (4, 5, 6)
#: Bound of the training sample: documents of either class.
PER_CLASS = 8000
#: Size of the linear model: the most features, those that stand out most; and how far (in standard errors) a log ratio must be from 0.
MAX_FEATURES, MIN_Z = 4096, 4.5
PIECE = 1 << 20
#: Keys that a task counts before it hands them on; bits of a key that the sieve before the look-up reads.
FLUSH, SIEVE_BITS = 2_000_000, 18
#: Characters of a window; each begins half a window after the one before.
WINDOW = 1 << 14


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """64-bit keys of the n-grams of each size, from code points."""
    out = []
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in SIZES:
        if len(x) < n:
            continue
        h = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            h *= np.uint64(0x100000001B3)
            h += x[k : len(x) - n + 1 + k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93 + n * 2)
        h ^= h >> np.uint64(29)
        out.append(h.view(np.int64))
    return out


def _pieces(text: str | None):
    """Offset and keys by size of each overlapping piece of the text; together they hold all its n-grams."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    for i in range(0, len(codes), PIECE):
        yield i, _hashes(codes[i : i + PIECE + max(SIZES) - 1])


def bucket_runs(text: str | None):
    """Arrays of keys that together hold all n-grams of the whole text."""
    for _, runs in _pieces(text):
        yield from runs


def _sieve_place(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)


def sieve_of(keys: np.ndarray) -> np.ndarray:
    """Which first bits occur among the keys: most n-grams of a text are none of them and need no look-up."""
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[_sieve_place(keys)] = True
    return sieve


def hits(text: str | None, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where in the text n-grams stand that equal one of the sorted ``keys`` in all bits, that key's place, and the text's n-gram positions."""
    size, where, which = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, runs in _pieces(text) if len(keys) else ():
        for r in runs:
            size = max(size, start + len(r))
            i = np.flatnonzero(sieve[_sieve_place(r)])
            at = np.minimum(np.searchsorted(keys, r[i]), len(keys) - 1)
            same = keys[at] == r[i]
            where.append(i[same] + start)
            which.append(at[same])
    return np.concatenate(where), np.concatenate(which), size


def evidence(where: np.ndarray, which: np.ndarray, size: int, beta: np.ndarray) -> float:
    """Log of the mean, over the windows of the text, of exp(sum of the weights of a window's distinct n-grams).

    That is the likelihood ratio of one toxic window at an unknown place, so that chance hits do not add up with length."""
    if not len(which):
        return 0.0
    block = where // (WINDOW // 2)
    n = max(1, (size - 1) // (WINDOW // 2))
    pair = np.concatenate([np.minimum(block, n - 1), np.maximum(block - 1, 0)]) * len(beta) + np.concatenate([which, which])
    pair = np.unique(pair)
    z = np.bincount(pair // len(beta), weights=beta[pair % len(beta)], minlength=n)
    return float(z.max() + np.log(np.exp(z - z.max()).mean()))


def _count_batches(batches):
    held, size = {0: [], 1: []}, 0
    n = {0: 0, 1: 0}

    def out():
        sides = [np.unique(np.concatenate(held[y]) if held[y] else np.zeros(0, np.int64), return_counts=True) for y in (1, 0)]
        for (keys, count), names in zip(sides, (("pos", "neg"), ("neg", "pos"))):
            cols = {"key": pa.array(keys), names[0]: pa.array(count.astype(np.int64)), names[1]: pa.array(np.zeros(len(keys), np.int64))}
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in ("key", "pos", "neg")})
        held[0].clear(), held[1].clear()

    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            seen = np.zeros(0, np.int64)
            runs = list(bucket_runs(text)) if len(text or "") < PIECE else None
            if runs is None:
                for r in bucket_runs(text):
                    seen = np.union1d(seen, r)
            elif runs:
                seen = np.unique(np.concatenate(runs))
            held[y].append(seen)
            n[y] += 1
            size += len(seen)
            if size > FLUSH:
                yield from out()
                size = 0
    yield from out()
    yield pa.RecordBatch.from_pydict({"key": pa.array([None], pa.int64()), "pos": [n[1]], "neg": [n[0]]})


def fit_linear(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, values: np.ndarray, l2: float = 2.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on sparse rows (indices of present features, whose values are fixed)."""
    n = len(values)
    lens = np.array([len(r) for r in rows])
    idx = np.concatenate(rows) if len(rows) and lens.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lens)
    beta, bias = np.zeros(n), 0.0
    m1, m2, b1, b2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    total = weight.sum()
    for t in range(1, 6 * steps + 1):  # Adam: few passes over a bounded sample
        z = np.bincount(owner, weights=(beta * values)[idx], minlength=len(rows)) + bias
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        g = np.bincount(idx, weights=err[owner], minlength=n) * values + l2 * beta / total
        gb = err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        lr = 0.05
        beta -= lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        bias -= lr * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    return beta * values, bias


def fit(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted keys of the features, their weights and the intercept. Two passes over the sampled documents: counts, then features."""
    taken, _ = labelled_sample(labels, label, mod, remainder, per_class)
    none = np.zeros(0, np.int64), np.zeros(0)
    if not taken:
        return *none, 0.0
    sample = join_sample(docs, taken)
    counts = sample.mapInArrow(_count_batches, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = materialize(counts, "ngram-counts")
    size = [r for r in counts.where(F.col("key").isNull()).collect()]
    n_pos, n_neg = (float(size[0]["pos"]), float(size[0]["neg"])) if size else (0.0, 0.0)
    if not n_pos or not n_neg:
        return *none, 30.0 if n_pos else -30.0 if n_neg else 0.0
    p, q = F.col("pos") + 1.0, F.col("neg") + 1.0
    rated = counts.where(F.col("key").isNotNull()).withColumn("ratio", F.log(p / (n_pos + 2)) - F.log(q / (n_neg + 2)))
    rated = rated.withColumn("z", F.abs("ratio") / F.sqrt(1 / p + 1 / q)).where(F.col("z") >= MIN_Z)
    best = rated.orderBy(F.desc("z"), "key").limit(MAX_FEATURES).select("key", "ratio").toPandas().sort_values("key")
    keys, values = best["key"].to_numpy(np.int64), best["ratio"].to_numpy(float)
    sieve = sieve_of(keys)

    def features(batches):
        for b in batches:
            got = [np.unique(hits(t, keys, sieve)[1]).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("sample_id"), "x": pa.array(got, pa.binary()), "y": b.column("y")})

    got = sorted(sample.mapInArrow(features, "id string, x binary, y int").collect())  # in one order, so that the fit is the same each time
    rows = [np.frombuffer(r["x"], np.int32).astype(np.int64) for r in got]
    y = np.array([r["y"] for r in got], float)
    beta, bias = fit_linear(rows, y, np.where(y > 0, max(1, (y == 0).sum()) / max(1, (y > 0).sum()), 1.0), values)
    return keys, beta, float(bias)


def logits(texts: list, model: tuple[np.ndarray, np.ndarray, float], sieve: np.ndarray) -> np.ndarray:
    keys, beta, bias = model
    return np.array([evidence(*hits(t, keys, sieve), beta) for t in texts]) + bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id) of every document with its score."""
    sieve = sieve_of(model[0])
    columns = kept_columns(docs, columns, ("score",))
    given = docs.select(*columns, F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            s = 1 / (1 + np.exp(-np.clip(logits(b.column("_text").to_pylist(), model, sieve), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s, pa.float64())], [*columns, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    return given.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 3, remainder: int = 1, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels only from ids that are not held out."""
    scored = score(docs, fit(docs, labels, label, mod, remainder, per_class))
    return scored.select("doc_id", is_held_out("doc_id", mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; no shuffle."""
    sieve = sieve_of(model[0])
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(logits(b.column("text").to_pylist(), model, sieve) < limit, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

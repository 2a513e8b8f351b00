"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Words are maximal runs of letters, of digits or of one other character class, as UTF-8 bytes, hashed into ``BUCKETS``.
Each bucket has a fixed sparse random index vector; its word vector is the sum of the index vectors of the words up to
``REACH`` places away, counted over all documents (per task, then summed by slices in ``ROUNDS`` rounds of at most ``FAN`` parts, so
no group grows with the number of tasks and the driver gets ``BUCKETS * DIM`` numbers for every ``FAN**ROUNDS`` tasks). Vectors are damped, centred and brought to length 1. A document is pooled
to the mean of its word vectors and the mean of the products of neighbours. The network (tanh layer, logistic unit) is
fitted on at most ``PER_CLASS`` labelled documents of either class, weighted back to the classes' shares; its temperature
is chosen on a fifth of that sample that the fit has not seen.

Null and empty texts pool to zeros; a null id stays null, ids may be of any type; repeated rows are scored alike. Without training rows every
score is 0.5.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, join_sample, kept_columns, labelled_sample

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Bound of the training sample: documents of either class.
PER_CLASS = 6000
HIDDEN = 24
SLICES, FAN, ROUNDS = 64, 64, 3
PIECE = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 letter (and all of UTF-8's upper half), 2 digit, else one class a byte."""
    c = np.arange(256, dtype=np.int16) + 10
    c[[9, 10, 11, 12, 13, 32]] = 0
    c[128:] = 1
    for a, z in ((65, 90), (97, 122)):
        c[a : z + 1] = 1
    c[48:58] = 2
    return c


CLASSES = _classes()
_POWERS: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]))
        _POWERS[str(base)] = have
    return have[:n]


def word_buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the words in a run of UTF-8 bytes, in order; hashes are differences of one running sum."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = CLASSES[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(data)]])
    full = kind[start] != 0
    start, end = start[full], end[full]
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_MUL, len(data)))])
        h = (run[end] - run[start]) * _power(_INV, len(data))[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(50)).astype(np.int64)


def _pieces(text: str | None):
    raw = (text or "").encode("utf-8", "surrogatepass")
    i = 0
    while i < len(raw):
        j = raw.find(b" ", i + PIECE)  # no word is cut
        j = len(raw) if j < 0 else j
        yield word_buckets(np.frombuffer(raw, np.uint8, j - i, i))
        i = j


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _count_contexts(batches):
    places, signs = _index_vectors()
    total = np.zeros(BUCKETS * DIM, np.float64)

    def add(words, breaks):
        for off in range(1, REACH + 1):
            if len(words) <= off:
                continue
            same = breaks[off:] == breaks[:-off]
            a, b = words[off:][same], words[:-off][same]
            for x, y in ((a, b), (b, a)):
                for s in range(NONZERO):
                    total[:] += np.bincount(x * DIM + places[y, s], weights=signs[y, s], minlength=len(total))

    held, owner, size, k = [], [], 0, 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            k += 1
            for words in _pieces(text):
                held.append(words)
                owner.append(np.full(len(words), k))
                size += len(words)
            if size > 400_000:  # between texts only
                add(np.concatenate(held), np.concatenate(owner))
                held, owner, size = [], [], 0
    if size:
        add(np.concatenate(held), np.concatenate(owner))
    part = TaskContext.get().partitionId() // FAN
    parts = total.reshape(SLICES, -1)
    blobs = [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part", "v"])


def _sum_slices(got: pd.DataFrame) -> pd.DataFrame:
    v = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in got["v"])
    return pd.DataFrame({"slice": got["slice"][:1], "part": got["part"][:1] // FAN, "v": [zlib.compress(v.tobytes(), 1)]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, from all documents."""
    schema = "slice int, part int, v binary"
    parts = docs.select("text").mapInArrow(_count_contexts, schema)
    for _ in range(ROUNDS):
        parts = parts.groupBy("slice", "part").applyInPandas(_sum_slices, schema)
    v = np.zeros((SLICES, BUCKETS * DIM // SLICES))
    for r in parts.collect():
        v[r["slice"]] += np.frombuffer(zlib.decompress(r["v"]), np.int64)
    v = v.reshape(BUCKETS, DIM)
    v = np.sign(v) * np.log1p(np.abs(v))
    used = np.abs(v).sum(1) > 0
    if used.any():
        v[used] -= v[used].mean(0)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.maximum(norm, 1e-9)).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean of the word vectors and mean of the products of neighbours, over the whole text."""
    mean, product, n, v = np.zeros(DIM), np.zeros(DIM), 0, vectors[:0]
    for words in _pieces(text):
        v = np.concatenate([v[-1:], vectors[words]])  # with the last word of the piece before
        product += np.einsum("ij,ij->j", v[1:], v[:-1], dtype=np.float64)
        v = v[len(v) - len(words) :]
        n += len(words)
        mean += v.sum(0, dtype=np.float64)
    return np.concatenate([mean, product]) / max(n, 1)


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600) -> dict:
    """Two layers by Adam, then the temperature that gives the least log loss on a fifth of the rows."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    mu, sd = x[fit].mean(0), x[fit].std(0) + 1e-6
    p = [rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]

    def logits(z, q):
        h = np.tanh(z @ q[0] + q[1])
        return h, h @ q[2] + q[3]

    z, t, w = (x[fit] - mu) / sd, y[fit], weight[fit] / weight[fit].sum()
    for k in range(1, steps + 1):
        h, o = logits(z, p)
        e = w * (1 / (1 + np.exp(-np.clip(o, -30, 30))) - t)
        dh = np.outer(e, p[2]) * (1 - h * h)
        g = [z.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
        for i in range(4):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    temperature = 1.0
    if len(held):
        o = logits((x[held] - mu) / sd, p)[1]

        def loss(temp):
            return float((weight[held] * np.logaddexp(0, np.where(y[held] > 0, -o, o) / temp)).sum())

        temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return {"mu": mu, "sd": sd, "p": p, "temperature": float(temperature)}


def predict(x: np.ndarray, net: dict | None) -> np.ndarray:
    if net is None:
        return np.full(len(x), 0.5)
    z = (x - net["mu"]) / net["sd"]
    o = np.tanh(z @ net["p"][0] + net["p"][1]) @ net["p"][2] + net["p"][3]
    return 1 / (1 + np.exp(-np.clip(o / net["temperature"], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, per_class: int = PER_CLASS) -> tuple[np.ndarray, dict | None]:
    vectors = word_vectors(docs)
    taken, weights = labelled_sample(labels, label, mod, remainder, per_class)
    if not taken:
        return vectors, None

    def pooled(batches):
        for b in batches:
            got = [pool(t, vectors).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("sample_id"), "x": pa.array(got, pa.binary()), "y": b.column("y")})

    got = sorted(join_sample(docs, taken).mapInArrow(pooled, "id string, x binary, y int").collect())
    if not got:
        return vectors, None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(float)
    y = np.array([r["y"] for r in got], float)
    return vectors, train_network(x, y, np.where(y > 0, weights[1], weights[0]))


def score(docs: DataFrame, model: tuple[np.ndarray, dict | None], columns: list[str] | None = None) -> DataFrame:
    vectors, net = model
    columns = kept_columns(docs, columns, ("score",))
    given = docs.select(*columns, F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            x = [pool(t, vectors) for t in b.column("_text").to_pylist()]
            s = predict(np.stack(x), net) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s, pa.float64())], [*columns, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    return given.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, remainder: int = 0, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels only from ids that are not held out."""
    scored = score(docs, fit(docs, labels, label, mod, remainder, per_class))
    return scored.select("doc_id", is_held_out("doc_id", mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

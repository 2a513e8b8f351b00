"""Language-model scores by context-tree weighting over bytes.

A text is its words (A-Z lower-cased), each followed by a space, and one end, a space alone. A byte is decomposed into eight
binary decisions; the context of each is the decisions before it in the byte and the bytes before it in the running text: the
first ``CROSS`` bytes of a word (its space among them) see ``CROSS + 1`` bytes, back into the words before (at the start of a
text, spaces); later bytes see the word's own bytes and the space before it, ``DEPTH`` bytes at most. Every node of the
context tree has a Krichevsky-Trofimov estimate of its counts, and its probability mixes its own estimate with its
children's product, half and half, over all depths, so the trained tree predicts with the weights that the whole training
corpus gives to each depth. A node without counts predicts 1/2.

1. count words (per task, then by word), for the base and for the bytes after the first ``CROSS`` of each word; count the
   windows around word starts in the running text (per task, then by event); held-out texts take part with count 0;
2. events (context, byte) with counts, from both;
3. nodes of depth 2 and more, in groups by the context's last two bytes, of which a task holds some at a time;
   depths 0 and 1 on the driver, from at most 2**16 sums;
4. log10 of each event, then of each word's later bytes, then of each document.

Look-ups use a head and a tail: the most frequent entries, of a fixed number, are sent to all tasks; the rest are joined,
so nothing that grows with the corpus is broadcast and nothing is left out.

Null and empty texts have one token, the end. A null id stays null and is trained on; repeated rows are scored each.
Without training texts all counts are 0: the base gives every token 1, the model 1/2 to every bit.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, materialize, words_of

DEPTH = 6
#: Bytes at the start of a word whose context runs back over the words before it.
CROSS = 3
#: Most entries of the heads that are sent to all tasks.
HEAD_EVENTS, HEAD_WORDS = 1 << 19, 1 << 17
FLUSH = 400_000
#: Events of which a task builds nodes at a time, besides the rest of the last group.
CHUNK = 100_000
#: Characters of texts whose words are held at a time.
PIECE = 1 << 21
START = 1 << 56
_PAD = b" " * DEPTH


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series after eight steps of the recurrence."""
    shift = np.zeros_like(x)
    prod = np.ones_like(x)
    for k in range(8):
        prod = prod * (x + k)
    shift = np.log(prod)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones, in any order."""
    a, b = a.astype(float), b.astype(float)
    big = (a + b) > 1e13  # beyond, the product of the recurrence would lose digits; Stirling alone is exact enough
    out = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)
    return np.where(big, out, np.minimum(out, 0.0))


def events_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context bytes, then the byte: 56 bits) of the events after the first CROSS bytes of each word, and the words' numbers."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(_PAD + (b" " + _PAD).join(words) + b" ", np.uint8).astype(np.int64)
    first = np.cumsum(sizes + 1 + DEPTH) - sizes - 1  # of each word's first byte
    later = np.maximum(sizes + 1 - CROSS, 0)
    owner = np.repeat(np.arange(len(words)), later)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(later) - later, later) + first[owner] + CROSS
    key = data[at].copy()
    for k in range(1, DEPTH + 1):
        key |= data[at - k] << (8 * k)
    return key, owner


def starts_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the texts (lists of words): the window around its start, and the text's number.

    A window holds min(word's length, 2), the three bytes before the space before the word, and its first three bytes (0 where
    there is none): 2 + 48 bits."""
    n = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    sizes = np.fromiter(map(len, chain.from_iterable(texts)), np.int64, len(owner))
    data = np.frombuffer(b"".join(x for t in texts for x in (_PAD, b" ".join(t), b" ")) + _PAD, np.uint8).astype(np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1 + DEPTH * (owner + 1)
    out = np.minimum(sizes, 2)
    for k in (-4, -3, -2, 0, 1, 2):
        out = (out << 8) | (data[at + k] if k <= 0 else np.where(sizes >= k, data[at + k], 0))
    return out, owner


def events_of_starts(windows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the events of the first, second and third byte of words, from windows around word starts, and the windows' numbers.

    ``START`` marks the keys; the two last places of the context are empty."""
    size = windows >> 48
    t3, t2, t1, b0, b1, b2 = ((windows >> k) & 255 for k in (40, 32, 24, 16, 8, 0))
    space = np.full(len(windows), 32)
    out = []
    for k, path in enumerate(((b0, space, t1, t2, t3), (b1, b0, space, t1, t2), (b2, b1, b0, space, t1))):
        which = np.flatnonzero(size >= k)
        out.append((START | sum(x << (8 * j) for j, x in enumerate(path))[which], which))
    return out


def pieces_of(texts: list[str | None]):
    """Words and end of the texts, in runs of about PIECE characters: number of the first text, list of lists."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        got = words_of(text)
        got.append(b"")
        held.append(got)
        size += len(text or "")
        if size > PIECE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _sum_by(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=c, minlength=len(u))


class Subtree:
    """The nodes of depth 2 to DEPTH above some events; whole groups by the context's last two bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte, ctx = keys & 255, keys >> 8
        level = np.arange(8)[:, None]
        heap = (1 << level) | (byte >> (8 - level))
        bit = (byte >> (7 - level)) & 1
        node = ((ctx << 8) | heap).ravel()
        self.bit, self.heap, self.ctx = bit, heap, ctx
        u, self.of_event = np.unique(node, return_inverse=True)
        c = np.broadcast_to(counts.astype(float), bit.shape).ravel()
        ones = np.bincount(self.of_event, weights=c * bit.ravel(), minlength=len(u))
        zeros = np.bincount(self.of_event, weights=c, minlength=len(u)) - ones
        log_w = kt_block(zeros, ones)
        #: By depth, deepest first: ones' estimate, own weight.
        self.nodes = [((ones + 0.5) / (zeros + ones + 1), np.ones(len(u)))]
        self.parents = []
        for depth in range(DEPTH - 1, 1, -1):
            up = (((u >> 8) & ((1 << (8 * depth)) - 1)) << 8) | (u & 255)
            u, inv = np.unique(up, return_inverse=True)
            self.parents.append(inv)
            zeros, ones, kids = (np.bincount(inv, weights=x, minlength=len(u)) for x in (zeros, ones, log_w))
            own = kt_block(zeros, ones)
            log_w = np.logaddexp(own, kids) - math.log(2)
            self.nodes.append(((ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(kids - own, -700, 700)))))
        self.top = (u, zeros, ones, log_w)

    def log10(self, upper: Upper) -> np.ndarray:
        """log10 of the probability of each event's byte."""
        at = self.of_event
        p = self.nodes[0][0][at]
        for (kt, w), parent in zip(self.nodes[1:], self.parents):
            at = parent[at]
            p = w[at] * kt[at] + (1 - w[at]) * p
        heap = self.heap.ravel()
        last = np.broadcast_to(self.ctx & 255, self.heap.shape).ravel()
        for kt, w, place in ((upper.kt1, upper.w1, last * 256 + heap), (upper.kt0, upper.w0, heap)):
            p = w[place] * kt[place] + (1 - w[place]) * p
        return np.log10(np.where(self.bit.ravel() == 1, p, 1 - p)).reshape(self.bit.shape).sum(0)


class Upper:
    """Depths 0 and 1 of the tree, from sums by (last byte, bit node)."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_w: np.ndarray):
        def level(place, size, zeros, ones, kids):
            z, o, k = (np.bincount(place, weights=x, minlength=size) for x in (zeros, ones, kids))
            own = kt_block(z, o)
            return z, o, (o + 0.5) / (z + o + 1), 1 / (1 + np.exp(np.clip(k - own, -700, 700))), np.logaddexp(own, k) - math.log(2)

        z, o, self.kt1, self.w1, kids = level(node, 1 << 16, zeros, ones, log_w)
        _, _, self.kt0, self.w0, _ = level(np.arange(1 << 16) & 255, 256, z, o, kids)


def _columns(batches, *names) -> list[np.ndarray]:
    got = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*got) if got else [()] * len(names))]


def _count_words(batches):
    known: Counter[bytes] = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int64())], ["word", "c"])
        known.clear()
        return batch

    for b in batches:
        for text, held in zip(b.column("text").to_pylist(), b.column("held").to_pylist()):
            got = words_of(text)
            got.append(b"")
            if held:
                for w in set(got):
                    known.setdefault(w, 0)
            else:
                known.update(got)
            if len(known) > FLUSH:
                yield out()
    yield out()


def word_counts(docs: DataFrame, held: Column) -> DataFrame:
    """word (binary; the empty word is the end) and its count in the training texts, 0 if it is in held-out texts only."""
    given = docs.select("text", held.alias("held"))
    return given.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class _Sums:
    """Counts by key of one task, summed when many have come together."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch | None:
        """The rows to hand on, if the sums have grown large."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 6 * FLUSH:
            keys, counts = _sum_by(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            if self.size > 4 * FLUSH:
                return self.rows()
        return None

    def rows(self) -> pa.RecordBatch:
        keys, counts = _sum_by(np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0), *self.counts]))
        self.keys, self.counts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "c"])


def _count_events(batches):
    sums = _Sums()
    for b in batches:
        words = b.column("word").to_pylist()
        if words:
            keys, owner = events_of(words)
            if rows := sums.add(keys, b.column("c").to_numpy().astype(float)[owner]):
                yield rows
    yield sums.rows()


def _count_starts(batches):
    """Events of the first bytes of words, from the running texts; those of held-out texts with count 0."""
    sums = _Sums()
    for b in batches:
        held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
        for first, texts in pieces_of(b.column("text").to_pylist()):
            windows, owner = starts_of(texts)
            unseen = held[first : first + len(texts)][owner]
            for part, counted in ((windows[~unseen], 1.0), (windows[unseen], 0.0)):
                u, n = np.unique(part, return_counts=True)
                for keys, which in events_of_starts(u):
                    if rows := sums.add(keys, n[which] * counted):
                        yield rows
    yield sums.rows()


def event_counts(docs: DataFrame, words: DataFrame, held: Column) -> DataFrame:
    """key and c of all events: of the running texts' word starts, and of the later bytes of the words."""
    starts = docs.select("text", held.alias("held")).mapInArrow(_count_starts, "key long, c long")
    return starts.unionByName(words.mapInArrow(_count_events, "key long, c long")).groupBy("key").agg(F.sum("c").alias("c"))


def _group_chunks(batches):
    """Events in runs of whole groups (by the context's last two bytes) of about ``CHUNK`` events."""
    keys, counts = _columns(batches, "key", "c")
    group = (keys >> 8) & 0xFFFF
    order = np.lexsort((keys, group))
    keys, counts, group = keys[order], counts[order], group[order]
    start = 0
    while start < len(keys):
        end = min(start + CHUNK, len(keys))
        end = int(np.searchsorted(group, group[end - 1], "right"))
        yield keys[start:end], counts[start:end]
        start = end


def _summaries(batches):
    for keys, counts in _group_chunks(batches):
        u, zeros, ones, log_w = Subtree(keys, counts).top
        node, inv = np.unique(((u >> 8) & 255) * 256 + (u & 255), return_inverse=True)
        sums = [np.bincount(inv, weights=x, minlength=len(node)) for x in (zeros, ones, log_w)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, *sums)], ["node", "zeros", "ones", "log_w"])


def event_scores(events: DataFrame) -> DataFrame:
    """key, c and lp (log10 of the byte in its context) of all events (key, c)."""
    spark = events.sparkSession
    events = materialize(events, "events")
    groups = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    sums = groups.mapInArrow(_summaries, "node long, zeros double, ones double, log_w double").groupBy("node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "log_w"))).toPandas()
    sums = sums.sort_values("node")
    upper = Upper(*(sums[c].to_numpy() for c in ("node", "zeros", "ones", "log_w")))

    def run(batches):
        for keys, counts in _group_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64)), pa.array(Subtree(keys, counts).log10(upper))], ["key", "c", "lp"])

    return materialize(groups.mapInArrow(run, "key long, c long, lp double"), "event-scores")


def head(table: DataFrame, size: int, always: Column | None = None):
    """The most frequent rows of a table with a count ``c``, at most ``size`` (and those that ``always`` names)."""
    band = F.floor(F.log2(F.col("c") + 1) * 8)
    bands = sorted(((r["band"], r["count"]) for r in table.groupBy(band.alias("band")).count().collect()), reverse=True)  # some hundred at most
    total, least = 0, None
    for b, n in bands:
        if total + n > size:
            break
        total, least = total + n, b
    cond = F.lit(False) if least is None else band >= least
    return table.where(cond if always is None else cond | always)


def of_start() -> Column:
    """Whether an event is of the first bytes of words."""
    return F.shiftright("key", 56) == 1


def word_scores(words: DataFrame, events: DataFrame) -> DataFrame:
    """word, c and lp (log10 of the word's bytes after the first CROSS, its space among them)."""
    rows = head(events, HEAD_EVENTS).select("key", "lp").toPandas().sort_values("key")
    top, top_lp = rows["key"].to_numpy(np.int64), rows["lp"].to_numpy(float)

    def run(batches):
        for b in batches:
            w = b.column("word").to_pylist()
            if not w:
                continue
            keys, owner = events_of(w)
            place = np.minimum(np.searchsorted(top, keys), max(0, len(top) - 1))
            hit = top[place] == keys if len(top) else np.zeros(len(keys), bool)
            lp = np.bincount(owner[hit], weights=top_lp[place[hit]], minlength=len(w)).astype(float)
            n = np.bincount(owner[~hit], minlength=len(w))
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(keys[~hit]))
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp, pa.float64()), tail], ["word", "c", "lp", "tail"])

    got = materialize(words.mapInArrow(run, "word binary, c long, lp double, tail array<long>"), "word-parts")
    rest = got.where(F.size("tail") > 0).select("word", "c", F.col("lp").alias("part"), F.explode("tail").alias("key"))
    rest = rest.join(events.select("key", F.col("lp").alias("more")), "key").groupBy("word").agg(F.first("c").alias("c"), (F.first("part") + F.sum("more")).alias("lp"))
    return materialize(got.where(F.size("tail") == 0).select("word", "c", "lp").unionByName(rest), "word-scores")


def _lookup(top: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted ``top``, and which are there."""
    place = np.minimum(np.searchsorted(top, keys), max(0, len(top) - 1))
    return place, top[place] == keys if len(top) else np.zeros(len(keys), bool)


def score_texts(docs: DataFrame, mod: int = 10, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document.

    Trained on the documents whose crc32(doc_id) mod ``mod`` is not ``remainder``."""
    held = is_held_out("doc_id", mod, remainder)
    words = materialize(word_counts(docs, held), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    events = event_scores(event_counts(docs, words, held))
    starts = events.where(of_start())
    scores = word_scores(words, events.where(~of_start()))
    n, den = total["n"], total["n"] + 0.1 * (total["v"] + 1)
    rows = head(scores, HEAD_WORDS, F.col("word") == F.lit(b"")).toPandas()
    index = {bytes(w): i for i, w in enumerate(rows["word"])}
    count, lp = rows["c"].to_numpy(np.int64), rows["lp"].to_numpy(float)
    known, base = (count > 0).astype(np.int64), np.log10((count + 0.1) / den)
    rows = head(starts, HEAD_EVENTS).select("key", "lp").toPandas().sort_values("key")
    top, top_lp = rows["key"].to_numpy(np.int64), rows["lp"].to_numpy(float)

    def starts_lp(texts):
        """Of each text, the sum over its word starts' events in the head, and the keys of the others with their numbers."""
        windows, owner = starts_of(texts)
        u, inv = np.unique(windows, return_inverse=True)
        sums, rest = np.zeros(len(u)), [[] for _ in texts]
        for keys, which in events_of_starts(u):
            place, hit = _lookup(top, keys)
            sums[which[hit]] += top_lp[place[hit]]
            missing = np.full(len(u), -1, np.int64)
            missing[which[~hit]] = keys[~hit]
            at = np.flatnonzero(missing[inv] >= 0)
            for i, key in zip(owner[at].tolist(), missing[inv[at]].tolist()):
                rest[i].append(key)
        return np.bincount(owner, weights=sums[inv], minlength=len(texts)), rest

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            names = ("n_tokens", "n_bytes", "n_known", "base", "lp")
            out, tails, events = {k: [np.zeros(0)] for k in names}, [], []
            for _, texts in pieces_of(b.column("text").to_pylist()):
                m = [len(t) for t in texts]
                flat = list(chain.from_iterable(texts))
                owner = np.repeat(np.arange(len(texts)), m)
                at = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
                sizes = np.fromiter(map(len, flat), np.int64, len(flat))
                in_head = at >= 0
                own, at = owner[in_head], at[in_head]
                rest: list[Counter] = [Counter() for _ in texts]
                tail = np.flatnonzero(~in_head).tolist()
                for i, k in zip(owner[tail].tolist(), tail):
                    rest[i][flat[k]] += 1
                start, more = starts_lp(texts)
                values = m, np.bincount(owner, weights=sizes + 1, minlength=len(m)), *(np.bincount(own, weights=v[at], minlength=len(m)) for v in (known, base, lp))
                for k, v in zip(names, values):
                    out[k].append(v)
                out["lp"][-1] = out["lp"][-1] + start
                tails += [list(c.items()) for c in rest]
                events += more
            ids = pa.array(np.arange(uid, uid + b.num_rows))
            uid += b.num_rows
            sums = [np.concatenate(v).astype(float if k in ("base", "lp") else np.int64) for k, v in out.items()]
            lists = [pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), pa.array(events, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, *map(pa.array, sums), *lists], ["doc_id", "uid", *names, "tail", "events"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, uid long, n_tokens long, n_bytes long, n_known long, base double, lp double, tail array<struct<word:binary,n:long>>, events array<long>")
    first = materialize(first, "doc-parts")
    names = ("n_tokens", "n_bytes", "n_known", "base", "lp")
    zero = F.lit(0).cast("long")
    rest = first.select("uid", "doc_id", F.explode("tail").alias("t")).select("uid", "doc_id", "t.word", "t.n").join(scores, "word")
    rest = rest.select(
        "uid", "doc_id", zero.alias("n_tokens"), zero.alias("n_bytes"), F.when(F.col("c") > 0, F.col("n")).otherwise(zero).alias("n_known"),
        (F.col("n") * F.log10((F.col("c") + 0.1) / den)).alias("base"), (F.col("n") * F.col("lp")).alias("lp"),
    )
    more = first.select("uid", "doc_id", F.explode("events").alias("key")).groupBy("uid", "doc_id", "key").agg(F.count("*").alias("m")).join(starts.select("key", "lp"), "key")
    more = more.select("uid", "doc_id", zero.alias("n_tokens"), zero.alias("n_bytes"), zero.alias("n_known"), F.lit(0.0).alias("base"), (F.col("m") * F.col("lp")).alias("lp"))
    sums = first.select("uid", "doc_id", *names).unionByName(rest).unionByName(more).groupBy("uid", "doc_id").agg(*(F.sum(x).alias(x) for x in names))
    return sums.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("lp").alias("score"), (-F.col("lp") / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )

"""Token-id output: ids concatenated in ascending doc_id order, document boundaries in Elias-Fano form.

A file holds a run of documents, of about ``FILE_BYTES`` of ids (or one document) and ``FILE_DOCS`` documents at most::

    8 bytes    magic b"LWTOK2\\0\\0"
    12 x int64 n_docs, n_null, n_tokens, id bytes (2 or 4), first doc id, and of boundaries and doc ids each: low bits,
               words of the low part, words of the high part; last how many select samples the boundaries have
    uint64     of boundaries, then of doc ids: low parts, packed
    uint64     high parts, unary: bit (b_i >> low) + i is set for value i
    uint32     position of every 256th set bit of the high part (the select structure)
    uint16/32  token ids

Boundary i is where document i starts, so documents and offsets take about 2 + log2(n_tokens / n_docs) bits a document,
and the doc ids, ascending too, are kept in the same way, as distances from the first. There is no table of 64-bit offsets:
readers select boundaries i and i + 1, one by one or for a run of documents, from the nearest sample on.

Writing deals the documents out by ranges of (doc_id, hash of the text), so every task sorts its range and writes its files
one after another; a task that runs again writes files of other names, and only those in the committed manifest are read.
Ids are integers. Null ids come first; repeated ids are kept next to each other; a null text is empty (its only id is the
end id).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

MAGIC = b"LWTOK2\0\0"
SAMPLE = 256
#: Bytes of ids, or documents, after which a task closes a file and opens the next; documents whose boundaries are selected together.
FILE_BYTES, FILE_DOCS, RUN = 1 << 26, 1 << 18, 8192
#: Chunks that a worker remembers before it starts anew, and their bytes with those of their ids.
REMEMBERED, REMEMBERED_BYTES = 800_000, 1 << 27
#: Chunks that are encoded as one text; characters that the library, whose records of a token are large, is given at once.
JOINED, GIVEN = 500, 1 << 20
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE, _ODD_END = f"{_SPACE} {_SPACE}", f"^$|^{_SPACE}|{_SPACE}$"
_STEM = r"^(?P<stem>[A-Za-z]+)(?P<tail>[\x00-@\[-`{-\x7f](?s:.*))$"


class _Memory:
    """Texts and their ids."""

    def __init__(self):
        self.texts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def ids_of(self, texts: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of distinct texts; those of new ones come from ``learn``."""
        place = pc.index_in(texts, value_set=self.texts)
        fresh = texts.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.texts) + np.arange(len(fresh))
        if len(fresh):
            self.texts, self.ids = pa.concat_arrays([self.texts, fresh]), pa.concat_arrays([self.ids, learn(fresh)])
        return self.ids.take(pa.array(place))


class Encoder:
    """Ids of the tokenizers library for byte-level BPE, with a memory of chunks.

    The library's split pattern never joins text across a single space whose neighbours are not both white space: the
    space opens the next piece. So a text without such places is cut before its spaces, every distinct chunk is encoded
    by the library once, and ids are joined. Other texts, and tokenizers of another kind, are encoded whole.

    Nor does the pattern join a letter with what is none: a chunk of ASCII letters and a tail that begins with another ASCII
    character has the ids of both, so fewer texts are new to the library. Chunks are told apart, looked up and joined as
    Arrow arrays; only new ones become Python strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        import json

        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.cuts = self.cuts and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        #: Whether chunks are parted after their letters: no added token reaches from these into a tail.
        self.parts = not any(re.match(r"[A-Za-z]+[^A-Za-z]", t["content"]) for t in added)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.uint16 if self.width == 2 else np.uint32
        #: Which ids begin with a space: in a text cut before its spaces, those that begin a chunk.
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.tok.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        #: Texts that follow no space; letters or other undivided chunks, and all chunks, that follow one.
        self.heads, self.stems, self.chunks = _Memory(), _Memory(), _Memory()

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, group in groupby(zip(texts, accumulate(map(len, texts))), lambda x: x[1] // GIVEN):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast([t for t, _ in group], add_special_tokens=False)]
        return out

    def _alone(self, texts: pa.Array) -> pa.Array:
        """Ids of texts that follow no space."""
        return pa.array(self._whole(texts.to_pylist()), pa.large_binary())

    def _joined(self, chunks: pa.Array) -> pa.Array:
        """Ids of chunks, each after a space. They are encoded as long texts, whose ids are parted where a space begins one.

        No chunk has a space inside; ends that are other white space would make the next space unsafe."""
        odd = pc.match_substring_regex(chunks, _ODD_END)
        plain = chunks.filter(pc.invert(odd)).to_pylist()
        raw, sizes = [], []
        for at in range(0, len(plain), JOINED * 20):
            groups = [plain[i : i + JOINED] for i in range(at, min(len(plain), at + JOINED * 20), JOINED)]
            for group, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                starts = np.flatnonzero(self.opens[ids])
                if len(starts) == len(group):
                    raw.append(ids.tobytes())
                    sizes.append(np.diff(starts, append=len(ids)) * self.width)
                else:
                    apart = self._whole([" " + c for c in group])
                    raw += apart
                    sizes.append(np.array([len(x) for x in apart]))
        ends = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(raw))])
        if len(plain) == len(chunks):
            return out
        odd = odd.to_numpy(zero_copy_only=False)
        rest = self._alone(pc.binary_join_element_wise(pa.scalar("", chunks.type), chunks.filter(pa.array(odd)), pa.scalar(" ", chunks.type)))
        place = np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
        return pa.concat_arrays([out, rest]).take(pa.array(place))

    def _after_space(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks, each after a space."""
        if not self.parts:
            return self._joined(chunks)
        stem, tail = pc.extract_regex(chunks, _STEM).flatten()
        stem, tail = pc.coalesce(stem, chunks).dictionary_encode(), pc.coalesce(tail, pa.scalar("", tail.type)).dictionary_encode()
        first = self.stems.ids_of(stem.dictionary, self._joined).take(stem.indices)
        then = self.heads.ids_of(tail.dictionary, self._alone).take(tail.indices)
        return pc.binary_join_element_wise(first, then, pa.scalar(b"", pa.large_binary()))

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are cut before their spaces."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        pieces = lists.values.dictionary_encode()
        names, index, first = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64), bounds[:-1]
        after = np.ones(len(index), bool)  # the space; what begins a text follows none
        after[first] = False
        used = np.zeros(len(names), bool)
        used[index[after]] = True
        chunks = self.chunks.ids_of(names.filter(pa.array(used)), self._after_space)
        head = names.take(pa.array(index[first])).dictionary_encode()
        heads = self.heads.ids_of(head.dictionary, self._alone)
        index = (np.cumsum(used) - 1)[index]
        index[first] = len(chunks) + head.indices.to_numpy()
        joined = pa.concat_arrays([chunks, heads]).take(pa.array(index))
        _, ends, raw = joined.buffers()
        ends = np.frombuffer(ends, np.int64, len(joined) + 1)[bounds].tolist()
        raw = memoryview(raw or b"")
        return [bytes(raw[a:z]) for a, z in zip(ends, ends[1:])]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.cuts:
            return self._whole(texts.to_pylist())
        held = self.heads, self.stems, self.chunks
        if max(len(m.texts) for m in held) > REMEMBERED or sum(m.texts.nbytes + m.ids.nbytes for m in held) > REMEMBERED_BYTES:
            self._forget()
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        known = texts.filter(unsafe).dictionary_encode()
        whole = map(self._whole(known.dictionary.to_pylist()).__getitem__, known.indices.to_pylist())
        cut = iter(self._cut(texts.filter(pc.invert(unsafe))))
        return [next(whole if w else cut) for w in unsafe.to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker process's own encoder: what it remembers serves all its tasks, each of which has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def elias_fano(values: np.ndarray, upper: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Low bits, packed low parts, unary high parts and select samples of ascending ``values`` not over ``upper``."""
    n = len(values)
    low = max(0, int(upper // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    if low:
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    else:
        bits = np.zeros(0, np.uint8)
    lows = _to_words(bits)
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(at[-1]) + 1) if n else 0, np.uint8)
    high[at] = 1
    return low, lows, _to_words(high), at[::SAMPLE].astype(np.uint32)


def _to_words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8), np.uint64)


class EliasFano(NamedTuple):
    """Ascending values: ``select(i)`` is value i."""

    low: int
    lows: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    def select(self, i: int) -> int:
        return int(self.select_run(i, i + 1)[0])

    def select_run(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the words of the parts that hold them: those after the last sample before i."""
        first = i // SAMPLE * SAMPLE
        start = int(self.samples[i // SAMPLE])
        last = -(-j // SAMPLE)
        stop = int(self.samples[last]) if last < len(self.samples) else len(self.high) * 64
        word = start // 64
        bits = np.unpackbits(self.high[word : -(-stop // 64)].view(np.uint8), bitorder="little")
        at = np.flatnonzero(bits[start - word * 64 :])[i - first : j - first] + start
        out = (at - np.arange(i, j)) << self.low
        if self.low:
            bit, end = i * self.low, j * self.low
            bits = np.unpackbits(self.lows[bit // 64 : -(-end // 64)].view(np.uint8), bitorder="little")[bit % 64 :][: end - bit]
            out |= bits.reshape(j - i, self.low).astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return out


def dump(stream, doc_ids: np.ndarray, n_null: int, sizes: np.ndarray, ids: list[bytes], width: int) -> None:
    """Write one file: ``n_null`` documents without an id, then those of ascending ``doc_ids``; ``sizes`` tokens of each, their ids in ``ids``."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first = int(doc_ids[0]) if len(doc_ids) else 0
    far = doc_ids.astype(np.uint64) - np.uint64(first % (1 << 64))  # distances are below 2**64 whatever the signs
    total = int(np.sum(sizes))
    parts = elias_fano(starts, total), elias_fano(far, int(far[-1]) if len(far) else 0)
    shape = [x for low, lows, high, _ in parts for x in (low, len(lows), len(high))]
    stream.write(MAGIC + struct.pack("<12q", len(sizes), n_null, total, width, first, *shape, len(parts[0][3])))
    for _, lows, high, samples in parts:
        for a in (lows, high, samples):
            stream.write(a.tobytes())
    for b in ids:
        stream.write(b)


class TokenFile:
    """A file read back: doc ids, boundaries and the tokens of document i."""

    def __init__(self, data: bytes | pa.Buffer):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_null, self.total, width, self.first, *shape, samples = struct.unpack("<12q", view[8:104])
        at = 104

        def take(count, kind):
            nonlocal at
            out = np.frombuffer(view, kind, count, at)
            at += out.nbytes
            return out

        def values(low, lows, high, samples):
            return EliasFano(low, take(lows, np.uint64), take(high, np.uint64), take(samples, np.uint32))

        self.boundaries = values(*shape[:3], samples)
        self.far = values(*shape[3:], -(-(self.n - self.n_null) // SAMPLE))
        self.ids = take(self.total, np.uint16 if width == 2 else np.uint32)

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 start, and where the last of them ends."""
        if j < self.n:
            return self.boundaries.select_run(i, j + 1)
        return np.append(self.boundaries.select_run(i, j), self.total)

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """Ids of documents i to j - 1, null for the first ``n_null``."""
        a, z = max(0, i - self.n_null), max(0, j - self.n_null)
        got = (self.far.select_run(a, z).astype(np.uint64) + np.uint64(self.first % (1 << 64))).astype(np.int64) if z > a else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(j - i - len(got), pa.int64()), pa.array(got)])

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.bounds(i, i + 1)
        return self.ids[start:end]


class _Writer:
    """Files of one task."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        self.doc_ids, self.sizes, self.ids, self.bytes, self.seq = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes, end: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append((len(ids) + len(end)) // self.width)
        self.ids += (ids, end)
        self.bytes += len(ids) + len(end)

    def close(self) -> pa.RecordBatch:
        """Write what is held to a new file; its row of the manifest."""
        where, at = fs.FileSystem.from_uri(self.path)
        where.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.lwtok"
        n_null = sum(x is None for x in self.doc_ids)
        with where.open_output_stream(f"{at}/{name}") as out:
            dump(out, np.array(self.doc_ids[n_null:], np.int64), n_null, np.array(self.sizes), self.ids, self.width)
        row = {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "seq": pa.array([self.seq], pa.int32()), "file": [name], "n_docs": [len(self.sizes)], "n_tokens": [int(sum(self.sizes))]}
        self.doc_ids, self.sizes, self.ids, self.bytes, self.seq = [], [], [], 0, self.seq + 1
        return pa.RecordBatch.from_pydict(row)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Encode and write all documents below ``path``; the committed manifest: file, n_docs, n_tokens and start (tokens of all files before it)."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # equal ids, or many null ones, need not be one task's
    dealt = given.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        out = _Writer(path, enc.width)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                out.add(doc_id, ids, end)
                if out.bytes > FILE_BYTES or len(out.sizes) >= FILE_DOCS:
                    yield out.close()
        if out.sizes:
            yield out.close()

    made = materialize(dealt.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"), "tokens")
    start, out = 0, []
    for r in made.orderBy("part", "seq").collect():  # one row a file
        out.append((f"{path}/{r['file']}", r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(out, "file string, n_docs long, n_tokens long, start long")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and the ids' crc32, from the files."""

    def run(batches):
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                where, at = fs.FileSystem.from_uri(file)
                with where.open_input_file(at) as f:
                    t = TokenFile(f.read_buffer())
                for i in range(0, t.n, RUN):
                    j = min(i + RUN, t.n)
                    bounds = t.bounds(i, j)
                    crc = [zlib.crc32(t.ids[a:z].astype("<u4").tobytes()) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([t.doc_ids(i, j), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_path, fresh_path(spark, "token-files"), end_id))

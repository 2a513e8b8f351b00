"""Byte-level BPE by dynamic programming over prefixes, and decoding.

Of every prefix of a piece exactly one token can be the last of its encoding: the one that is a suffix of the prefix and
whose seam with the last token of the rest no merge would cross. Those last tokens are the table that is kept: reading it
backwards gives the ids, a longer piece only adds entries (appends; sorted pieces share those of their common prefixes), and after an edit the entries before it stay and those
after it are taken over once a longest token's run of them is the same again (``relabel``, ``Encoded``).

Whether a merge crosses the seam of two tokens is found by undoing their merges from the last one on, along the two edges
that meet there. That needs ranks that rise with every merge and reach every token, which is checked for each token when it
is first taken apart.

The pattern's matches (pieces) are encoded separately. Its character classes are those of the tiktoken library, which are
asked for once a process: characters that the regex module classes otherwise are replaced by a stand-in of the same class
while a text is split. A text is first cut before single spaces, where the pattern never joins, and each distinct chunk is
encoded once and remembered: in two tables, of which the older goes when the younger is full, and what is met again moves
to the younger. Texts are never cut short.

Null and empty texts have no ids and decode to no bytes. A null id stays null, ids may be of any type, repeated rows are
encoded alike, an empty table stays empty; a kept column with the name of a result is left out.
"""

from __future__ import annotations

import base64
import re
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_columns

#: Chunks, pieces and pairs of tokens that a table of a worker's memory holds.
REMEMBERED = 400_000
#: A space between white space (or the end) and white space: no place to cut.
_UNSAFE = re.compile(r"\s (?!\S)")
_CUTS = regex.compile(r"(?<!\s) | (?=\S)")
_NEVER = 1 << 62
_INT = struct.Struct("<i").pack


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.longest = max(map(len, ranks), default=1)
        #: The longest token that ends in two bytes: no longer one needs a look.
        self._ends: dict[bytes, int] = {}
        for t in ranks:
            self._ends[t[-2:]] = max(self._ends.get(t[-2:], 1), len(t))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._seams: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A file of lines of a token in base64 and its rank, from any file system that Arrow reads."""
        where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with where.open_input_stream(at) as f:
            rows = [line.split() for line in f.read().splitlines() if line]
        return cls({base64.b64decode(a): int(b) for a, b in rows})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a single byte."""
        if token not in self._halves:
            parts, ranks = [bytes([b]) for b in self.tokens[token]], self.ranks
            while len(parts) > 2:
                _, i = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = tuple(ranks.get(p, _NEVER) for p in parts)
            if len(got) == 2 and max(got) >= token:
                raise ValueError(f"token {token} is not reached by merges of lower rank")
            self._halves[token] = got if len(got) == 2 else None
        return self._halves[token]

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' bytes is those two tokens.

        Of equal ranks the leftmost pair merges first: before one across the seam if it lies left of it, after it if right."""
        pair = left << 32 | right
        known = self._seams.get(pair)
        if known is not None:
            return known
        if len(self._seams) > REMEMBERED:
            self._seams.clear()
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        left_goes = right_goes = _NEVER  # ranks of the merges that take these tokens away from the seam
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < left_goes and across <= right_goes:
                out = False
                break
            a, b = halves(left), halves(right)
            if a and (not b or left > right):
                left_goes, left = left, a[1]
            elif b:
                right_goes, right = right, b[0]
            else:
                out = True
                break
        self._seams[pair] = out
        return out

    def last_token(self, piece: bytes, i: int, last: list[int]) -> int:
        """The last token of the prefix of ``i`` bytes, given those of all shorter prefixes."""
        ranks, seams = self.ranks, self._seams
        for size in range(i if i < 8 else min(i, self._ends.get(piece[i - 2 : i], 1)), 0, -1):
            t = ranks.get(piece[i - size : i])
            if t is None:
                continue
            if size == i:
                return t
            before = last[i - size]
            holds = seams.get(before << 32 | t)
            if holds or (holds is None and self.seam_holds(before, t)):
                return t
        raise ValueError(f"no token for byte {piece[i - 1]}")

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Append the last tokens of the prefixes that the table ``last`` of a shorter prefix lacks."""
        last_token, add = self.last_token, last.append
        for i in range(len(last), len(piece) + 1):
            add(last_token(piece, i, last))
        return last

    def prefix_table(self, piece: bytes) -> list[int]:
        """Last tokens of all prefixes; entry 0 stands for the empty one."""
        return self.extend(piece, [-1])

    def encode_all(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Every piece and its ids. Sorted neighbours share a prefix, whose entries serve both."""
        before, last = b"", [-1]
        for piece in sorted(pieces):
            same = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            before = piece
            yield piece, self.ids(self.extend(piece, last))

    def relabel(self, piece: bytes, old: bytes, old_last: list[int]) -> list[int]:
        """The table of ``piece`` from that of ``old``: only entries near what differs are computed."""
        n, shift = len(piece), len(old) - len(piece)
        head = next((i for i, (a, b) in enumerate(zip(piece, old)) if a != b), min(n, len(old)))
        most = min(n, len(old)) - head
        tail = next((i for i in range(most) if piece[n - 1 - i] != old[len(old) - 1 - i]), most)
        last, same = old_last[: head + 1], 0
        for i in range(head + 1, n + 1):
            if same >= self.longest and i - self.longest >= n - tail:
                return last + old_last[i + shift :]
            last.append(self.last_token(piece, i, last))
            same = same + 1 if i >= n - tail and last[i] == old_last[i + shift] else 0
        return last

    def ids(self, last: list[int]) -> list[int]:
        """The encoding, read off a table from its end."""
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Splitter:
    """The pattern's matches with the library's character classes."""

    def __init__(self, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        stands: dict[int, str] = {}
        for kind, stand in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"[^\s\p{L}\p{N}]", "!"), (r"\s", "\n")):
            asked = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            theirs = set(bytes(asked.encode_ordinary(every)).decode())
            stands |= {ord(c): stand for c in theirs.difference(regex.findall(kind, every))}
        self.stands = stands
        self.first_stand = chr(min(stands)) if stands else None

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.pattern.finditer(self.classed(text), start))

    def classed(self, text: str) -> str:
        """The text with stand-ins; itself where there are none."""
        if text.isascii() or not self.first_stand or max(text) < self.first_stand or self.stands.keys().isdisjoint(map(ord, text)):
            return text
        return text.translate(self.stands)

    def pieces(self, text: str) -> list[str]:
        same = self.classed(text)
        return self.pattern.findall(text) if same is text else [text[a:b] for a, b in self.spans(text)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


class Memory(dict):
    """What was computed of late: ``self`` and the table before it."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def turn(self) -> None:
        """Begin a new table if this one is full."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()

    def recall(self, key):
        """The value of a key that ``self`` lacks, from the older table; None if it is new."""
        got = self.older.get(key)
        if got is not None:
            self[key] = got
        return got


class Encoder:
    """Ids of whole texts, with a memory of chunks and pieces."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.splitter = vocabulary(path), splitter(pattern)
        self.heads, self.known, self.of_piece = Memory(), Memory(), Memory()

    def _learn(self, memory: Memory, chunks: list[str], space: str) -> None:
        """Encode chunks, each after ``space``: first the pieces that are new, then what the chunks put together."""
        of_piece, ranks = self.of_piece, self.vocabulary.ranks
        parts = [self.splitter.pieces(space + c) for c in chunks]
        fresh = {}
        for piece in set(chain.from_iterable(parts)).difference(of_piece):
            if of_piece.recall(piece) is None:
                raw = piece.encode()
                whole = ranks.get(raw)
                if whole is None:
                    fresh[raw] = piece
                else:
                    of_piece[piece] = _INT(whole)
        for raw, ids in self.vocabulary.encode_all(fresh):
            of_piece[fresh[raw]] = struct.pack(f"<{len(ids)}i", *ids)
        memory.update((c, b"".join(map(of_piece.__getitem__, p))) for c, p in zip(chunks, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32."""
        for memory in (self.heads, self.known, self.of_piece):
            memory.turn()
        heads, rests = [], []
        for t in texts:
            if _UNSAFE.search(t):
                cuts = [m.start() for m in _CUTS.finditer(t)]
                heads.append(t[: cuts[0]] if cuts else t)
                rests.append([t[a + 1 : z] for a, z in zip(cuts, [*cuts[1:], len(t)])])
            else:
                head, *rest = t.split(" ")
                heads.append(head)
                rests.append(rest)
        for memory, met, space in ((self.heads, set(heads), ""), (self.known, set(chain.from_iterable(rests)), " ")):
            self._learn(memory, [c for c in met.difference(memory) if memory.recall(c) is None], space)
        first, known = self.heads, self.known.__getitem__
        return [first[h] + b"".join(map(known, r)) for h, r in zip(heads, rests)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The worker process's own encoder: what it remembers serves all its tasks."""
    return Encoder(path, pattern)


class Encoded:
    """A text with its pieces' tables, to be appended to and edited."""

    #: Pieces before an edit whose match may have looked at it.
    _BACK = 3

    def __init__(self, path: str, pattern: str, text: str = ""):
        self.vocabulary, self.splitter = vocabulary(path), splitter(pattern)
        self.text, self.starts, self.tables = "", [], []
        self.append(text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, i: int, j: int, text: str) -> int:
        """Put ``text`` in the place of characters i to j - 1; the number of pieces that were split anew."""
        old, starts, tables, v = self.text, self.starts, self.tables, self.vocabulary
        new, grown, edited = old[:i] + text + old[j:], len(text) - (j - i), i + len(text)
        k = max(0, bisect_right(starts, max(0, i - 1)) - self._BACK)
        places = {s: n for n, s in enumerate(starts) if s >= j}
        fresh_starts, fresh, stop = [], [], len(starts)
        for a, b in self.splitter.spans(new, starts[k] if k < len(starts) else 0):
            if a >= edited and a - grown in places:
                stop = places[a - grown]
                break
            piece, n = new[a:b].encode(), k + len(fresh)
            if n < len(starts):
                end = starts[n + 1] if n + 1 < len(starts) else len(old)
                fresh.append(v.relabel(piece, old[starts[n] : end].encode(), tables[n]))
            else:
                fresh.append(v.prefix_table(piece))
            fresh_starts.append(a)
        self.text = new
        self.starts = starts[:k] + fresh_starts + [s + grown for s in starts[stop:]]
        self.tables = tables[:k] + fresh + tables[stop:]
        return len(fresh)

    def ids(self) -> list[int]:
        return [t for last in self.tables for t in self.vocabulary.ids(last)]


def _field(docs: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)


def _lists(encoded: list[bytes]) -> pa.ListArray:
    """Ids as int32 of several texts as a column."""
    ends = np.cumsum([0, *(len(g) // 4 for g in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))]))


def _mapped(docs: DataFrame, path: str, pattern: str, columns: list[str], both: bool) -> DataFrame:
    given = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    names = [*columns, "ids", "decoded"] if both else [*columns, "ids"]

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            ids = _lists(enc.encode(b.column("_text").to_pylist()))
            made = [ids, _decoded(ids, enc.vocabulary)] if both else [ids]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made], names)

    return given.mapInArrow(run, _field(docs, columns) + "ids array<int>" + (", decoded binary" if both else ""))


def _decoded(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    out = [v.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in ids]
    return pa.array(out, pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id) and ``ids``, an array of int, of each text."""
    return _mapped(docs, path, pattern, kept_columns(docs, columns, ("ids",)), both=False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the bytes of ``ids``. A null array has no bytes."""
    columns = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), _decoded(b.column("ids"), v)], [*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, _field(encoded, columns) + "decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id), ``ids`` and ``decoded``, the bytes that the ids give back, in one pass."""
    return _mapped(docs, path, pattern, kept_columns(docs, columns, ("ids", "decoded")), both=True)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id), n_tokens and digests of the ids and of what they decode to."""
    columns = kept_columns(docs, columns, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    both = round_trip(docs, path, pattern, columns)
    return both.select(*columns, F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased with white-space runs as one space. An item of m characters has an error budget of
``m // BUDGET_STEP`` edits and is split into one piece more than that: wherever at most that many edits part it from a
passage, one piece stands there unchanged. An Aho-Corasick automaton of all pieces reads each whole text once; around every
hit the windows in which the item could lie are merged, and Myers's bit-parallel distance finds the item's least edit
distance to any passage there. Within the budget the document holds the item. By the pigeonhole principle nothing within
the budget is missed.

Items lie in files, in blocks of about ``BLOCK_CHARS`` characters and one item, which the tasks read themselves, one pass of
the documents for each block; neither items nor pieces pass through the driver. Null, empty and blank items match nothing; null and empty texts hold nothing; null ids are
reported as null, ids may be of any type; repeated rows are reported each; of places with the least distance the first end counts.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkweir.operators.ranking import running_totals

from .common import fresh_path

#: Characters of an item for each edit of its budget.
BUDGET_STEP = 12
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern_bits: dict[str, int], m: int, text: str, start: int, end: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any passage of text[start:end], and the first end where it is reached."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, now = mask, 0, m
    best, where = m, start
    get = pattern_bits.get
    for i in range(start, end):
        eq = get(text[i], 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = vp & d0
        if hp & top:
            now += 1
        elif hn & top:
            now -= 1
        hp = (hp << 1) & mask  # a passage may begin anywhere: no cost enters from above
        hn = (hn << 1) & mask
        vp = hn | (mask & ~(d0 | hp))
        vn = hp & d0
        if now < best:
            best, where = now, i + 1
    return best, where


class Matcher:
    """The pieces of some items in one automaton."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], step: int):
        import ahocorasick

        self.items = [(i, normal(t)) for i, t in items]
        self.budget = [len(t) // step for _, t in self.items]
        self.bits: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            n = self.budget[k] + 1
            for j in range(n) if text else ():
                a, z = j * len(text) // n, (j + 1) * len(text) // n
                pieces.setdefault(text[a:z], []).append((k, z))
        self.auto = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.auto.add_word(p, places)
        if pieces:
            self.auto.make_automaton()
        self.empty = not pieces

    def _distance(self, k: int, text: str, start: int, end: int) -> tuple[int, int]:
        item = self.items[k][1]
        if (at := text.find(item, start, end)) >= 0:
            return 0, at + len(item)
        if k not in self.bits:
            bits: dict[str, int] = {}
            for i, ch in enumerate(item):
                bits[ch] = bits.get(ch, 0) | 1 << i
            self.bits[k] = bits
        return myers(self.bits[k], len(item), text, start, end)

    def find(self, text: str | None, first_only: bool = False) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, budget, end in the normal text) of every item within its budget."""
        text = normal(text)
        if self.empty or not text:
            return []
        windows: dict[int, list[int]] = {}
        for last, places in self.auto.iter(text):
            for k, z in places:
                windows.setdefault(k, []).append(last + 1 - z)  # where the item would begin without edits
        found = []
        for k, starts in sorted(windows.items()):
            m, b = len(self.items[k][1]), self.budget[k]
            best, where = m, 0
            starts.sort()
            lo, hi = starts[0] - b, starts[0] + m + b
            for s in [*starts[1:], None]:
                if s is not None and s - b <= hi:
                    hi = max(hi, s + m + b)
                    continue
                d, e = self._distance(k, text, max(0, lo), min(len(text), hi))
                if d < best:
                    best, where = d, e
                if s is not None:
                    lo, hi = s - b, s + m + b
            if best <= b:
                found.append((self.items[k][0], best, b, where))
                if first_only:
                    break
        return found


@lru_cache(maxsize=2)
def matcher(path: str, step: int) -> Matcher:
    """The worker process's own matcher of a block of items, read from the block's files."""
    where, at = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))
    rows = [r for f in files for r in pq.read_table(f, filesystem=where, columns=["item_id", "text"], partitioning=None).to_pylist()]
    return Matcher(tuple((r["item_id"], r["text"]) for r in rows), step)


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> list[str]:
    """Folders of the items in blocks of about ``chars`` characters, written by the tasks that hold them.

    Blocks come from a running total of the items' lengths, so only how many there are comes to the driver."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.length("text").cast("long").alias("_n"), F.xxhash64("text").alias("_h"))
    totals = running_totals(items, ["item_id", "_h"], "_n", "_through")
    placed = totals.select("item_id", "text", F.floor((F.col("_through") - F.col("_n")) / chars).alias("block"))
    path = fresh_path(benchmark.sparkSession, "benchmark")
    placed.repartition("block").write.partitionBy("block").parquet(path)
    found = benchmark.sparkSession.read.schema("block long").parquet(path).select("block").distinct().collect()
    return [f"{path}/block={r['block']}" for r in sorted(found)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, step: int = BUDGET_STEP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget and end of every item that a document holds within the item's budget."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int, budget int, end long"
    out, item_type = docs.sparkSession.createDataFrame([], schema), to_arrow_type(benchmark.schema["item_id"].dataType)
    for block in blocks(benchmark, block_chars):

        def run(batches, block=block):
            m = matcher(block, step)
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[i], *hit) for i, t in enumerate(b.column("text").to_pylist()) for hit in m.find(t)]
                cols = list(zip(*rows)) or [[]] * 5
                kinds = (b.schema.field("doc_id").type, item_type, pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "budget", "end"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def remove_leaking(docs: DataFrame, benchmark: DataFrame, step: int = BUDGET_STEP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item within its budget."""
    out = docs
    for block in blocks(benchmark, block_chars):

        def run(batches, block=block):
            m = matcher(block, step)
            for b in batches:
                yield b.filter(pa.array([not m.find(t, first_only=True) for t in b.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out

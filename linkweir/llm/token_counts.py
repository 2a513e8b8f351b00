"""Token counts of a sentencepiece BPE model by heap-and-linked-list merging, without emitting ids.

A text becomes code points with every space as U+2581 and one such prefix; its symbols form a linked list, and a heap
holds the adjacent pairs that join to a piece of the vocabulary. Popping the best-scored pair (leftmost on ties) until none
is left, the count is the initial symbols minus the merges, plus the further bytes of symbols that fall back to bytes. No
vocabulary piece has U+2581 after another character (checked when the model is read; else a text is one unit), so merges
never cross the start of a run of U+2581: the text is cut there and each distinct unit is merged once and remembered, in a
table that is emptied when it is full. Texts are never cut short.

Null and empty texts have 0 tokens; a null id stays null, ids may be of any type; repeated rows are counted alike; a kept
column with the name of a result is left out.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns

SPACE = "▁"
#: Units that a worker remembers before it starts anew.
REMEMBERED = 800_000


class MergeCounter:
    """Counts tokens as the model file's library would."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        self.bytes_known = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.cuts = not any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:]))
        self.known: dict[str, int] = {}

    def merge_count(self, unit: str) -> int:
        """Tokens of one unit: symbols minus merges, plus the bytes beyond one of each symbol outside the vocabulary."""
        rank, symbols = self.rank.get, list(unit)
        n = len(symbols)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank(a + b)) is not None]
        count = n
        if heap:
            heapify(heap)
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            symbols.append("")  # stands after the last and joins to nothing
            while heap:
                _, i, a, b = heappop(heap)
                j = right[i]
                if symbols[i] is not a or symbols[j] is not b:
                    continue  # one of the two has been merged meanwhile
                symbols[i] = s = a + b
                symbols[j] = None
                right[i] = k = right[j]
                count -= 1
                if k < n:
                    left[k] = i
                    if (r := rank(s + symbols[k])) is not None:
                        heappush(heap, (r, i, s, symbols[k]))
                if (h := left[i]) >= 0 and (r := rank(symbols[h] + s)) is not None:
                    heappush(heap, (r, h, symbols[h], s))
            symbols.pop()
        if self.bytes_known and not unit.isascii():
            count += sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in symbols if s is not None and s not in self.rank)
        return count

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Units after one space are looked up under their bare text."""
        if not self.cuts:
            return [self.merge_count(SPACE + t.replace(" ", SPACE)) if t else 0 for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts, extra = [], []
        for t in texts:
            if SPACE in t:
                t = t.replace(SPACE, " ")
            units = t.split(" ") if t else []
            more = 0
            if "" in units:  # runs of spaces: the run belongs to the unit after it
                plain, spaces = [], 0
                for u in units:
                    spaces += 1
                    if u:
                        if spaces == 1:
                            plain.append(u)
                        else:
                            more += self.merge_count(SPACE * spaces + u)
                        spaces = 0
                more += self.merge_count(SPACE * spaces) if spaces else 0
                units = plain
            parts.append(units)
            extra.append(more)
        known, merge = self.known, self.merge_count
        for u in set(chain.from_iterable(parts)).difference(known):
            known[u] = merge(SPACE + u)
        return [sum(map(known.__getitem__, units)) + more for units, more in zip(parts, extra)]


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> MergeCounter:
    """The worker process's own counter: what it remembers serves all its tasks."""
    return MergeCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id) with n_bytes, n_tokens and over_limit (n_tokens over ``limit``)."""
    columns = kept_columns(docs, columns, ("n_bytes", "n_tokens", "over_limit"))
    given = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("_text"))

    def run(batches):
        counter = counter_of(model_path)
        for b in batches:
            texts = b.column("_text").to_pylist()
            out = [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counter.count_all(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *out], [*columns, "n_bytes", "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_bytes long, n_tokens long"
    return given.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)

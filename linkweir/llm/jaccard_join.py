"""N-gram Jaccard join in the metric space of the Jaccard distance: neighbourhoods, Voronoi regions, triangle-inequality windows.

A document's set holds the 64-bit hashes of its word shingles. Equal sets are one class from the start, told by 128 bits of
the set and named by 64 of them, or by a name of its own where two sets share those. Two classes are linked if their distance is eps at most.

* **Neighbourhoods.** Most documents are at distance 1 from nearly all others, so pivots drawn from the whole space would part
  nothing. A prefix holds the first n - ceil(t*n) + 1 shingles of a set in one fixed order of all shingles, so two linked
  sets share a shingle of their prefixes. The class with the least name among those with a shingle in their prefix is the
  pivot of its neighbourhood; linked classes meet in one. Any order gives the same result; this one makes neighbourhoods few:
  first the shingles of a hash-chosen share that stand in one class only (counted exactly; they meet nothing, so a class
  whose prefix they fill is done), then those outside that share, of which those frequent in a bounded sample of texts come
  last, then the rest.
* **Odd sketches.** Every open class has the parities of its shingles' hash places. The Hamming distance of two sketches is
  at most the size of the symmetric difference, so a pair whose sketches are too far apart is not linked. A class without a
  possible partner in a neighbourhood leaves it, before any set is sent. Sizes are windows here: linked sets differ by the
  factor t at most, so classes are compared in rings of that width, each with the ring below. Rings beyond one task's bound
  are not compared before their members have met pivots.
* **Voronoi regions and windows.** Every region takes pivots among its members. Every member goes to the region of its
  nearest pivot, and, by the triangle inequality, also to each region whose pivot is at most 2 * eps farther (the boundary
  documents); members at distance 1 - eps or more from all pivots form a region of the rest, to which those beyond 1 - 2 * eps
  are copied. Linked members thus meet in a region. Members within eps of a pivot are linked to it, and need no test with
  one another; of these, those farther than eps below the nearest member that is not linked are left out of the region.
* **Recursion.** A region joins in the same way around pivots of its own, until its members are one component or none is
  left. A pivot has met all members and leaves; where a region does not come apart, the next pivots are taken from those that
  are not yet in its largest component. So every distance that is computed is one to a pivot. Neighbourhoods and regions
  beyond one task's bound are parted by Spark, level by level; one that does not come apart is cut into pairs of blocks for
  several tasks, each of which joins its block around pivots.

The result is exact: components of the graph of all linked pairs. A null id has a set but no links (component null); repeated
ids are one node with the links of all their rows; null and blank texts have an empty set, linked with nothing. Ties between
pivots are broken by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, words_of, written
from .graph import components

#: Documents of the sample that tells frequent shingles, and most of those shingles. Both only shape the order of shingles.
SAMPLE_DOCS, MAX_FREQUENT, LEAST_SEEN = 4000, 1 << 18, 4
#: Members of a region, and their shingles, that one task joins.
BLOCK, BLOCK_ITEMS = 2000, 1 << 21
#: Pivots of a region that Spark parts, the most levels of such regions, and how far replication may swell one.
PIVOTS, LEVELS, GROWTH = 16, 4, 3
BITMAP_BITS = 1 << 24
#: Classes for each task of the narrow tables, beyond the first eight tasks.
CLASSES_OF_TASK = 10_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, memory: dict) -> np.ndarray:
    """Sorted distinct hashes (as signed 64-bit integers) of the k-word shingles; of all words if they are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    size = min(k, len(ids))
    with np.errstate(over="ignore"):
        h = np.full(len(ids) - size + 1, size, np.uint64)
        for j in range(size):
            h = (h ^ (ids[j : len(ids) - size + 1 + j] * _A)) * _B
            h ^= h >> np.uint64(29)
        h *= _C
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def _needed(n, num: int, den: int):
    """Least intersection of a set of n with any set within the threshold."""
    return -(-num * n // den)


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted shingles that stand in at least LEAST_SEEN texts of the sample."""
    total = docs.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003 < min(1.0, SAMPLE_DOCS / max(total, 1))

    def run(batches):
        memory = _WordHashes()
        for b in batches:
            for t in b.column("text").to_pylist():
                s = shingle_set(t, k, memory)
                for i in range(0, len(s), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(s[i : i + (1 << 16)])], ["h"])

    seen = docs.where(part).select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= LEAST_SEEN)
    return np.sort(np.array([r["h"] for r in seen.orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).collect()], np.int64))


def _name(items: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return _signed(xxhash.xxh3_64_intdigest(items.tobytes()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _check(items: np.ndarray) -> int:
    """Another 64 bits, which tell sets of one name apart."""
    return _signed(xxhash.xxh64_intdigest(items.tobytes(), 0x5EED))


def _renamed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Names for sets whose name is also another's, by name and check; some n * n / 2**65 sets of n, so they go to the driver."""
    twice = rows.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("z")).where("a != z").select("key")
    both = rows.join(F.broadcast(twice), "key", "left_semi").select("key", "check").distinct().collect()
    return {(r["key"], r["check"]): _signed(xxhash.xxh3_64_intdigest(f"{r['key']} {r['check']}")) for r in both}


def _chosen(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which shingles are of the share that is counted: half as many again as a prefix holds."""
    return (items & 0xFFFF) < int(65536 * min(0.5, 1.5 * (1 - num / den)))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _named_rows(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, str]:
    """doc_id, n, key, check and the counted shingles of every row."""

    def run(batches):
        memory = _WordHashes()
        for b in batches:
            sets = [shingle_set(t, k, memory) for t in b.column("text").to_pylist()]
            counted = _lists([x[_chosen(x, num, den)] for x in sets])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_name(x) for x in sets], pa.int64()), pa.array([_check(x) for x in sets], pa.int64()), counted], ["doc_id", "n", "key", "check", "counted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, key long, check long, counted array<long>"), "named-rows")


def odd_sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles at each of 2**b places, as bytes; at least 256 places and as many as shingles."""
    size = 1 << max(8, (max(1, len(items)) - 1).bit_length())
    place = (items.view(np.uint64) >> np.uint64(24)) & np.uint64(size - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little")


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) of fewer places, which equal those made with so many from the start."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def possible(sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """Which sets may have a linked partner among the others, by sizes and sketches."""
    out = np.zeros(len(sizes), bool)
    widths = np.array([len(s) for s in sketches])
    groups = {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        at = at[np.argsort(sizes[at], kind="stable")]
        groups[w] = at, np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), w)
    for w, (a, sa) in groups.items():
        for v, (b, sb) in groups.items():
            if v < w or sizes[a[-1]] * den < sizes[b[0]] * num:
                continue
            left, right = sa.view(np.uint64), np.ascontiguousarray(fold(sb, w)).view(np.uint64)
            step = max(1, (1 << 22) // max(1, left.shape[1] * len(b)))
            for i in range(0, len(a), step):
                mine = sizes[a[i : i + step]]
                z = np.searchsorted(sizes[b], mine[-1] * den // num, "right")
                y = np.searchsorted(sizes[b], -(-mine[0] * num // den))
                if y == z:
                    continue
                both = mine[:, None] + sizes[b[y:z]][None, :]
                apart = np.bitwise_count(left[i : i + step, None, :] ^ right[None, y:z, :]).sum(2, dtype=np.int64)
                hit = apart * (num + den) <= both * (den - num)
                if v == w:
                    row, col = np.arange(i, min(i + step, len(a))), np.arange(y, z)
                    hit &= row[:, None] != col[None, :]
                out[a[i : i + step][hit.any(1)]] = True
                out[b[y:z][hit.any(0)]] = True
    return out


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of fixed size that has the hash of every value: at most BITMAP_BITS / 64 rows come to the driver."""
    place = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    rows = ids.select((place / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({column}), {BITMAP_BITS}L), 64L) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    words = np.zeros(BITMAP_BITS // 64, np.int64)
    words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _sets(docs: DataFrame, wanted: DataFrame, k: int, num: int, den: int, frequent: np.ndarray, renamed: dict[tuple[int, int], int]) -> tuple[DataFrame, str]:
    """key, items, sketch and prefix (beyond the counted shingles) of the wanted classes (key, doc_id), computed anew from texts.

    ``rare`` is how many shingles of the prefix are not counted ones. Bitmaps pick the rows, so some classes come unasked
    and a class may come more than once."""
    bits = _bitmap(wanted, "doc_id")

    def run(batches):
        memory, seen = _WordHashes(), set()
        for b in batches:
            take = np.flatnonzero(bits[b.column("place").to_numpy()])
            texts = b.column("text").take(pa.array(take)).to_pylist()
            for start in range(0, len(texts), 200):
                keys, sets, sketches, prefixes, rare = [], [], [], [], []
                for t in texts[start : start + 200]:
                    x = shingle_set(t, k, memory)
                    if not len(x):
                        continue
                    key = _name(x)
                    if renamed:
                        key = renamed.get((key, _check(x)), key)
                    if key in seen:
                        continue
                    seen.add(key)
                    size = len(x) - _needed(len(x), num, den) + 1
                    counted = _chosen(x, num, den)
                    rest = x[~counted]
                    if len(frequent):
                        common = frequent[np.minimum(np.searchsorted(frequent, rest), len(frequent) - 1)] == rest
                        rest = np.concatenate([rest[~common][:size], rest[common][:size]])
                    rest = rest[:size]
                    keys.append(key)
                    sets.append(x)
                    sketches.append(odd_sketch(x).tobytes())
                    rare.append(len(rest))
                    prefixes.append(rest if len(rest) == size else np.concatenate([rest, x[counted]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(sets), pa.array(sketches, pa.binary()), _lists(prefixes), pa.array(rare, pa.int32())], ["key", "items", "sketch", "prefix", "rare"])

    given = docs.where(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).cast("long").alias("place"), "text")
    return written(given.mapInArrow(run, "key long, items array<long>, sketch binary, prefix array<long>, rare int"), "sets")


def shared_with(centers: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set (row) with every center (column)."""
    items = np.concatenate(centers)
    column = np.repeat(np.arange(len(centers)), [len(c) for c in centers])
    order = np.argsort(items, kind="stable")
    items, column = items[order], column[order]
    given = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    a, z = np.searchsorted(items, given, "left"), np.searchsorted(items, given, "right")
    hit = z > a
    a, n, row = a[hit], (z - a)[hit], row[hit]
    idx = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]])[: len(n)], n)
    return np.bincount(np.repeat(row, n) * len(centers) + column[idx], minlength=len(sets) * len(centers)).reshape(len(sets), len(centers))


def voronoi(sizes: np.ndarray, center_sizes: np.ndarray, inter: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every member and pivot: whether they are linked, their distance, and whether the member is in the pivot's region.

    The last column of the regions is that of the rest."""
    union = sizes[:, None] + center_sizes[None, :] - inter
    linked = den * inter >= num * union
    eps = 1 - num / den + 1e-6
    d = 1 - inter / union
    home = d.min(1)
    inside = (d <= home[:, None] + 2 * eps) & (inter > 0)
    inside[home >= 1 - eps] = False  # their partners are in the rest as well
    return linked, d, np.concatenate([inside, (home >= 1 - 2 * eps)[:, None]], 1)


def in_window(d: np.ndarray, linked: np.ndarray, num: int, den: int) -> np.ndarray:
    """Members of a pivot's region that may be linked to one of its members that is not linked to the pivot."""
    eps = 1 - num / den + 1e-6
    return ~linked | (d >= d[~linked].min(initial=np.inf) - eps)


def join_region(sets: list[np.ndarray], done: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Linked pairs that, with those implied between ``done`` members, give the components of a region.

    ``done`` marks members known to be linked with one another. Of the pairs found only those that join two components are
    returned, so there are fewer than members. Every pair that is tested is one of a pivot and a member of its region: pivots
    leave the region once their distances are known, and where the regions do not come apart the others take their place."""
    sizes = np.array([len(s) for s in sets])
    found: list[tuple[int, int]] = []
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((i, j))

    same = np.flatnonzero(done).tolist()
    for i in same[1:]:
        root[i] = same[0]

    def recurse(idx: np.ndarray) -> None:
        while len(idx) > 1:
            roots = np.array([find(i) for i in idx.tolist()])
            kinds, n = np.unique(roots, return_counts=True)
            if len(kinds) < 2:
                return
            # pivots outside the largest component: when none is left there, all distances that matter are known
            outside = idx[roots != kinds[n.argmax()]]
            pivots = outside[np.linspace(0, len(outside) - 1, max(1, min(PIVOTS, int(len(outside) ** 0.5)))).astype(int)]
            linked, d, inside = voronoi(sizes[idx], sizes[pivots], shared_with([sets[i] for i in pivots], [sets[i] for i in idx]), num, den)
            for j, p in enumerate(pivots.tolist()):
                for i in idx[linked[:, j]].tolist():
                    link(p, i)
            rest = ~np.isin(idx, pivots)  # a pivot has met every member of its region
            idx, linked, d, inside = idx[rest], linked[rest], d[rest], inside[rest]
            parts = []
            for j in range(inside.shape[1]):
                here = inside[:, j].copy()
                if j < len(pivots) and here.any():
                    here[here] = in_window(d[here, j], linked[here, j], num, den)
                parts.append(idx[here])
            if 2 * sum(len(x) ** 2 for x in parts) <= len(idx) ** 2:  # less than half of the pairs are left
                for x in parts:
                    recurse(x)
                return

    recurse(np.arange(len(sets)))
    return found


def _runs(batches, *names: str):
    """Tables of the rows with equal values in ``names``, which stand together."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        where = np.zeros(b.num_rows, bool)
        for n in names:
            v = b.column(n).to_numpy()
            where[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(where).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            part = b.slice(a, z - a)
            if held and any(held[-1].column(n)[0] != part.column(n)[0] for n in names):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _by_runs(rows: DataFrame, names: list[str], run, schema: str) -> DataFrame:
    """``run`` on every group of rows with equal values in ``names``; a task sorts its groups and holds one at a time."""

    def each(batches):
        for table in _runs(batches, *names):
            out = run(table)
            if out is not None and out.num_rows:
                yield out

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(each, schema)


def _item_lists(table: pa.Table) -> list[np.ndarray]:
    items = table.column("items").combine_chunks()
    flat, at = items.values.to_numpy(), items.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(at[:-1], at[1:])]


def _join_block(table: pa.Table, num: int, den: int) -> pa.RecordBatch:
    keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    pairs = join_region(_item_lists(table), table.column("absorbed").to_numpy(), num, den)
    a, b = (np.array([keys[p[side]] for p in pairs], np.int64) for side in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _part_block(table: pa.Table, num: int, den: int) -> pa.RecordBatch | None:
    """Voronoi step of a block of members of a region: rows of the new regions, and links to pivots (whose cell is null)."""
    is_pivot = table.column("is_pivot").to_numpy()
    keys, sets, parent = table.column("key").to_numpy(), _item_lists(table), table.column("cell")[0].as_py()
    center, member = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
    if not len(member):
        return None
    sizes = np.array([len(s) for s in sets])
    linked, d, inside = voronoi(sizes[member], sizes[center], shared_with([sets[i] for i in center], [sets[i] for i in member]), num, den)
    names = np.array([_name(np.array([parent, j], np.int64)) for j in (*keys[center].tolist(), 0)])  # the last is the rest
    d, absorbed = np.pad(d, ((0, 0), (0, 1)), constant_values=1.0), np.pad(linked, ((0, 0), (0, 1)))
    (row, col), (r, c) = np.nonzero(inside), np.nonzero(linked)
    region = pa.Table.from_pydict({"cell": names[col], "key": keys[member[row]], "n": sizes[member[row]], "absorbed": absorbed[row, col], "d": d[row, col], "pivot": pa.nulls(len(row), pa.int64())})
    links = pa.Table.from_pydict({"cell": pa.nulls(len(r), pa.int64()), "key": keys[member[r]], "n": sizes[member[r]], "absorbed": np.ones(len(r), bool), "d": d[r, c], "pivot": keys[center[c]]})
    both = pa.concat_tables([region, links])
    return both.add_column(0, "parent", pa.array(np.full(len(both), parent))).combine_chunks().to_batches()[0] if len(both) else None


def _neighbourhoods(tokens: DataFrame, sketches: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """cell (a pivot's name), key and n of the members that sketches do not rule out."""
    pivots = tokens.groupBy("h").agg(F.min("key").alias("cell"), F.count("*").alias("c")).where("c > 1").select("h", "cell")
    members = tokens.join(pivots, "h").select("cell", "key").distinct()
    if num < den:
        ring = F.floor(F.log("n") / (float(np.log(den / num)) * (1 + 1e-9)))  # a little wider than the factor, for rounding
    else:
        ring = F.col("n")
    rings = members.join(sketches, "key").select("cell", "key", "n", "sketch", F.explode(F.array(ring, ring + 1)).alias("ring"))
    rings = materialize(rings, "rings", parts)
    counts = rings.groupBy("cell", "ring").agg(F.count("*").alias("c")).where("c > 1").select("cell", "ring", (F.col("c") <= BLOCK).alias("small"))
    dealt = rings.join(counts, ["cell", "ring"])

    def run(table):
        n = table.column("n").to_numpy()
        keep = possible(n, table.column("sketch").to_pylist(), num, den)
        return pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[keep]) for c in ("cell", "key", "n")], ["cell", "key", "n"])

    found = _by_runs(dealt.where("small").select("cell", "ring", "key", "n", "sketch"), ["cell", "ring"], run, "cell long, key long, n long")
    # members of rings beyond one task's bound are not compared here at all: they meet pivots first
    found = found.unionByName(dealt.where("not small").select("cell", "key", "n"))
    return materialize(found.distinct(), "neighbourhoods", parts)


def _join_blocks(cells: DataFrame, sizes: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """Links of cells by counting: of a cell of several blocks, an open member meets all blocks, an absorbed one those of open members."""
    n_open = F.ceil(F.col("open") * F.col("blocks") / F.col("c")).cast("int")
    one = F.col("blocks") == 1
    own = F.when(one, 0).when(F.col("absorbed"), n_open + F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("key"), n_open)).cast("int")
    last = F.when(one, 0).when(F.col("absorbed"), n_open - 1).otherwise(n_open + F.col("blocks") - 1)
    dealt = cells.join(sizes, "cell").select("cell", "key", "absorbed", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "key", "absorbed")
    return _by_runs(dealt.join(items, "key"), ["cell", "lo", "hi"], lambda t: _join_block(t, num, den), "a long, b long").distinct()


def _join_cells(cells: DataFrame, items: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Links (a, b) of all cells (cell, key, n, absorbed): large ones are parted into Voronoi regions, level by level.

    A cell whose regions together have more than ``GROWTH`` times its members does not come apart: it is joined in blocks."""
    eps = 1 - num / den + 1e-6
    links, cells = [], cells.withColumn("whole", F.lit(False))
    for level in range(LEVELS + 1):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.count(F.when(~F.col("absorbed"), 1)).alias("open"), F.max("whole").alias("whole"))
        sizes = sizes.where("c > 1 and open > 0").select("cell", "c", "open", "whole", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_ITEMS)).cast("int").alias("blocks"))
        sizes = materialize(sizes, "cell-sizes", parts)
        large = sizes.where("blocks > 1 and not whole").select("cell", "c", "blocks")
        done = level == LEVELS or large.isEmpty()
        links.append(materialize(_join_blocks(cells.drop("whole"), sizes if done else sizes.where("blocks = 1 or whole"), items, num, den), "links", parts))
        if done:
            break
        members = cells.join(large, "cell").select("cell", "key", "n", "c", "blocks")
        pivots = members.groupBy("cell", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(PIVOTS)).alias("slot")).agg(F.min("key").alias("key"), F.first("blocks").alias("blocks"))
        given = members.select("cell", "key", F.lit(False).alias("is_pivot"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
        given = given.unionByName(pivots.select("cell", "key", F.lit(True).alias("is_pivot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
        parted = _by_runs(given.join(items, "key"), ["cell", "block"], lambda t: _part_block(t, num, den), "parent long, cell long, key long, n long, absorbed boolean, d double, pivot long")
        parted = materialize(parted, "regions")
        star = parted.where("cell is null")
        links.append(star.where("key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        least = parted.where("cell is not null and not absorbed").groupBy("cell").agg(F.min("d").alias("least"))
        regions = materialize(parted.join(least, "cell").where(~F.col("absorbed") | (F.col("d") >= F.col("least") - eps)).select("parent", "cell", "key", "n", "absorbed"), "windows")
        apart = regions.groupBy("parent").agg(F.count("*").alias("made")).join(large, F.col("parent") == F.col("cell"), "right").select("cell", (F.coalesce("made", F.lit(0)) <= GROWTH * F.col("c")).alias("apart"))
        apart = materialize(apart, "apart", parts)
        best = star.groupBy("parent", "pivot").count().groupBy("parent").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
        near = star.join(best, ["parent", "pivot"]).select(F.col("parent").alias("cell"), "key", F.lit(True).alias("absorbed"))
        whole = members.join(apart.where("not apart"), "cell").join(near, ["cell", "key"], "left").select("cell", "key", "n", F.coalesce("absorbed", F.lit(False)).alias("absorbed"), F.lit(True).alias("whole"))
        fine = regions.join(apart.where("apart").select(F.col("cell").alias("parent")), "parent").select("cell", "key", "n", "absorbed", F.lit(False).alias("whole"))
        cells = materialize(fine.unionByName(whole), "cells")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct(), "all-links", parts)


def _links(docs: DataFrame, rows: DataFrame, path: str, classes: DataFrame, renamed: dict[tuple[int, int], int], k: int, num: int, den: int, parts: int) -> DataFrame:
    """Edges (a, b) between classes that give all components of the linked classes. The rows' table is given up on the way."""
    spark = docs.sparkSession
    alone = rows.where("n > 0 and doc_id is not null").select("key", F.explode("counted").alias("h")).groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other")
    alone = alone.groupBy("key").agg(F.count("*").alias("alone"))
    size = F.col("n") - F.ceil(F.lit(num) * F.col("n") / den) + 1
    wanted = classes.join(alone, "key", "left").withColumn("more", (size - F.coalesce("alone", F.lit(0))).cast("int")).where("more > 0")
    wanted = materialize(wanted.select("key", "doc_id", "n", "more"), "open-classes", parts)
    discard(spark, path)
    sets, sets_path = _sets(docs, wanted, k, num, den, _frequent(docs, k), renamed)
    # the counted shingles that stand alone come first and meet nothing; if the others do not fill the prefix, all counted ones are taken
    prefix = F.when(F.col("more") <= F.col("rare"), F.slice("prefix", F.lit(1), F.col("more"))).otherwise(F.col("prefix"))
    tokens = sets.select("key", "prefix", "rare").join(wanted.select("key", "more"), "key").select("key", F.explode(prefix).alias("h")).distinct()
    tokens = materialize(tokens, "prefixes", parts)
    sketches = sets.select("key", "sketch").join(wanted.select("key", "n"), "key").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    near = _neighbourhoods(tokens, sketches, num, den, parts)
    named = materialize(near.select("key").distinct(), "named", parts)
    items, items_path = written(sets.select("key", "items").join(named, "key", "left_semi").groupBy("key").agg(F.first("items").alias("items")), "items")
    discard(spark, sets_path)
    links = _join_cells(near.withColumn("absorbed", F.lit(False)), items, num, den, parts)
    discard(spark, items_path)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links) of every row of ``docs``.

    Two documents are linked if ``den * |intersection| >= num * |union|`` of their sets of ``k``-word shingles."""
    given, path = _named_rows(docs, k, num, den)
    renamed = _renamed(given)
    if renamed:
        table = docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "key long, check long, other long")
        given = given.join(F.broadcast(table), ["key", "check"], "left").withColumn("key", F.coalesce("other", "key")).drop("other")
    rows = materialize(given.select("doc_id", "n", "key"), "rows")
    full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(full.groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id")), "classes")
    parts = 8 + classes.count() // CLASSES_OF_TASK
    links = _links(docs, given, path, classes, renamed, k, num, den, parts)
    repeated = full.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a != z").select("doc_id", "a")  # ids of several texts
    several = full.select("doc_id", F.col("key").alias("b")).join(repeated, "doc_id").select("a", "b").distinct()
    roots = materialize(components(links.unionByName(several)), "roots", parts)
    labelled = classes.join(roots, classes["key"] == roots["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "doc_id")
    least = materialize(labelled.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least", parts)
    labels = materialize(labelled.join(least, "root").select("key", "component_id"), "labels", parts)
    out = rows.select("doc_id", "n", "key").join(labels, "key", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def sql(k: int, num: int, den: int, table: str = "documents") -> str:
    """``near_duplicates`` as DuckDB SQL: all pairs that share a shingle, and their transitive closure."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM {table}),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+{k - 1}], ' ') AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {k - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * i >= {num} * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""

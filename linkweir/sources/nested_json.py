"""A file {outer: {inner: record}} read by many tasks.

Where a byte of JSON stands (in a string or not, at which depth, under which outer key) depends on all bytes before it. Each
range of bytes is therefore first summed up for every state that it may begin in; a fold over the summaries of a file, one
row a range, gives the state that it does begin in. The ranges then tell their last outer key, and at last every range gives
the records whose keys begin in it, reading on for the end of its last one. So a file is scanned three times, by as many
tasks as it has ranges, and no task holds more than a range and a record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blobs import opened, ranges

#: Bytes of a file that a task scans.
STEP = 32 << 20
#: States in which a range may begin: outside strings, in one, in one after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
_QUOTE, _BACKSLASH, _COLON = b'"\\:'
_SPACE = b" \t\r\n"
_DELTA = np.zeros(256, np.int64)
_DELTA[list(b"{[")], _DELTA[list(b"}]")] = 1, -1


class Structure(NamedTuple):
    """Quotes that begin or end strings, brackets outside strings with the depth after each, and the state at the end."""

    quotes: np.ndarray
    brackets: np.ndarray
    depths: np.ndarray
    state: int


def structure(data: bytes, state: int, depth: int = 0) -> Structure:
    view = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(view == _BACKSLASH)
    breaks = np.flatnonzero(np.diff(at) != 1) + 1
    first = at[np.concatenate([[0], breaks])] if len(at) else at
    last = at[np.concatenate([breaks - 1, [len(at) - 1]])] if len(at) else at
    odd = (last - first + 1 - ((first == 0) & (state == ESCAPED))) % 2 == 1
    escaped = last[odd] + 1
    if state == ESCAPED and not (len(at) and at[0] == 0):
        escaped = np.append(escaped, 0)
    quotes = np.setdiff1d(np.flatnonzero(view == _QUOTE), escaped, assume_unique=True)
    start = int(state != OUTSIDE)
    brackets = np.flatnonzero(_DELTA[view])
    brackets = brackets[(np.searchsorted(quotes, brackets) + start) % 2 == 0]
    end = OUTSIDE if (len(quotes) + start) % 2 == 0 else ESCAPED if len(view) in escaped else INSIDE
    if not len(view):
        end = state
    return Structure(quotes, brackets, depth + np.cumsum(_DELTA[view[brackets]]), end)


def keys(data: bytes, s: Structure, state: int, depth: int, level: int) -> Iterator[tuple[int, int, int]]:
    """Of the keys of objects at depth ``level``: the quotes around them and the colon after, -1 where it lies beyond the data."""
    opening = s.quotes[int(state != OUTSIDE) :: 2]
    before = np.searchsorted(s.brackets, opening)
    depths = np.append(depth, s.depths)[before]
    closing = np.append(s.quotes[int(state != OUTSIDE) + 1 :: 2], -1)
    for i in np.flatnonzero(depths == level).tolist():
        a, z = int(opening[i]), int(closing[i])
        colon = z + 1 if z >= 0 else len(data)
        while colon < len(data) and data[colon] in _SPACE:
            colon += 1
        if colon >= len(data):
            yield a, z, -1
        elif data[colon] == _COLON:
            yield a, z, colon


def value_end(data: bytes, s: Structure, start: int, level: int) -> int:
    """After the value that begins at ``start`` inside an object at depth ``level``; -1 if it lies beyond the data."""
    if start >= len(data):
        return -1
    c = data[start : start + 1]
    if c in b"{[":
        i = int(np.searchsorted(s.brackets, start))
        ends = np.flatnonzero(s.depths[i : i + 64] == level)
        if not len(ends):
            ends = np.flatnonzero(s.depths[i:] == level)
        return int(s.brackets[i + ends[0]]) + 1 if len(ends) else -1
    if c == b'"':
        i = int(np.searchsorted(s.quotes, start)) + 1
        return int(s.quotes[i]) + 1 if i < len(s.quotes) else -1
    end = start
    while end < len(data) and data[end] not in b",}" + _SPACE:
        end += 1
    return end if end < len(data) else -1


def records(f: pa.NativeFile, first: int, last: int, state: int, depth: int, outer: str | None) -> Iterator[tuple[str, str, str]]:
    """Outer key, inner key and text of the records whose keys begin in bytes ``first`` to ``last`` - 1."""
    size, end = f.size(), last
    while True:
        f.seek(first)
        data = f.read(end - first)
        s, out, short, name = structure(data, state, depth), [], False, outer
        above = [k for k in keys(data, s, state, depth, 1) if k[2] >= 0]
        at = 0
        for a, z, colon in keys(data, s, state, depth, 2):
            if a >= last - first:
                break
            start = colon + 1
            while 0 <= colon and start < len(data) and data[start] in _SPACE:
                start += 1
            stop = value_end(data, s, start, 2) if colon >= 0 else -1
            if stop < 0:
                short = True
                break
            while at < len(above) and above[at][0] < a:
                name = json.loads(data[above[at][0] : above[at][1] + 1])
                at += 1
            out.append((name, json.loads(data[a : z + 1]), data[start:stop].decode()))
        if not short or end >= size:
            yield from out
            return
        end = min(size, end + max(1 << 16, end - first))  # a record that ends later: read on


def _ranges(spark: SparkSession, path: str, step: int) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return ranges(listed, "length", step).drop("length").repartition("path", "first")


def _summed(rows: DataFrame) -> DataFrame:
    """Adds the states at the end and the change of depth for each state at the start."""

    def run(batches):
        for b in batches:
            states, deltas = [], []
            for path, first, last in zip(*(b.column(c).to_pylist() for c in ("path", "first", "last"))):
                where, at = opened(path)
                with where.open_input_file(at) as f:
                    f.seek(first)
                    data = f.read(last - first)
                got = [structure(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
                states.append([g.state for g in got])
                deltas.append([int(g.depths[-1]) if len(g.depths) else 0 for g in got])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.list_(pa.int32())), pa.array(deltas, pa.list_(pa.int64()))], [*b.schema.names, "states", "deltas"])

    return rows.mapInArrow(run, "path string, first long, last long, states array<int>, deltas array<long>")


def _begun(summed: DataFrame) -> DataFrame:
    """The state and depth in which each range begins: a fold over the ranges of a file."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        state, depth, out = OUTSIDE, 0, []
        for path, first, last, states, deltas in rows[["path", "first", "last", "states", "deltas"]].itertuples(index=False):
            out.append((path, first, last, state, depth))
            state, depth = int(states[state]), depth + int(deltas[state])
        return pd.DataFrame(out, columns=["path", "first", "last", "state", "depth"])

    return summed.groupBy("path").applyInPandas(fold, "path string, first long, last long, state int, depth long")


def _under(begun: DataFrame) -> DataFrame:
    """Adds the outer key in force where a range begins; null before the first."""

    def run(batches):
        for b in batches:
            names = []
            for path, first, last, state, depth in zip(*(b.column(c).to_pylist() for c in ("path", "first", "last", "state", "depth"))):
                where, at = opened(path)
                with where.open_input_file(at) as f:
                    f.seek(first)
                    data = f.read(min(f.size() - first, last - first + (1 << 16)))  # a key that begins here may end later
                found = [k for k in keys(data, structure(data, state, depth), state, depth, 1) if k[2] >= 0 and k[0] < last - first]
                names.append(json.loads(data[found[-1][0] : found[-1][1] + 1]) if found else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], [*b.schema.names, "name"])

    named = begun.repartition("path", "first").mapInArrow(run, "path string, first long, last long, state int, depth long, name string")
    before = W.partitionBy("path").orderBy("first").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    return named.withColumn("outer", F.last("name", ignorenulls=True).over(before)).drop("name")


def read_map_of_maps(spark: SparkSession, path: str, record: str, step: int = STEP) -> DataFrame:
    """{outer: {inner: record}} of each file as rows (outer, inner, columns of the ``record``, a schema).

    Records that are null or of another kind give null columns; a key that a file repeats gives a row each time."""

    def run(batches):
        for b in batches:
            for path, first, last, state, depth, outer in zip(*(b.column(c).to_pylist() for c in ("path", "first", "last", "state", "depth", "outer"))):
                where, at = opened(path)
                with where.open_input_file(at) as f:
                    got = list(records(f, first, last, state, depth, outer))
                for lo in range(0, len(got), 10_000):
                    part = got[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in range(3)], ["outer", "inner", "json"])

    states = _under(_begun(_summed(_ranges(spark, path, step))))
    rows = states.repartition("path", "first").mapInArrow(run, "outer string, inner string, json string")
    return rows.select("outer", "inner", F.from_json("json", record).alias("_r")).select("outer", "inner", "_r.*")

"""Files as rows: written, copied, asked for and scanned in pieces by the tasks that hold their paths.

Paths are local or URIs of any file system that Arrow opens. The driver lists nothing and reads no content.
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: Bytes that a task holds of a file that it copies or reads on beyond its range.
BLOCK = 1 << 16
#: Bytes of the range of a file that one row of a scan stands for.
RANGE = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. Local paths are taken as they stand, as Spark writes them, with or without "file:"."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(quote(path, safe="/:@%?=&+,;~!$'()*#[]"))


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def _put(path: str, blocks: Iterator[bytes]) -> int:
    """Write a file under a name of this attempt and move it into place, so that no reader sees a part; its size."""
    where, at = opened(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    draft, size = f"{at}.{uuid.uuid4().hex}.part", 0
    with where.open_output_stream(draft) as out:
        for b in blocks:
            out.write(b)
            size += len(b)
    where.move(draft, at)
    return size


def write_files(rows: DataFrame, root: str) -> None:
    """Write the text or bytes ``content`` of every row to ``path`` below ``root``. Null content is an empty file; of rows of one path any may win."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                _put(f"{root.rstrip('/')}/{path}", iter([content or b""]))
            yield b.select(["path"])

    content = F.col("content").cast("binary").alias("content")
    rows.where("path is not null").select("path", content).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def copy_files(rows: DataFrame, source: str = "path", target: str = "target") -> DataFrame:
    """Copy files in blocks; the rows with ``copied``, the bytes of each copy, null where the source is missing.

    A copy appears whole or not at all. The result is lazy: writing it is what copies."""

    def run(batches):
        for b in batches:
            sizes = []
            for a, z in zip(b.column(source).to_pylist(), b.column(target).to_pylist()):
                sizes.append(None)
                if a is None or z is None:
                    continue
                where, at = opened(a)
                if where.get_file_info(at).type == fs.FileType.File:
                    with where.open_input_stream(at) as f:
                        sizes[-1] = _put(z, iter(lambda: f.read(BLOCK), b""))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*b.schema.names, "copied"])

    return rows.drop("copied").mapInArrow(run, _fields(rows.drop("copied")) + "copied long")


def ask(rows: DataFrame, path: str = "path", at_once: int = 500) -> DataFrame:
    """The rows with ``size``, the bytes of the file at ``path``: null where there is none. Each task asks for its own paths; no folder is listed."""
    rows = rows.drop("size")

    def run(batches):
        for b in batches:
            paths, sizes = b.column(path).to_pylist(), [None] * b.num_rows
            for lo in range(0, len(paths), at_once):
                by_system: dict[str, list[int]] = {}
                for i in range(lo, min(lo + at_once, len(paths))):
                    if paths[i]:
                        by_system.setdefault(re.match(r"(?:\w+://[^/]*)?", paths[i])[0], []).append(i)
                for places in by_system.values():
                    where = opened(paths[places[0]])[0]
                    for i, info in zip(places, where.get_file_info([opened(paths[p])[1] for p in places])):
                        sizes[i] = info.size if info.type == fs.FileType.File else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*b.schema.names, "size"])

    return rows.mapInArrow(run, _fields(rows) + "size long")


#: Characters of contents that a batch of files has before it is sent on, and folders that one task reads.
SENT, FOLDERS = 4 << 20, 1000


def _entries(where: fs.FileSystem, at: str) -> Iterator[str]:
    """Names of what a folder holds, one after the other where the file system gives them so; none of a folder that is missing."""
    if isinstance(where, fs.LocalFileSystem):
        with contextlib.suppress(FileNotFoundError), os.scandir(at) as found:
            yield from (e.name for e in found)
    else:
        yield from (x.base_name for x in where.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def names_in(spark: SparkSession, root: str, at_once: int = 10_000) -> DataFrame:
    """``name`` of each entry of one folder. A folder is listed by one task, which holds ``at_once`` names."""

    def run(batches):
        for b in batches:
            found = _entries(*opened(root.rstrip("/"))) if b.num_rows else iter(())
            while names := list(islice(found, at_once)):
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name string")


def read_folders(names: DataFrame, root: str, endings: tuple[str, ...], per_task: int = FOLDERS) -> DataFrame:
    """``name``, ``path``, ``size`` and ``content`` of all files at any depth below ``root``/``name`` whose names end so.

    A file may stand in the place of a folder; a missing one has no files. Each task lists and reads folders of its own,
    one at a time, so neither the driver nor a task holds a list of all files. Bytes that are no UTF-8 are left out."""
    root = root.rstrip("/")

    def run(batches):
        where, base = opened(root)
        cols, held = ([], [], [], []), 0
        for b in batches:
            for name in b.column("name").to_pylist():
                top = where.get_file_info(f"{base}/{name}")
                below = where.get_file_info(fs.FileSelector(top.path, recursive=True)) if top.type == fs.FileType.Directory else [top]
                for x in sorted((x for x in below if x.type == fs.FileType.File and x.base_name.endswith(endings)), key=lambda x: x.path):
                    with where.open_input_stream(x.path) as f:
                        content = f.read().decode("utf-8", "ignore")
                    for c, v in zip(cols, (name, root + x.path[len(base) :], x.size, content)):
                        c.append(v)
                    held += len(content)
                    if held >= SENT or len(cols[0]) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["name", "path", "size", "content"])
                        cols, held = ([], [], [], []), 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["name", "path", "size", "content"])

    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    names = written(names.select("name").where("name <> ''").distinct(), "folders")
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // per_task))
    return names.repartition(tasks, "name").mapInArrow(run, "name string, path string, size long, content string")


def ranges(files: DataFrame, size: Column | str, step: int = RANGE) -> DataFrame:
    """A row for each range of ``step`` bytes of the files: ``first`` and ``last`` byte, the last one excluded. Empty files have none."""
    n = F.col(size) if isinstance(size, str) else size
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(step).cast("long")))
    return files.select("*", F.explode(starts).alias("first"), n.alias("_n")).withColumn("last", F.least(F.col("first") + step, F.col("_n"))).drop("_n")


#: Bytes that end a run in which a URL may lie, and what begins one there.
_GAP = re.compile(rb"""[\s<>()"']""")
_LINK = re.compile(rb"https?://(?=.)", re.I | re.S)


def links_of_range(f: pa.NativeFile, first: int, last: int, block: int = BLOCK) -> Iterator[bytes]:
    """URLs of the runs that begin in bytes ``first`` to ``last`` - 1 of a file.

    A run is what lies between white space, brackets and quotes; it holds one URL at most, from the first scheme that
    something follows to the run's end. A run belongs to the range that it begins in, so this one skips what is left of a
    run before it and reads its own last run on, beyond ``last``, in blocks. Of a run without a scheme only its last bytes
    are held."""
    f.seek(max(0, first - 1))
    at, held, link, skipping = max(0, first - 1), b"", False, first > 0
    while True:
        data = f.read(min(block, last - at) if at < last else block)
        where, at = 0, at + len(data)
        for m in [*_GAP.finditer(data), None] if data else ():
            piece = data[where : m.start() if m else len(data)]
            where = m.end() if m else len(data)
            if not skipping:
                held += piece
                if not link and (s := _LINK.search(held)):
                    held, link = held[s.start() :], True
                elif not link:
                    held = held[-8:]  # shorter than a scheme with a byte after it
            if m:
                if link:
                    yield held
                held, link, skipping = b"", False, False
                if at - len(data) + m.end() >= last:
                    return  # the next run begins beyond
        if not data:
            if link:
                yield held
            return


def scan_links(files: DataFrame, path: str = "path", size: str = "size", step: int = RANGE, block: int = BLOCK) -> DataFrame:
    """``path`` and the distinct URLs in the bytes of each file, as the whole file at once would give them.

    Files are dealt out by ranges of ``step`` bytes, so one of any size is the work of many tasks, and none is held whole."""

    def run(batches):
        for b in batches:
            paths, urls = [], []
            for p, first, last in zip(*(b.column(c).to_pylist() for c in ("path", "first", "last"))):
                where, at = opened(p)
                with where.open_input_file(at) as f:
                    found = {u.decode("utf-8", "ignore") for u in links_of_range(f, first, last, block)}
                paths += [p] * len(found)
                urls += found
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "url": pa.array(urls, pa.string())})

    rows = ranges(files.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size")), "size", step)
    return rows.repartition("path", "first").mapInArrow(run, "path string, url string").distinct()

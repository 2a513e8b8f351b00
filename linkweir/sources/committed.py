"""A sink of JSON or text lines whose result is what one manifest names, and is replaced as a whole.

Format ``committed_lines``. Tasks write files of new names below ``data``; when all are done, the driver writes a manifest of
the next number and moves it into place. Readers take the manifest of the largest number, so until that move they see the
old result: a task that dies, is run again or runs twice, and a driver that stops, only leave files that no manifest names,
which ``clean`` removes. Mode "append" names the old files too, "overwrite" only the new ones.

Options: ``path`` (local or a URI that Arrow opens) and ``lines``: "json" (the default, an object a row) or "text" (the
columns joined by ``sep``, for manifests such as year|id|path; null is empty).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .blobs import opened

FORMAT = "committed_lines"
_MANIFEST = re.compile(r"manifest-(\d{12})\.json")


@dataclass
class Files(WriterCommitMessage):
    names: list[str]
    rows: int


def _manifests(path: str) -> list[tuple[int, str]]:
    """Numbers and paths of the manifests, in order."""
    where, at = opened(path)
    found = where.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((int(m[1]), f.path) for f in found if (m := _MANIFEST.fullmatch(f.base_name)))


def current(path: str) -> dict:
    """The manifest in force: number, names of files and rows; number -1 where nothing was committed."""
    known = _manifests(path)
    if not known:
        return {"number": -1, "files": [], "rows": 0}
    with opened(path)[0].open_input_stream(known[-1][1]) as f:
        return json.loads(f.read()) | {"number": known[-1][0]}


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.kind, self.sep = options.get("lines", "json"), options.get("sep", "|")
        if self.kind not in ("json", "text"):
            raise ValueError(f"lines must be json or text, not {self.kind}")

    def lines(self, batch: pa.RecordBatch) -> Iterator[str]:
        if self.kind == "json":
            return (json.dumps(r, ensure_ascii=False, default=str) for r in batch.to_pylist())
        columns = [c.to_pylist() for c in batch.columns]
        return (self.sep.join("" if v is None else str(v) for v in r) for r in zip(*columns))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        where, at = opened(self.path)
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Files([], 0)  # a task without rows makes no file
        where.create_dir(f"{at}/data", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.{self.kind}", 0
        with where.open_output_stream(f"{at}/data/{name}") as out:
            for batch in chain([first], iterator):
                out.write("".join(f"{line}\n" for line in self.lines(batch)).encode())
                rows += batch.num_rows
        return Files([name], rows)

    def commit(self, messages: list[Files]) -> None:
        where, at = opened(self.path)
        old = current(self.path)
        kept = {"files": [], "rows": 0} if self.overwrite else old
        got = [m for m in messages if m is not None]
        new = {"files": kept["files"] + [n for m in got for n in m.names], "rows": kept["rows"] + sum(m.rows for m in got)}
        where.create_dir(at, recursive=True)
        draft = f"{at}/draft-{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as out:
            out.write(json.dumps(new).encode())
        where.move(draft, f"{at}/manifest-{old['number'] + 1:012d}.json")

    def abort(self, messages: list[Files]) -> None:
        where, at = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            where.delete_file(f"{at}/data/{name}")


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write_committed(df: DataFrame, path: str, lines: str = "json", mode: str = "overwrite", sep: str = "|") -> None:
    df.sparkSession.dataSource.register(CommittedLines)
    df.write.format(FORMAT).option("path", path).option("lines", lines).option("sep", sep).mode(mode).save()


def read_committed(spark: SparkSession, path: str, schema: str, sep: str | None = None) -> DataFrame:
    """The rows of the manifest in force; with ``sep`` from text lines. Nothing committed is an empty table."""
    where, files = path.rstrip("/"), current(path)["files"]
    if not files:
        return spark.createDataFrame([], schema)
    names = [f"{where}/data/{n}" for n in files]
    if sep is None:
        return spark.read.schema(schema).json(names)
    fields = StructType.fromDDL(schema).fields
    parts = F.split("value", re.escape(sep), len(fields))
    return spark.read.text(names).select(*(F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


def clean(path: str) -> int:
    """Delete files that the manifest in force does not name, and older manifests; how many files went. Not for use beside a running write."""
    where, at = opened(path)
    named, known = set(current(path)["files"]), _manifests(path)
    data = where.get_file_info(fs.FileSelector(f"{at}/data", allow_not_found=True))
    drafts = [f for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith("draft-")]
    gone = [f.path for f in data if f.base_name not in named] + [p for _, p in known[:-1]] + [f.path for f in drafts]
    for p in gone:
        where.delete_file(p)
    return len(gone)

"""WARC archives with a globally ordered capture index.

Every page becomes one gzip member of a WARC/1.1 file: a *response* with the whole payload, or a *revisit* that refers to the
response with an equal payload. Each task writes one archive and its captures as a locally sorted run; the runs are merged by
(URL key, timestamp, page id) with a loser tree, by ranges of the key so that all tasks share the work, and in passes of at
most ``FAN_IN`` runs. Reading goes through the merged index: records are fetched by file, offset and length.

The digest of a payload is dealt with as a join of pages with (digest, largest page_id); both sides are plain exchanges, so
a digest that many pages share is split by adaptive execution. Tasks that run again write files of other names; only those
in the committed manifest are used.

A null html is an empty payload; a null url gets ``urn:page:<id>``; a null page_id is never the response of others and
revisits the response with an equal payload if there is one; pages with equal id and payload are all responses. Timestamps,
where no column gives them, are ``EPOCH`` plus page_id seconds.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
FAN_IN, INDEX_STEP, SAMPLES = 64, 128, 16
INDEX = "shard int, seq long, url_key string, ts string, page_id long, type string, digest string, refers_to long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: the host's labels from last to first, then port, path and query; white space escaped."""
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02x}", url or "")
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    host = ",".join(reversed([x for x in m[1].lower().split(".") if x]))
    return f"{host}{m[2] or ''}){m[3] or '/'}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, ts: datetime, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record, as a gzip member. ``refers_to``: of a revisit, the response's page id."""
    uri = re.sub(r"[\s]+", "%20", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uri}')}>",
        f"WARC-Date: {ts:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next item costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = runs, key
        self.k = max(1, len(runs))
        self.items = [next(r, None) for r in runs] or [None]
        self.keys = [self._key(x) for x in self.items]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._settle(i)

    def _key(self, item):
        return (1,) if item is None else (0, *self.key(item))

    def _settle(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # still being built: the first to come waits here
                self.losers[node] = winner
                return
            if (self.keys[other], other) < (self.keys[winner], winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (item := self.items[w := self.losers[0]]) is not None:
            yield item
            self.items[w] = next(self.runs[w], None)
            self.keys[w] = self._key(self.items[w])
            self._settle(w)


def _order(line: str) -> tuple[str, str, int, str]:
    key, ts, page, rest = line.split("\t", 3)
    return key, ts, int(page or -(1 << 63)), rest


def _write_run(where, path: str, lines: Iterator[str]) -> tuple[int, list[str]]:
    """Sorted lines and, every INDEX_STEP lines, their order and offset. Returns the count and some of the lines."""
    n, offset, marks = 0, 0, []
    with where.open_output_stream(path) as out:
        for line in lines:
            if n % INDEX_STEP == 0:
                marks.append("\t".join([*line.split("\t", 3)[:3], str(offset)]))
            raw = (line + "\n").encode("utf-8", "surrogatepass")
            out.write(raw)
            offset += len(raw)
            n += 1
    with where.open_output_stream(path + ".idx") as out:
        out.write("\n".join(marks).encode("utf-8", "surrogatepass"))
    return n, marks[:: max(1, len(marks) // SAMPLES)]


def _read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[str]:
    """Lines of a run from ``low`` up to, without, ``high``."""
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path + ".idx") as f:
        marks = [m.split("\t") for m in f.read().decode("utf-8", "surrogatepass").split("\n") if m]
    orders = [(k, t, int(p or -(1 << 63))) for k, t, p, _ in marks]
    at = max(0, bisect.bisect_left(orders, low) - 1) if low and orders else 0
    if not marks:
        return
    with where.open_input_file(path) as f:
        f.seek(int(marks[at][3]))
        for raw in io.BufferedReader(f, 1 << 16):
            line = raw.decode("utf-8", "surrogatepass").rstrip("\n")
            order = _order(line)[:3]
            if high and order >= high:
                return
            if not low or order >= low:
                yield line


def write(pages: DataFrame, path: str, min_bytes: int = 0, timestamp: str | None = None) -> DataFrame:
    """Write archives and runs below ``path``; the committed manifest: archive, run, n, marks (sampled keys)."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", html.alias("payload"), (F.col(timestamp) if timestamp else F.lit(None)).cast("timestamp").alias("captured"))
    digest = F.sha1("payload")
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy(digest.alias("sha")).agg(F.max("page_id").alias("keeper"))
    first = materialize(first.where(F.col("keeper").isNotNull()), "payloads")
    dealt = rows.withColumn("sha", digest).join(first, "sha", "left")

    def run(batches):
        where, at = fs.FileSystem.from_uri(path)
        where.create_dir(at, recursive=True)
        name, lines, offset, out = uuid.uuid4().hex, [], 0, None
        for b in batches:
            for page, url, payload, captured, keeper in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "captured", "keeper"))):
                out = out or where.open_output_stream(f"{at}/{name}.warc.gz", compression=None)
                ts = captured or EPOCH + timedelta(seconds=(page or 0) % (1 << 31))
                found = payload_digest(payload)
                refers = keeper if keeper is not None and keeper != page else None
                member = record(page, url, ts, payload, found, refers)
                out.write(member)
                kind = "response" if refers is None else "revisit"
                uri = url or f"urn:page:{page}"
                text = ["" if x is None else str(x) for x in (url_key(uri), ts.strftime("%Y%m%d%H%M%S"), page, kind, found, refers, f"{name}.warc.gz", offset, len(member))]
                lines.append("\t".join(text))
                offset += len(member)
        if out:
            out.close()
            lines.sort(key=_order)
            n, marks = _write_run(where, f"{at}/{name}.cdx", iter(lines))
            yield pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "run": [f"{name}.cdx"], "n": [n], "marks": [marks]})

    return materialize(dealt.select("page_id", "url", "payload", "captured", "keeper").mapInArrow(run, "archive string, run string, n long, marks array<string>"), "archives")


def _cut(mark: str) -> tuple[str, str, int]:
    key, ts, page = mark.split("\t")[:3]
    return key, ts, int(page or -(1 << 63))


def _bounds(runs: list, parts: int) -> list[tuple[str | None, str | None]]:
    """At most ``parts`` ranges of keys, as marks, that hold about as many of the runs' marks each."""
    marks = sorted({_cut(m): "\t".join(m.split("\t")[:3]) for r in runs for m in r[2]}.items())
    cuts = [marks[i][1] for i in sorted({len(marks) * k // parts for k in range(1, parts)} - {0})] if marks else []
    return list(zip([None, *cuts], [*cuts, None]))


def _read_files(path: str, names: list[str], low: tuple | None, high: tuple | None) -> Iterator[str]:
    """Lines of a run, which lies in one file or in several of ascending ranges."""
    for name in names:
        yield from _read_run(f"{path}/{name}", low, high)


def _merging(path: str) -> Callable:
    """Merges runs within a range of keys into a file of its own."""

    def run(batches):
        where, at = fs.FileSystem.from_uri(path)
        for b in batches:
            for g, i, names, low, high in zip(*(b.column(c).to_pylist() for c in ("g", "i", "names", "low", "high"))):
                name = f"{uuid.uuid4().hex}.cdx"
                tree = LoserTree([_read_files(path, x, low and _cut(low), high and _cut(high)) for x in names], _order)
                n, marks = _write_run(where, f"{at}/{name}", iter(tree))
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "i": pa.array([i], pa.int32()), "run": [name], "n": [n], "marks": pa.array([marks], pa.list_(pa.string()))})

    return run


def merge(spark: SparkSession, path: str, manifest: DataFrame, ranges: int | None = None) -> DataFrame:
    """The capture index: rows of ``INDEX``, in order by (shard, seq).

    While there are more runs than a tree takes, groups of them are merged, each in as many key ranges as keep at least
    ``ranges`` tasks at work; what a group becomes is a run of several files, one a range."""
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = sorted(([r["run"]], r["n"], list(r["marks"])) for r in manifest.collect())  # one row a task that wrote
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        parts = -(-ranges // len(groups))
        todo = [(g, i, [r[0] for r in group], *bound) for g, group in enumerate(groups) for i, bound in enumerate(_bounds(group, parts))]
        work = spark.createDataFrame(todo, "g int, i int, names array<array<string>>, low string, high string").repartition(len(todo))
        made = materialize(work.mapInArrow(_merging(path), "g int, i int, run string, n long, marks array<string>"), "merged-runs")
        done: dict[int, list] = {}
        for r in made.where("n > 0").orderBy("g", "i").collect():
            done.setdefault(r["g"], []).append(r)
        runs = []
        for rows in done.values():
            marks = [m for r in rows for m in r["marks"]]
            runs.append(([r["run"] for r in rows], sum(r["n"] for r in rows), marks[:: max(1, len(marks) // SAMPLES)]))
    names = [r[0] for r in runs]
    bounds = [tuple(x and _cut(x) for x in b) for b in _bounds(runs, ranges)]

    def merge_range(batches):
        for b in batches:
            for i in b.column("i").to_pylist():
                tree = iter(LoserTree([_read_files(path, x, *bounds[i]) for x in names], _order))
                seq = 0
                while rows := [line.split("\t") for line in islice(tree, 10_000)]:
                    cols = list(zip(*rows))
                    number = lambda c: pa.array([int(x) if x else None for x in c], pa.int64())
                    n, seq = len(rows), seq + len(rows)
                    arrays = [pa.array([i] * n, pa.int32()), pa.array(range(seq - n, seq), pa.int64()), pa.array(cols[0]), pa.array(cols[1]), number(cols[2]), pa.array(cols[3]), pa.array(cols[4]), number(cols[5]), pa.array(cols[6]), number(cols[7]), number(cols[8])]
                    yield pa.RecordBatch.from_arrays(arrays, ["shard", "seq", "url_key", "ts", "page_id", "type", "digest", "refers_to", "file", "offset", "length"])

    if not names:
        return spark.createDataFrame([], INDEX)
    work = spark.range(0, len(bounds), 1, len(bounds)).select(F.col("id").alias("i"))
    return materialize(work.mapInArrow(merge_range, INDEX), "capture-index")


def read(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every capture of the index, from the records.

    Of a revisit, length and digest are those that its record states of the payload; of a response, they are computed."""

    def run(batches):
        where, at = fs.FileSystem.from_uri(path)
        for b in batches:
            rows = sorted(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
            out, name, f = [], None, None
            for file, offset, length in rows:
                if file != name:
                    if f:
                        f.close()
                    name, f = file, where.open_input_file(f"{at}/{file}")
                f.seek(offset)
                warc, http, payload = parse(f.read(length))
                page = warc["X-Page-ID"]
                kind = warc["WARC-Type"]
                size, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response":
                    size, digest = len(payload), payload_digest(payload)
                refers = warc.get("X-Refers-To-Page")
                out.append((int(page) if page else None, warc["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None))
            if f:
                f.close()
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    return read(spark, path, merge(spark, path, write(pages, path, min_bytes)))


def sql(table: str = "pages") -> str:
    """``archive_and_read`` as DuckDB SQL; five hex digits of a SHA-1 are four base32 letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, 'urn:page:' || page_id) AS url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM {table}),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {letter}), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k"""

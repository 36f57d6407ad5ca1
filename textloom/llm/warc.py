"""Web archives: WARC files written from pages, and a capture index merged externally.

``write`` puts one record per page into gzip-member WARC files in shared storage, one file a task. Of records with
equal payloads of at least ``LEAST`` bytes the one with the largest page_id is the response; the others are revisits
that refer to it. Every task also gives its capture lines (URL key, time, place in the file) in sorted order: a local
run. ``merge`` deals the runs out by ranges of (URL key, time, page) of about ``RANGE_LINES`` lines, however many runs
there are, and each range merges its parts of the runs with a tree of losers, which takes one comparison a level for
each line. Parts stay in Arrow buffers and are read as streams. Ranges follow each other, so the whole history is in
order. ``read_back`` opens the records through the index and parses them.

A file carries the task attempt in its name and only files that finished tasks report are ever read, so a task that is
run again does no harm. Files are written through the file system of the folder's URI.

Defined results: null html is an empty payload; smaller payloads are all responses. Rows that repeat the largest
page_id of a payload are all responses; a page without id never answers for others, unless no copy has one (then all
such are responses). A null url has the empty key. Only ``page_id``, ``url`` and ``html`` are read. Pages carry no
time of capture; unless a column is named for it, page_id seconds after 2020-01-01 stand for it.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, materialise, slices, width, workdir

LEAST = 1000
LEVEL = 4
#: Lines of the index that one merge has in memory, about, and lines of a run that it unpacks at a time.
RANGE_LINES, AT_ONCE = 200_000, 256
#: The upper half of record ids; the lower half is the page_id.
_NAMESPACE = 0x5F3C1B7E9A4D4C21
_START = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)


def url_key(url: str | None) -> str:
    """The host's labels from the right, then path and query, lower-cased and without scheme, port and fragment."""
    try:
        u = urlsplit((url or "").strip().lower())
        host = u.hostname or ""
    except ValueError:
        return (url or "").lower()
    tail = (u.path or "/") + ("?" + "&".join(sorted(u.query.split("&"))) if u.query else "")
    return ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) + ")" + tail if host else tail if url else ""


def record_id(page: int | None) -> str:
    """A URN whose lower 64 bits are the page_id; pages without id share one of their own."""
    n = (_NAMESPACE << 64) | (page & (2**64 - 1)) if page is not None else _NAMESPACE
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(urn: str) -> int | None:
    n = int(re.sub(r"[^0-9a-f]", "", urn.removeprefix("<urn:uuid:")), 16)
    low = n & (2**64 - 1)
    return None if n == _NAMESPACE else low - 2**64 if low >= 2**63 else low


def _record(kind: str, page: int | None, url: str | None, stamp: str, payload: bytes, digest: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', url or '')}",
        f"WARC-Date: {stamp}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Headers and payload of one record (of a revisit: none)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"fields": fields, "payload": payload, "payload_bytes": size}


_LINE = "run bigint, urlkey string, ts bigint, page_id bigint, file string, offset bigint, length bigint, record_type string, refers_to bigint"
_NAMES = [x.split()[0] for x in _LINE.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def deduplicated(pages: DataFrame) -> DataFrame:
    """Pages with digest (SHA-1 of the payload, hex), record_type and refers_to.

    Only payloads that come more than once have a row on the other side. Where that side can't be broadcast, pages are
    dealt by digest; the pages of one frequent payload then are many, and are split, as any page can be joined alone.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= LEAST
    groups = p.where(large).groupBy("digest").agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = p.join(materialise(groups, "copies"), "digest", "left")
    revisit = large & F.col("answer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answer"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("answer")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of ``deduplicated`` pages into ``folder``; the lines of all runs, each run in order."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        lines: list[tuple] = []
        out, at = None, 0
        for batch, col in slices(batches, "html"):
            rows = zip(*(column(batch, k).to_pylist() for k in ("page_id", "url", "digest", "record_type", "refers_to")), col.to_pylist(), strict=True)
            for page, url, digest, kind, refers, html in rows:
                ts = page or 0
                try:
                    stamp = (_START + datetime.timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ")
                except OverflowError:
                    stamp = _START.strftime("%Y-%m-%dT%H:%M:%SZ")
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(_record(kind, page, url, stamp, html.encode("utf-8", "surrogatepass"), bytes.fromhex(digest), refers)) + pack.flush()
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                lines.append((task.partitionId(), url_key(url), ts, page, name, at, len(member), kind, refers))
                at += len(member)
        if out:
            out.close()
        lines.sort(key=lambda r: (r[1], r[2], -(2**63) if r[3] is None else r[3]))
        for i in range(0, len(lines), 10_000):
            part = lines[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    return pages.mapInArrow(archive, _LINE)


def loser_merge(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs with a tree of losers: inner nodes hold the loser of the match below, the root the winner."""
    k = len(runs)
    if k <= 1:
        yield from runs[0] if runs else ()
        return
    streams = [iter(r) for r in runs]
    front: list[tuple | None] = [next(r, None) for r in streams]

    def beats(a: int, b: int) -> bool:
        """Whether run a's front goes before run b's; an ended run loses to all, ties go to the lower run."""
        if front[a] is None or front[b] is None:
            return front[b] is None and (front[a] is not None or a < b)
        return front[a] < front[b] or front[a] == front[b] and a < b

    # Leaves k .. 2k-1 are the runs; the first matches are played from the leaves up.
    loser, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1]
    while front[top] is not None:
        yield front[top]
        front[top] = next(streams[top], None)
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


def merge(runs: DataFrame) -> DataFrame:
    """The lines of all runs in one order of (urlkey, ts, page_id)."""
    ranges = max(width(runs.sparkSession), -(-runs.count() // RANGE_LINES))
    ranged = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id").sortWithinPartitions("run", "urlkey", "ts", "page_id")

    def stream(part: list[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in part:
            for i in range(0, batch.num_rows, AT_ONCE):
                for r in zip(*(c.to_pylist() for c in batch.slice(i, AT_ONCE).columns), strict=True):
                    yield ((r[1], r[2], -(2**63) if r[3] is None else r[3]), *r)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            run = column(batch, "run").to_numpy()
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for a, b in itertools.pairwise(cuts):
                if b > a:
                    parts.setdefault(int(run[a]), []).append(batch.slice(a, b - a))
        lines = (r[1:] for r in loser_merge([stream(p) for p in parts.values()]))
        block: list[tuple] = []
        for r in lines:
            block.append(r)
            if len(block) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in block], t) for k, t in enumerate(_TYPES)], names=_NAMES)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in block], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    return ranged.mapInArrow(merged, _LINE)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, urlkey of every indexed record, as read."""
    fields = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, urlkey string"
    placed = index.select("file", "offset", "length", "urlkey").repartitionByRange(width(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for file, offset, length, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                source.seek(offset)
                r = parse(zlib.decompress(source.read(length), 31))
                kind = r["fields"]["WARC-Type"]
                digest = base64.b32decode(r["fields"]["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload doesn't have its digest")
                refers = r["fields"].get("WARC-Refers-To")
                for to, x in zip(out, (page_of(r["fields"]["WARC-Record-ID"]), r["payload_bytes"], digest, kind, page_of(refers) if refers else None, key), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)], names=[x.split()[0] for x in fields.split(", ")])
        if source:
            source.close()

    return placed.mapInArrow(read, fields)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """The merged capture index of archives written for ``pages``, and their folder."""
    folder = workdir(pages.sparkSession, "warc")
    runs = materialise(write(deduplicated(pages), folder), "runs")
    return materialise(merge(runs), "captures"), folder

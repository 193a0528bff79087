"""WARC archives with deduplicated payloads and a globally ordered capture index.

Write: each task writes archives of its own (gzip, one member a record) to a
shared folder, through the file system that the folder's URI names, and emits each
archive's capture run, sorted by URL key and timestamp. A repeated task writes new
files; only those that the committed run table names are ever read.

Merge: the runs' rows are dealt into ranges of the order; in each range a loser
tree merges the sorted slices of all runs. Slices are spooled to a scratch file and
read a few rows at a time, so memory does not grow with a range.

Read: records are fetched by the offsets of the index, an archive at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import shared_folder
from .common import saved

#: An archive is closed beyond so many compressed bytes.
ARCHIVE_BYTES = 256 * 1024 * 1024
#: Rows of a run that a merge holds at a time.
MERGE_ROWS = 256
RUN_SCHEMA = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("captured", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
#: The order of runs and of the index: the first three fields, nulls first, then where the record is.
ORDER = ["url_key", "captured", "id", "archive", "offset"]


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, for sorting: `com,example)/path?query`. Null gives an empty key."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host = re.match(r"[^/?]*", rest)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + (rest[len(host):] or "/")


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(id_: str | None, url: str | None, captured: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One uncompressed WARC record: an HTTP response, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {captured}",
        f"WARC-Record-ID: <urn:capture:{'' if id_ is None else _header_text(id_)}>", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:capture:{_header_text(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), payload as stored and full payload size. Raises if lengths or digest disagree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    size = int(fields["content-length"])
    if not head.startswith(b"WARC/1.1") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record with a wrong length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != full or f"sha1:{base32_sha1(payload)}" != fields["warc-payload-digest"]):
        raise ValueError("a payload that does not match its digest")
    return fields, payload, full


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _with_roles(pages: DataFrame, min_payload: int) -> DataFrame:
    """`pages` (id, payload, ...) with the hexadecimal `sha` and `refers_to`, null for responses.

    Groups of equal payloads are found by a partial aggregate of digests; the join
    back has one row for each digest on its right side, so a digest with very many
    pages is split by adaptive execution.
    """
    pages = pages.withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    shared = (
        pages.where(F.octet_length("payload") >= min_payload).groupBy("sha").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("keeper").isNotNull()).select("sha", "keeper")
    )
    pages = pages.join(shared, "sha", "left")
    return pages.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper")


def write_archives(pages: DataFrame, folder: str, id_: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None, min_payload: int = 0) -> DataFrame:
    """Writes one record per page under `folder` (a URI or path that all machines share) and returns the capture runs.

    Of records with equal payloads of at least `min_payload` bytes the one with the
    largest id is a response and the others revisit it. Null payload counts as
    empty; a null id is smaller than any other, and pages with no id but equal
    payloads are all responses, as are repeated rows with the largest id. A null URL
    gives no target and sorts first. `captured` is text such as
    2024-01-01T00:00:00Z. An empty table writes nothing and gives no run.
    """
    when = F.lit("1970-01-01T00:00:00Z") if captured is None else captured
    rows = pages.select(F.col(id_).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"), when.alias("captured"))
    rows = _with_roles(rows, min_payload)
    rows = rows.select(F.col("id").cast("string"), "url", F.coalesce("captured", F.lit("")).alias("captured"), "sha", F.col("refers_to").cast("string"), "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(base, recursive=True)
        out, name, run, offset = None, "", [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, run
            if out is not None:
                out.close()
                run.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2], r[6]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*run, strict=True), _RUN_TYPES, strict=True)], names=RUN_SCHEMA.names)
            out, run = None, []

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for id_, target, time, sha, refers, text in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    if out is None:
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(id_, target, time, digest, text.encode(), refers)) + packer.flush()
                    out.write(data)
                    run.append((url_key(target), time, id_, "response" if refers is None else "revisit", digest, name, offset, len(data)))
                    offset += len(data)
                    if offset > ARCHIVE_BYTES:
                        yield from close()
        yield from close()

    return saved(rows.mapInArrow(write, RUN_SCHEMA), "capture-runs")


_RUN_TYPES = [pa.string()] * 6 + [pa.int64()] * 2


class LoserTree:
    """Merges sorted iterators. Each inner node keeps the loser of its match, so the next
    smallest item takes one comparison a level."""

    def __init__(self, runs: list[Iterator[Any]]):
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None
        return self.head[a] < self.head[b] or (self.head[a] == self.head[b] and a < b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival < 0:  # while the tree is built, the first to come waits for the other
                self.losers[node] = winner
                return
            if self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while self.k:
            best = self.losers[0]
            item = self.head[best]
            if item is None:
                return
            yield item
            self.head[best] = next(self.runs[best], None)
            self._play(best)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, the slices of runs one after the other, merged."""
    with tempfile.TemporaryFile() as scratch:
        slices: list[list[int]] = []
        last, n, schema = None, 0, None
        writer = None
        for batch in batches:
            if writer is None:
                schema = batch.schema
                writer = pa.ipc.new_file(scratch, schema)
            names = batch.column(schema.names.index("archive")).to_pylist()
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                if names[a] != last:
                    slices.append([])
                    last = names[a]
                for at in range(a, b, MERGE_ROWS):
                    writer.write_batch(batch.slice(at, min(MERGE_ROWS, b - at)))
                    slices[-1].append(n)
                    n += 1
        if writer is None:
            return
        writer.close()
        scratch.seek(0)
        spool = pa.ipc.open_file(scratch)
        place = [schema.names.index(c) for c in ORDER]

        def rows(numbers: list[int]) -> Iterator[tuple]:
            for i in numbers:
                for row in zip(*(c.to_pylist() for c in spool.get_batch(i).columns), strict=True):
                    yield tuple((row[p] is not None, row[p]) for p in place), row

        ready: list[tuple] = []
        for _, row in LoserTree([rows(s) for s in slices]):
            ready.append(row)
            if len(ready) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
                ready = []
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index: all capture rows with `place`, in global order by URL key, timestamp and id."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = runs.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in ORDER])
    slices = ranged.sortWithinPartitions("archive", *[F.col(c).asc_nulls_first() for c in ORDER])
    return saved(slices.mapInArrow(_merge, runs.schema).withColumn("place", F.monotonically_increasing_id()), "capture-index")


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that `index` names, read and verified: id, url, payload_bytes, payload_digest, record_type, refers_to,
    place and, if asked for, payload (null for revisits)."""
    fields = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, place long"
    schema = fields + (", payload string" if with_payload else "")

    def name(value: str | None) -> str | None:
        return None if value is None or value == "<urn:capture:>" else value[len("<urn:capture:"):-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        opened, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for archive, offset, length, place in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    if archive != opened:
                        if source is not None:
                            source.close()
                        opened, source = archive, files.open_input_file(f"{base}/{archive}")
                    source.seek(offset)
                    head, payload, full = parse_record(zlib.decompress(source.read(length), 31))
                    kind = head["warc-type"]
                    row = (name(head["warc-record-id"]), head.get("warc-target-uri"), full, head["warc-payload-digest"][5:], kind, name(head.get("warc-refers-to")), place)
                    out.append(row + ((payload.decode() if kind == "response" else None,) if with_payload else ()))
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        if source is not None:
            source.close()

    by_archive = index.select("archive", "offset", "length", "place").repartition("archive").sortWithinPartitions("archive", "offset")
    return by_archive.mapInArrow(read, schema)


def archive_and_read(pages: DataFrame, with_payload: bool = False, **columns: Any) -> DataFrame:
    """Writes `pages`, merges the runs and reads every record back through the index."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(merge_runs(write_archives(pages, folder, **columns)), folder, with_payload)

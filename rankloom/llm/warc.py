"""WARC archives: writing, reading by Content-Length, and revisit resolution into deduplicated archives.

Archives are ordinary WARC/1.1 files with one gzip member a record, written to shared storage by the executors. A
task names its files by a fresh random id and reports them only when it ends, so a retried or speculative task never
harms the archive: readers open just the files in the (materialised) manifest.

Only headers are shuffled for deduplication, by payload digest and length, with a map-side maximum: a digest that a
third of all records share costs one row a task. Payloads travel once more, from archive to archive.

Defined cases: a null payload is empty; a null row id is written as an absent ``X-Row-Id`` and read as null, and such a
record never is an original of others (``max`` ignores it) unless no record of its digest has an id; repeated rows are
records of their own, and of those with the largest id the first in the archives is the response. An empty table gives
no archive and an empty result. Other input columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import partitions, scratch_path, table

#: Records with at least so many payload bytes are deduplicated.
MIN_BYTES = 1000
#: An archive file is closed once it holds so many compressed bytes.
FILE_BYTES = 256 << 20
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records long"
HEADERS = (
    "file string, position long, length long, record_no long, row_id long, uri string, date string, record_id string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to_record string"
)


def _open(path: str):
    from pyarrow import fs

    # Hadoop's names of the same store
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


class _Writer:
    """Files of gzip members; ``done`` lists (file, records)."""

    def __init__(self, folder: str) -> None:
        self.folder, self.out, self.done, self.records, self.size = folder, None, [], 0, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.file = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            filesystem, path = _open(self.file)
            filesystem.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.records, self.size = filesystem.open_output_stream(path, compression=None), 0, 0
        self.out.write(record)
        self.records, self.size = self.records + 1, self.size + len(record)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.records))
            self.out = None

    def manifest(self) -> pd.DataFrame:
        self.close()
        return pd.DataFrame(self.done, columns=["file", "records"])


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """Header values hold no line breaks or outer spaces: anything but printable ASCII is percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def write_archives(df: DataFrame, row_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """A response record for every row of ``df``, on shared storage; the manifest of files, materialised."""
    folder = scratch_path(df.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder)
        for batch in batches:
            for i, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = p or b""
                fields = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                    ("WARC-Target-URI", _uri(u)), ("WARC-Payload-Digest", _digest(body)), ("X-Payload-Length", str(len(body))),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                out.add(_record(fields + ([("X-Row-Id", str(i))] if i is not None else []), HTTP + body))
        yield pa.RecordBatch.from_pandas(out.manifest(), schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    rows = df.select(F.col(row_id).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.col(payload).cast("string").cast("binary").alias("p"))
    return table(rows.mapInArrow(write, MANIFEST), "warc-manifest").where("records > 0")


def records(file: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(position, compressed length, headers, block) of each record; only one record is in memory at a time."""
    filesystem, path = _open(file)
    with filesystem.open_input_stream(path, compression=None) as stream:
        at, left = 0, b""
        while left or (left := stream.read(1 << 20)):
            member, taken, parts = zlib.decompressobj(31), 0, []
            while True:
                parts.append(member.decompress(left))
                taken += len(left) - len(member.unused_data)
                left = member.unused_data
                if member.eof:
                    break
                if not (left := stream.read(1 << 20)):
                    raise ValueError(f"{file}: the last record is cut off")
            raw = b"".join(parts)
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{file}: no record at {at}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            size = int(fields["Content-Length"])
            if len(rest) != size + 4:
                raise ValueError(f"{file}: the record at {at} has {len(rest) - 4} bytes, not {size}")
            yield at, taken, fields, rest[:size]
            at += taken


def _header_row(file: str, at: int, taken: int, n: int, fields: dict[str, str], block: bytes) -> tuple:
    revisit = fields["WARC-Type"] == "revisit"
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("WARC-Payload-Digest") if revisit else _digest(payload)
    if not revisit and fields.get("WARC-Payload-Digest", digest) != digest:
        raise ValueError(f"{file}: the payload at {at} doesn't have the digest of its header")
    row = fields.get("X-Row-Id")
    return (file, at, taken, n, None if row is None else int(row), fields.get("WARC-Target-URI"), fields.get("WARC-Date"), fields.get("WARC-Record-ID"),
            fields["WARC-Type"], base64.b32decode(digest[5:]).hex(), int(fields.get("X-Payload-Length", 0)) if revisit else len(payload), fields.get("WARC-Refers-To"))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def read_headers(manifest: DataFrame) -> DataFrame:
    """The header of every record in the archives; payload digests and lengths are those of the payloads read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows = _arrow(HEADERS), []
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for n, (at, taken, fields, block) in enumerate(records(file)):
                    rows.append(_header_row(file, at, taken, n, fields, block))
                    if len(rows) == 2000:
                        yield _emit(rows, schema)
                        rows = []
        yield _emit(rows, schema)

    return _spread(manifest.select("file")).mapInArrow(read, HEADERS)


def _spread(files: DataFrame) -> DataFrame:
    """One partition a file, in effect: names are random, so a range of them holds few."""
    n = max(1, min(files.count(), 4 * partitions(files.sparkSession)))
    return files.repartitionByRange(n, "file")


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``headers`` with ``new_type`` and the original's ``o_*`` header fields, null unless the record revisits.

    Among responses of one payload digest and length, the one with the largest row id is the original. Records that
    are revisits in the archives already, and so have no payload, join the original of their digest in the same way.
    """
    key = F.struct(F.col("row_id"), F.col("file"), (-F.col("position")).alias("position"), F.col("record_id"), F.col("uri"), F.col("date"))
    originals = (
        headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
        .groupBy(F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")).agg(F.max(key).alias("o"), F.count(F.lit(1)).alias("n"))
    )
    met = headers.join(originals, (F.col("payload_digest") == F.col("o_digest")) & (F.col("payload_bytes") == F.col("o_bytes")), "left")
    is_original = (F.col("o.file") == F.col("file")) & (F.col("o.position") == -F.col("position"))
    revisits = F.coalesce(F.col("o").isNotNull() & ~is_original, F.lit(False)) | (F.col("record_type") == "revisit")
    return met.select(
        *headers.columns, F.when(revisits, "revisit").otherwise("response").alias("new_type"),
        *[F.when(revisits, F.col(f"o.{c}")).alias(f"o_{c}") for c in ("row_id", "record_id", "uri", "date")],
    )


def write_deduplicated(resolved: DataFrame) -> DataFrame:
    """Fresh archives: responses copied as they are, revisit records with headers that name the original. A manifest."""
    folder = scratch_path(resolved.sparkSession, "warc-dedup")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, source, filesystem, path = _Writer(folder), None, None, None
        stream = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["new_type"] == "revisit":
                    fields = [
                        ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", r["date"] or DATE),
                        ("WARC-Target-URI", r["uri"] or ""), ("WARC-Profile", PROFILE),
                        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()),
                        ("X-Payload-Length", str(r["payload_bytes"])), ("Content-Type", "application/http; msgtype=response"),
                    ]
                    if r["o_record_id"] is not None:
                        fields += [("WARC-Refers-To", r["o_record_id"]), ("WARC-Refers-To-Target-URI", r["o_uri"] or ""), ("WARC-Refers-To-Date", r["o_date"] or DATE)]
                    elif r["refers_to_record"] is not None:
                        fields.append(("WARC-Refers-To", r["refers_to_record"]))
                    out.add(_record(fields + ([("X-Row-Id", str(r["row_id"]))] if r["row_id"] is not None else []), HTTP))
                else:
                    if r["file"] != source:
                        source = r["file"]
                        filesystem, path = _open(source)
                        stream = filesystem.open_input_file(path)
                    stream.seek(r["position"])
                    out.add(stream.read(r["length"]))
        yield pa.RecordBatch.from_pandas(out.manifest(), schema=_arrow(MANIFEST))

    dealt = resolved.repartitionByRange(partitions(resolved.sparkSession), "file", "position").sortWithinPartitions("file", "position")
    return table(dealt.mapInArrow(write, MANIFEST), "warc-dedup-manifest").where("records > 0")


def deduplicate(manifest: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The manifest of deduplicated archives with the records of ``manifest``'s."""
    return write_deduplicated(resolve(table(read_headers(manifest), "warc-headers"), min_bytes))


def digests(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from archives; refers_to by record id."""
    headers = table(read_headers(manifest), "warc-read")
    originals = headers.where("record_type = 'response'").select(F.col("record_id").alias("o_id"), F.col("row_id").alias("refers_to"))
    out = headers.join(originals, F.col("refers_to_record") == F.col("o_id"), "left")
    return out.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")

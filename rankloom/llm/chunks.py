"""Documents in chunks, and exchanges between them.

A chunk is a few megabytes of rows, kept as one compressed Arrow batch in a table bucketed by chunk id. Operators that
compare texts run numpy over whole chunks and send each other small sorted packets instead of rows: a map over chunks
yields (bucket, cid, blob), a reduce sees one bucket at a time, and its replies are joined back to the chunk table by
cid. The bucketed table is never shuffled again, so texts cross the network at most once however many rounds follow.
Everything that leaves a task is a row of Spark's own shuffle or a written table, so lost executors cost recomputation
and nothing else.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textblocks as tb
from .shared import arrow_rows, partitions, scratch_path

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 4096
#: Text bytes to a bucket of an exchange.
BUCKET_BYTES = 2 << 20
#: Stands for a null id in comparisons: no id is larger.
NULL_ID = np.iinfo(np.int64).max

CHUNKS = "cid long, size long, data binary"
PACKETS = "bucket int, cid long, blob binary"
REPLIES = "cid long, blob binary"


class Chunk:
    """Rows of a chunk: ``batch`` with all columns; ids and the texts' buffer and offsets."""

    def __init__(self, cid: int, data: bytes) -> None:
        self.cid = cid
        with pa.ipc.open_stream(data) as reader:
            self._hold(reader.read_next_batch())

    def _hold(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        self.rows = self.batch.num_rows
        self.ids = self.batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
        self.buf, self.off = tb.arrow_block(self.batch.column("text"))

    def some(self, rows: np.ndarray) -> Chunk:
        """A chunk of these rows only."""
        part = Chunk.__new__(Chunk)
        part.cid = self.cid
        part._hold(self.batch.take(pa.array(rows)))
        return part


def store(docs: DataFrame, name: str = "chunks", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """The chunk table of ``docs`` (doc_id, text and any other columns), and its text bytes."""
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, rows, size
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table.to_batches()[0])
            row = pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["cid", "size", "data"])
            number, held, rows, size = number + 1, [], 0, 0
            return row

        k = None
        for batch in batches:
            k = batch.schema.get_field_index("text") if k is None else k
            _, off = tb.arrow_block(batch.column(k))
            at = 0
            while at < batch.num_rows:
                room = max(1, int(np.searchsorted(off, off[at] + chunk_bytes - size, side="right")) - 1 - at)
                take = min(room, CHUNK_ROWS - rows, batch.num_rows - at)
                held.append(batch.slice(at, take))
                rows, size, at = rows + take, size + int(off[at + take] - off[at]), at + take
                if size >= chunk_bytes or rows >= CHUNK_ROWS or at < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    made = typed.mapInArrow(run, CHUNKS)
    table = f"rankloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets, path = partitions(spark), scratch_path(spark, name)
    made.write.format("parquet").bucketBy(buckets, "cid").option("path", path).option("compression", "uncompressed").saveAsTable(table)
    chunks = spark.table(table)
    chunks.scratch, chunks.scratch_table = path, table
    return chunks, chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def bucket_count(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(64, size // bucket_bytes)


def bucket_bounds(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's slice of sorted 64-bit hashes begins, and the end: buckets are equal ranges of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def pack(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays], protocol=5)


def unpack(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, d) for d, b in pickle.loads(blob)]


def squeeze(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def over_chunks(chunks: DataFrame, fn: Callable[[Chunk, list[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` of each chunk and the replies to it, if ``chunks`` were joined with some."""
    replied = "replies" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                replies = batch.column("replies")[k].as_py() if replied else None
                made = fn(Chunk(batch.column("cid")[k].as_py(), batch.column("data")[k].as_py()), replies or [])
                if isinstance(made, pa.RecordBatch):
                    yield made
                    continue
                rows, size = [], 0
                for row in made:
                    rows.append(row)
                    size += len(row[-1]) if isinstance(row[-1], bytes) else 64
                    if size > 8 << 20:
                        yield _rows(schema, rows)
                        rows, size = [], 0
                yield _rows(schema, rows)

    return chunks.select("cid", "data", *["replies"] * replied).mapInArrow(run, schema)


def over_buckets(packets: DataFrame, fn: Callable[[int, list[int], list[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` of each bucket's packets, one bucket in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cids, blobs = None, [], []
        for batch in batches:
            for b, c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != now and blobs:
                    yield _rows(schema, list(fn(now, cids, blobs)))
                    cids, blobs = [], []
                now = b
                cids.append(c)
                blobs.append(blob)
        if blobs:
            yield _rows(schema, list(fn(now, cids, blobs)))

    return packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def with_replies(chunks: DataFrame, replies: DataFrame, how: str = "left") -> DataFrame:
    """The chunk table with an array of the replies to each chunk; only the replies are shuffled."""
    return chunks.join(replies.groupBy("cid").agg(F.collect_list("blob").alias("replies")), "cid", how)


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``buf`` one after another, and their offsets."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    take = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return buf[take], off

"""Helpers of the training-data operators: scratch tables, shards and byte-level word scans.

A *shard* is one input split of a file scan.  Operators that must ask the whole
corpus something about the contents of every shard (is this word known, does this
passage occur elsewhere) send one compact block for each (shard, key bucket), so a
hot key costs one entry a shard, however many rows hold it.
"""

from __future__ import annotations

import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a task works on (a longer document is one step).
STEP_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting (a temporary folder is then
    used): executors elsewhere could not read a folder of the driver.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if not _LOCAL:
        _LOCAL = tempfile.mkdtemp(prefix="llm-scratch-")
    return _LOCAL


_LOCAL = ""


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: the lineage ends in files that
    survive a lost executor, and what is read later is the same on every attempt."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}"
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own setting that deletes a job's shuffle files when the job is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Write ``df``; the shuffle files of the job go when it is done, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` such that every pass sees the same rows in the same splits and order: anything but a
    projection of a file scan is written and read again first."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m.group(1) for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*([A-Za-z]+)", line))}
    return docs if nodes <= {"Relation", "Project", "LogicalRelation"} else cut(docs)


def with_shard(docs: DataFrame) -> DataFrame:
    """Add ``shard``, the number of the input split, the same in every pass."""
    return stable(docs).withColumn("shard", F.spark_partition_id())


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """Add a number for each row, the same in every pass: it is written, as each job plans its splits anew."""
    return cut(docs.withColumn(name, F.monotonically_increasing_id()))


def buckets(spark: SparkSession, each: int = 4) -> int:
    """Key buckets of an exchange: several for each shuffle partition, so that they spread evenly."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*parts, level: int = 0) -> bytes:
    raw = pickle.dumps(parts, protocol=5)
    return b"z" + zstandard.ZstdCompressor(level=level).compress(raw) if level else b"r" + raw


def unpack(blob) -> tuple:
    view = memoryview(blob)
    return pickle.loads(zstandard.ZstdDecompressor().decompress(view[1:]) if view[0] == 0x7A else view[1:])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in a row, and each row's offsets in them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` bytes of text, or of one longer document."""
    for b in batches:
        n, k = b.num_rows, 0
        if not n:
            continue
        _, off = utf8(b.column(text))
        while k < n:
            end = max(k + 1, int(np.searchsorted(off, off[k] + size, side="right")) - 1)
            yield b.slice(k, end - k)
            k = end


def joined(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 16 * STEP_BYTES) -> Iterator[pa.Table]:
    """Batches put together to blocks of about ``size`` bytes of text."""
    held, n = [], 0
    for b in steps(batches, text, size):
        held.append(b)
        n += b.column(text).nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; every byte of a code point over 127 is in.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        m = max(n, STEP_BYTES + 1)
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _POW[:] = [np.concatenate(([np.uint64(1)], np.full(m, x, np.uint64))).cumprod(dtype=np.uint64) for x in (_STEP, inverse)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word: a run of bytes of the class ``inside``, cut at documents' ends."""
    n = len(buf)
    if not n:
        return (np.empty(0, np.int64),) * 3
    w = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    np.logical_and(w[:-1], ~edge[1:n], out=before[1:])
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    np.logical_and(w[1:], ~edge[1:n], out=after[:-1])
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes in every shard."""
    p, ip = _powers(len(buf))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:len(buf)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * ip[starts] + (ends - starts).astype(np.uint64) * _STEP)


def crc_mod(doc_id, modulus: int):
    """crc32 of a document's id as text, by ``modulus``; null where the id is null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def grouped_sums(order: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct keys in order, and the sum of each of ``values`` over equal keys."""
    if not len(order):
        return (order, *values)
    at = np.argsort(order, kind="stable")
    k = order[at]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return (k[first], *(np.add.reduceat(v[at], first) for v in values))


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as (shard, payload) rows, compressed: the cheapest way to bring texts to what was found out about their shard.

    Arrow's stream format writes the rows of a slice only; a pickled slice would hold its whole parent."""
    for b in steps(batches):
        shard, own = b.column("shard")[0].as_py(), b.drop_columns(["shard"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(own)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "payload"])


def unblob(blob) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def by_bucket(shard: int, bucket: np.ndarray, count: int, *columns: np.ndarray) -> pa.RecordBatch:
    """(bucket, shard, payload) rows of columns that are ordered by bucket; narrow types where the values allow."""
    edges = np.searchsorted(bucket, np.arange(count + 1))
    own = [k for k in range(count) if edges[k] < edges[k + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array(own, pa.int32()), pa.array([shard] * len(own), pa.int32()),
        pa.array([pack(*(narrow(c[edges[k]:edges[k + 1]]) for c in columns)) for k in own], pa.binary())], ["bucket", "shard", "payload"])


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    if x.dtype.kind == "i" and len(x) and x.min() >= 0:
        for kind in (np.uint8, np.uint16, np.uint32):
            if x.max() <= np.iinfo(kind).max:
                return x.astype(kind)
    return x


def top_bits(h: np.ndarray, count: int) -> np.ndarray:
    """The bucket of a hash: ascending with it, so that a sorted column is ordered by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def payloads(table: pa.Table) -> Iterator[tuple]:
    """The unpacked payloads of a group, one at a time."""
    for x in table.column("payload"):
        yield unpack(x.as_buffer())


def release() -> None:
    """Give freed memory back: workers are used again by later stages and would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
EXCHANGE = "bucket int, shard int, payload binary"
REPLY = "shard int, payload binary"


def replies(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

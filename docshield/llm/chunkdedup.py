"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over each text's UTF-8 bytes; a chunk ends where the hash's high
bits are zero, so boundaries depend on the last 32 bytes only and fall in the same places
again after an insertion.  Chunks have 16 to 1024 bytes, about 64 on average.  Of all
chunks with one 128-bit digest the first, by doc_id and place, stays; the others are
removed.

Defined cases: a null or empty text has no chunks; rows without a doc_id come after all
others in the order; rows that share a doc_id are told apart by their place in the input;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield.llm.common import cut, mix, steps, utf8, with_row

LEAST, MOST, BITS = 16, 1024, 6
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 32 bytes' gears, each shifted by its distance (32 bits)."""
    h = GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunk_ends(buf: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Where the chunks of one document end."""
    if not len(buf):
        return []
    ends, start = [], 0
    for c in (np.flatnonzero(gear(buf) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - start > most:
            start += most
            ends.append(start)
        if c - start >= least:
            ends.append(c)
            start = c
    while len(buf) - start > most:
        start += most
        ends.append(start)
    if start < len(buf):
        ends.append(len(buf))
    return ends


def _chunks(batches):
    for b in steps(batches):
        buf, off = utf8(b.column("text"))
        raw, ends, rows, digests = buf.tobytes(), [], [], []
        for k in range(b.num_rows):
            own, a = chunk_ends(buf[off[k]:off[k + 1]]), int(off[k])
            start = a
            for e in own:
                digests.append(hashlib.blake2b(raw[start:a + e], digest_size=16).digest())
                start = a + e
            ends += own
            rows.append(len(own))
        two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(b.num_rows), rows)
        ends = np.array(ends, np.int64)
        begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        begin[np.concatenate(([True], row[1:] != row[:-1])) if len(row) else []] = 0
        for at in range(0, max(1, len(row)), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[part])), b.column("row").take(pa.array(row[part])), pa.array(begin[part]), pa.array(ends[part] - begin[part]), pa.array(two[part, 0]), pa.array(two[part, 1])], ["doc_id", "row", "start", "length", "h1", "h2"])


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: doc_id, row, start, length (bytes), h1, h2 (digest), and ``removed``.  ``docs`` has doc_id, row and text."""
    found = cut(docs.select("doc_id", "row", "text").mapInArrow(_chunks, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, start long, length long, h1 long, h2 long"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "start")
    first = found.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return found.join(first, ["h1", "h2"], "left").withColumn("removed", F.coalesce(F.col("first") != order, F.lit(False))).drop("first")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chunks, n_removed_chunks, n_removed (bytes) and ``spans`` (removed runs of bytes, merged)."""
    docs = with_row(docs.select("doc_id", "text"))
    own = chunks(docs).groupBy("row").agg(
        F.count("*").alias("n_chunks"), F.count_if("removed").alias("n_removed_chunks"), F.coalesce(F.sum(F.when(F.col("removed"), F.col("length"))), F.lit(0)).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("cuts"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    # runs that touch are one: keep the starts that are no end, and the ends that are no start
    starts, ends = F.transform("cuts", lambda x: x["start"]), F.transform("cuts", lambda x: x["end"])
    spans = F.coalesce(F.arrays_zip(F.array_sort(F.array_except(starts, ends)).alias("start"), F.array_sort(F.array_except(ends, starts)).alias("end")), F.array())
    return docs.select("doc_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).join(own, "row", "left").select(
        "doc_id", "n_bytes", zero("n_chunks"), zero("n_removed_chunks"), zero("n_removed"), spans.cast("array<struct<start:long,end:long>>").alias("spans"))

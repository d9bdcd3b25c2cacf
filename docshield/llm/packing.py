"""Packing by minimum bin slack.

Every document is tokenized, an end id is appended, and it is cut at multiples of the
window.  Full windows are sequences of their own; the remainders are packed by minimum
bin slack: starting from the longest remainder left, a bitset subset-sum dynamic program
over the histogram of remainder lengths finds the multiset that fills the window closest
to its capacity, its counts are backtracked, and that multiset is repeated as often as
the histogram allows.  The histogram has window - 1 entries at any input size, so the
plan is made on the driver; pieces find their place in it by their rank among the pieces
of their length, which two-phase counting gives without putting a length in one task.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept as null;
repeated rows are packed once each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield.llm.common import cut, steps

WINDOW = 2048
END_ID = 1
#: The vocabulary's own split pattern, with possessive repeats so that long runs don't backtrack.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict = {}


def encoder(path: str):
    """An encoder for the byte-level BPE file at ``path`` (a ``tokenizers`` JSON): its ranks are the
    merged ids themselves, so the encoding is that of ``tokenizers``, several times faster."""
    if path not in _ENCODERS:
        import json

        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


#: White space that the fast encoder's matcher may have to go back over; it gives up on runs of about a million.
LONG_SPACE = 200_000
_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")  # begins at a run only, so the search is linear


def _whole(path: str):
    key = ("tokenizers", path)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer
        _ENCODERS[key] = Tokenizer.from_file(path)
    return _ENCODERS[key]


def token_ids(text: str | None, path: str, end_id: int | None = END_ID) -> np.ndarray:
    """A text's ids.  A text with a very long run of white space is encoded by ``tokenizers`` itself, which has no such limit."""
    if not text:
        ids = []
    elif len(text) >= LONG_SPACE and _SPACE.search(text):
        ids = _whole(path).encode(text, add_special_tokens=False).ids
    else:
        ids = encoder(path).encode(text, allowed_special="all")
    return np.array([*ids, end_id] if end_id is not None else ids, dtype="<u4")


def _pieces(path: str, window: int):
    def run(batches):
        for b in steps(batches):
            ids, out = b.column("doc_id"), []
            for k, text in enumerate(b.column("text").to_pylist()):
                t = token_ids(text, path)
                for start in range(0, len(t), window):
                    piece = t[start:start + window]
                    out.append((k, start, len(piece), zlib.crc32(piece.tobytes()), len(t)))
            row, *cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(c) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of lengths: [(bins, [(length, pieces in each bin)])]."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    while left:
        largest = max(left)
        room = window - largest
        reach, made = 1, []  # reach: bit s is set if some multiset sums up to s; made: (length, copies, reach before)
        full = 1 << room
        for n in sorted(left, reverse=True):
            have = min(left[n] - (n == largest), room // n)
            step = 1
            while have > 0 and not reach & full:
                take = min(step, have)
                made.append((n, take, reach))
                reach = (reach | reach << n * take) & (2 * full - 1)
                have -= take
                step *= 2
            if reach & full:
                break
        rest = reach.bit_length() - 1
        used = {largest: 1}
        for n, take, before in reversed(made):
            if not before >> rest & 1:
                used[n] = used.get(n, 0) + take
                rest -= n * take
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


def _placer(table: np.ndarray):
    """table: rows (length, first rank, sequence, in each bin, offset), by length and first rank."""
    key = table[:, 0] << 40 | table[:, 1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = table[np.searchsorted(key, n << 40 | rank, side="right") - 1]
            k = rank - at[:, 1]
            out = b.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(at[:, 2] + k // at[:, 3])).append_column("offset", pa.array(at[:, 4] + k % at[:, 3] * n))
    return run


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = dict(docs.dtypes)["doc_id"]
    pieces = cut(docs.select("doc_id", "text").mapInArrow(_pieces(path or vocabulary_path(), window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumn("part", F.spark_partition_id()))  # written: each job plans its splits anew
    held = cut(pieces.groupBy("part", "length").count())  # at most window rows for each split
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most window rows
    rows, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    whole = histogram.pop(window, 0)
    for times, bin_ in [*([(whole, [(window, 1)])] if whole else []), *plan(histogram, window)]:
        offset = 0
        for n, k in bin_:
            rows.append((n, used[n], sequence, k, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(first, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(table), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

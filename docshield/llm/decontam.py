"""Benchmark decontamination with an FM-index per shard.

Test phrases are all windows of ten consecutive words of the benchmark items (an item of
fewer words is one window).  Each block of a training shard gets an FM-index over its
words: a suffix array gives the Burrows-Wheeler transform, a wavelet matrix answers rank
queries on it, and every 16th suffix position is kept.  All phrases are searched backwards
at once; each occurrence is walked to a kept position, and overlapping occurrences are
merged to removal spans.

The index's alphabet is the benchmark's vocabulary.  A word outside it can't lie in an
occurrence, so it only ends a run of words, and runs shorter than the shortest phrase,
which can't hold one either, are left out: the index finds the same occurrences as one
over all words, at a fraction of its size.

The benchmark is read in blocks of a bounded size (``BLOCK_BYTES``), each searched in all
shards, so what tasks receive is bounded whatever the benchmark's size.

Defined cases: a null or empty text has no words; an item without words or without an id
is no item; items that share an id count once; a null doc_id is kept as null; repeated
rows are judged alike; an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docshield.llm.common import ALNUM, LOWER, joined, spans, steps, utf8, with_row, word_hash

WIDTH = 10
BLOCK_BYTES = 32 << 20
SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``seq`` ends in a symbol smaller than all others."""
    n = len(seq)
    rank, k = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        own = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2


class FMIndex:
    """``seq``: symbols from 1 to ``sigma`` - 1."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.concatenate((seq, [0])).astype(np.int64)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.levels = []  # of the wavelet matrix, from the highest bit: (bit, zeros, ones before each place)
        now = self.bwt
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            self.levels.append((bit, int((~one).sum()), np.concatenate(([0], np.cumsum(one))).astype(np.int32)))
            now = np.concatenate((now[~one], now[one]))
        self.kept = sa % SAMPLE == 0
        self.place = np.where(self.kept, sa, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before ``at``."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for bit, zeros, ones in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low1, high1 = ones[low], ones[high]
            low, high = np.where(one, zeros + low1, low - low1), np.where(one, zeros + high1, high - high1)
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, filled up on the right): the rows of the suffixes that start with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            go = np.flatnonzero((step < lengths) & (low < high))
            symbol = phrases[go, lengths[go] - 1 - step]
            low[go] = self.before[symbol] + self.rank(symbol, low[go])
            high[go] = self.before[symbol] + self.rank(symbol, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk to the next kept one."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        go = np.flatnonzero(~self.kept[rows])
        while len(go):
            symbol = self.bwt[rows[go]]
            rows[go] = self.before[symbol] + self.rank(symbol, rows[go])
            walked[go] += 1
            go = go[~self.kept[rows[go]]]
        return self.place[rows] + walked


def _hashes(texts: list[str]) -> list[np.ndarray]:
    buf, off = utf8(pa.array(texts, pa.string()))
    buf = LOWER[buf]
    s, e, d = spans(buf, off, ALNUM)
    h = word_hash(buf, s, e)
    return [h[d == k] for k in range(len(texts))]


def phrases(items: list[tuple], width: int = WIDTH):
    """(vocabulary: sorted hashes; phrases as symbols from 2, filled up with 0; lengths; item ids of each phrase)."""
    owners: dict[tuple, set] = defaultdict(set)
    for (item, _), h in zip(items, _hashes([t or "" for _, t in items]), strict=True):
        for k in range(max(1, len(h) - width + 1)) if len(h) and item is not None else ():
            owners[tuple(h[k:k + width].tolist())].add(str(item))
    vocabulary = np.unique(np.array([x for p in owners for x in p], np.uint64))
    lengths = np.array([len(p) for p in owners], np.int64)
    symbols = np.zeros((len(owners), width), np.int64)
    for k, p in enumerate(owners):
        symbols[k, :len(p)] = np.searchsorted(vocabulary, np.array(p, np.uint64)) + 2
    return vocabulary, symbols, lengths, [sorted(x) for x in owners.values()]


def _scan(vocabulary, symbols, lengths, owners, carry):
    names = [*carry, "n_words", "spans", "items"]
    shortest = int(lengths.min(initial=WIDTH))
    bits = max(10, int(len(vocabulary) * 16).bit_length())
    maybe = np.zeros(1 << bits, bool)
    low = np.uint64((1 << bits) - 1)
    maybe[(vocabulary & low).astype(np.int64)] = True

    def runs(table):
        """Words in runs of the vocabulary: symbol (1: between runs), document, number and bytes in the document; and all documents' word counts."""
        parts, counts, base = [], [], 0
        for b in steps(table.to_batches()):
            buf, off = utf8(b.column("text"))
            buf = LOWER[buf]
            s, e, d = spans(buf, off, ALNUM)
            counts.append(np.bincount(d, minlength=b.num_rows))
            nth = np.arange(len(s)) - np.searchsorted(d, d)
            h = word_hash(buf, s, e)
            at = np.flatnonzero(maybe[(h & low).astype(np.int64)])
            k = np.searchsorted(vocabulary, h[at])
            real = vocabulary[np.minimum(k, len(vocabulary) - 1)] == h[at] if len(vocabulary) else np.zeros(len(at), bool)
            at, k = at[real], k[real]
            if len(at):
                new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(d[at]) != 0)))
                size = np.diff(np.append(np.flatnonzero(new), len(at)))
                keep = np.repeat(size >= shortest, size)
                at, k, new = at[keep], k[keep], new[keep]
            if len(at):
                place = np.arange(len(at)) + np.cumsum(new)
                part = np.zeros((5, place[-1] + 1), np.int64)
                part[0] = 1
                part[:, place] = k + 2, d[at] + base, nth[at], s[at] - off[d[at]], e[at] - off[d[at]]
                parts.append(part)
            base += b.num_rows
        return np.concatenate(parts, 1) if parts else np.zeros((5, 0), np.int64), np.concatenate(counts) if counts else np.empty(0, np.int64)

    def run(batches):
        for table in joined(batches):
            words, counts = runs(table)
            found, items = [[] for _ in counts], [() for _ in counts]
            if words.shape[1]:
                index = FMIndex(words[0], len(vocabulary) + 2)
                lo, hi = index.search(symbols, lengths)
                which = np.repeat(np.arange(len(lo)), hi - lo)
                rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
                at = index.locate(rows)
                cover = np.zeros(words.shape[1] + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + lengths[which], -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                if len(hit):
                    doc, nth = words[1, hit], words[2, hit]
                    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(nth) != 1)))
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(hit)) - 1
                    for d, a, z, s, n in zip(doc[first].tolist(), words[3, hit[first]].tolist(), words[4, hit[last]].tolist(), nth[first].tolist(), (nth[last] - nth[first] + 1).tolist(), strict=True):
                        found[d].append({"start": a, "end": z, "word": s, "words": n})
                    pairs = np.unique(words[1, at] * len(lo) + which)
                    for d, p in zip((pairs // len(lo)).tolist(), (pairs % len(lo)).tolist(), strict=True):
                        items[d] = {*items[d], *owners[p]}
            cols = [table.column(c).combine_chunks() for c in carry] + [pa.array(counts), pa.array(found, SPANS_ARROW), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            for b in pa.Table.from_arrays(cols, names).to_batches(max_chunksize=2000):
                yield b
    return run


SPANS = "array<struct<start:long,end:long,word:long,words:long>>"
SPANS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "word", "words")]))


def _merged(found: list[list[dict]]) -> list[dict]:
    out: list[dict] = []
    for x in sorted((x for f in found for x in f), key=lambda x: x["word"]):
        if out and x["word"] <= out[-1]["word"] + out[-1]["words"]:
            y = out[-1]
            y["words"] = max(y["words"], x["word"] + x["words"] - y["word"])
            y["end"] = max(y["end"], x["end"])
        else:
            out.append(x.asDict())
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` and, per document: n_words, spans (merged; bytes and words), items (ids, sorted as strings), n_hit, n_items, items_sha256, contaminated."""
    bench = benchmark.select(F.col("item_id"), F.col("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    docs = docs.select(*dict.fromkeys([*carry, "text"]))
    if blocks > 1:
        docs = with_row(docs, "_row")
    kept = [*carry] if blocks == 1 else [*carry, "_row"]
    schema = T.StructType([docs.schema[c] for c in kept]).simpleString()[len("struct<"):-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)) if schema else ""
    out = None
    for k in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)) == k)
        one = docs.mapInArrow(_scan(*phrases([(r[0], r[1]) for r in own.collect()], width), kept), f"{fields}, n_words long, spans {SPANS}, items array<string>")
        out = one if out is None else out.unionByName(one)
    if blocks > 1:
        merge = F.udf(_merged, SPANS)
        out = out.groupBy("_row").agg(*(F.first(c).alias(c) for c in carry), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        out = out.select(*carry, "n_words", merge("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    return out.withColumns({
        "n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]), "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.size("spans") > 0})


def _without(batches):
    for b in batches:
        out = []
        for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            if found:
                raw, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
                for x in found:
                    parts.append(raw[at:x["start"]])
                    at = x["end"]
                text = b"".join([*parts, raw[at:]]).decode("utf-8")
            out.append(text)
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with all removal spans cut out of ``text``; other columns as they are (``n_chars`` follows the text).
    Input columns may have any name, this module's own included.  Null and empty texts stay; repeated rows stay, each for itself."""
    names = docs.columns
    inner = ["text" if n == "text" else f"_c{k}" for k, n in enumerate(names)]
    found = contamination(docs.toDF(*inner), benchmark, tuple(inner)).select(*inner, "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    out = found.mapInArrow(_without, fields).select(*inner).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out

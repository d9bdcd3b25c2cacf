"""Near-duplicate detection with Order MinHash.

A document is the sequence of its five-word shingles, each labelled with its occurrence
number in the document.  One sketch takes the two labelled shingles with the smallest
seeded hashes *in text order*; documents that agree on any of 16 sketches are candidates.
A candidate pair is verified by a banded alignment of the labelled shingles: with m
matches on an increasing chain inside the band that similarity 0.8 leaves room for, the
similarity is m / (n1 + n2 - m), and 0.8 or more is a link.  Classes are the connected
components of the links.

Exact copies collapse to the smallest doc_id before sketching.  Inside a bucket every
member is first compared with the bucket's smallest member and with the one that shares
most buckets (stars).  Where this leaves a bucket in two or more components, every pair of
its members from different components is tried, in cells of bounded size, until links
found on the way have joined them.  So the components are those of all candidate pairs.
At similarity 0.8 one sketch agrees with probability 0.64 or so, none of 16 with 1e-7.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words is one
shingle; a null, empty or blank text is never a near copy of another (each is its own
class, exact copies of a non-null text excepted); repeated rows and rows that share a
doc_id are one document; rows without a doc_id are not judged and not returned.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield.llm.common import SPACED, cut, mix, spans, steps, utf8, word_hash

SHINGLE = 5
SKETCHES = 16
SIMILARITY = 0.8
CELL = 1024  # members of a block of a bucket that is settled pair by pair
CELL_BYTES = 16 << 20  # and their texts
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of a document, in text order; all are distinct."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        h = mix(h * np.uint64(31) + words[k:k + n] + np.uint64(k))
    at = np.argsort(h, kind="stable")
    own = h[at]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    if not new.all():
        place = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[at] = place - np.maximum.accumulate(np.where(new, place, 0))
        h = np.where(nth > 0, mix(h + nth * np.uint64(0xD6E8FEB86659FD93)), h)
    return h


def sketches(shingles: np.ndarray) -> np.ndarray:
    """Order MinHash: for each seed the two smallest shingles, in text order, as one hash."""
    if len(shingles) == 1:
        return mix(shingles[0] ^ _SEEDS)
    h = shingles[None, :] ^ _SEEDS[:, None]
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    two = np.argpartition(h, 1, axis=1)[:, :2] if len(shingles) > 2 else np.tile([0, 1], (len(_SEEDS), 1))
    two.sort(axis=1)
    return mix(shingles[two[:, 0]] * np.uint64(31) + mix(shingles[two[:, 1]]) + _SEEDS)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity by banded alignment, exact where it is ``least`` or more (else 0 or more, but below it)."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least * (n + m) / (1 + least)
    if len(i) < need - 1e-9:
        return 0.0
    band = n + m - 2 * need  # an alignment with ``need`` matches leaves so many shingles unmatched
    inside = np.abs(i - j) <= band + 1e-9
    j = j[inside][np.argsort(i[inside])]
    if len(j) and (np.diff(j) > 0).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        chain = len(tails)
    return chain / (n + m - chain)


def _shingled(col):
    buf, off = utf8(col)
    s, e, d = spans(buf, off, SPACED)
    h = word_hash(buf, s, e)
    at = np.searchsorted(d, np.arange(len(col) + 1))
    return [labelled(h[at[k]:at[k + 1]]) for k in range(len(col))]


def _sketch(batches):
    for b in steps(batches):
        found = _shingled(b.column("text"))
        full = [k for k, x in enumerate(found) if len(x)]
        keys = np.stack([sketches(found[k]) for k in full]).view(np.int64) if full else np.empty((0, SKETCHES), np.int64)
        keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), SKETCHES).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(full, pa.int64())), keys], ["id", "keys"])


def _verify(batches):
    for b in steps(batches, "text_a"):
        left, right = _shingled(b.column("text_a")), _shingled(b.column("text_b"))
        sim = np.array([similarity(x, y) for x, y in zip(left, right, strict=True)], float)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], ["a", "b", "similarity"])


def _members(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (id, sketch, key) in buckets of two or more, with the bucket's size ``n`` and smallest id ``least``."""
    size = keyed.groupBy("sketch", "key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return keyed.join(size, ["sketch", "key"])


def _stars(members: DataFrame) -> DataFrame:
    """(a, b), a < b: each member of a bucket with the bucket's smallest one and with the one that shares most buckets."""
    weight = members.groupBy("id").agg(F.sum("n").alias("w"))
    hub = members.join(weight, "id").groupBy("sketch", "key").agg(F.min(F.struct((-F.col("w")).alias("w"), "id"))["id"].alias("hub"))
    pairs = members.select("id", F.col("least").alias("other")).unionByName(members.join(hub, ["sketch", "key"]).select("id", F.col("hub").alias("other")))
    return pairs.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _cell(batches):
    """Links that join components inside each cell of a bucket; rows of a cell come together."""
    cell, held = None, []

    def settle():
        sketch, _, low, high = cell
        ids = np.array([r["id"] for r in held], np.int64)
        component = np.array([r["label"] for r in held], np.int64)
        own = np.array([r["own"] for r in held])
        keys = np.array([r["keys"] for r in held], np.int64)
        shingles = _shingled(pa.array([r["text"] for r in held]))
        size = np.array([len(x) for x in shingles])
        found = []
        for i in range(len(held)):
            if low != high and own[i] != low:
                continue
            open_ = component != component[i]
            if low == high:
                open_[:i + 1] = False
            else:
                open_ &= own == high
            open_ &= np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i]) - 1e-9
            open_ &= ~(keys[:, :sketch] == keys[i, :sketch]).any(axis=1)  # a pair is tried in the first bucket it shares
            for j in np.flatnonzero(open_):
                if component[j] != component[i] and (sim := similarity(shingles[i], shingles[j])) >= SIMILARITY:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j]), sim))
                    component[component == component[j]] = component[i]
        a, b, sim = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    for batch in batches:
        for r in batch.to_pylist():
            at = (r["sketch"], r["key"], r["low"], r["high"])
            if at != cell:
                if held:
                    yield settle()
                cell, held = at, []
            held.append(r)
    if held:
        yield settle()


def _settled(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b, similarity) that join what the stars left apart: in each bucket of ``named`` (sketch, key, id, label) every pair of members from
    different components is tried, unless links found on the way have joined them.  ``texts`` has id, text, keys.

    A bucket's members are dealt to blocks of bounded number and size, and each pair of blocks is a cell, so a large bucket is spread over
    many tasks and no row is made for a pair that is only tried."""
    sized = named.join(texts.select("id", F.octet_length("text").alias("bytes")), "id")
    blocks = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("bytes") / CELL_BYTES)).cast("int")
    many = sized.groupBy("sketch", "key").agg(blocks.alias("blocks"))
    dealt = named.join(many, ["sketch", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("sketch", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "label", "own").join(texts, "id")
    order = ["sketch", "key", "low", "high"]
    return cut(cells.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(_cell, "a long, b long, similarity double"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): each id that has a link, with the smallest id of its component.

    Alternating large-star and small-star steps; each hooks every id to the smallest
    neighbour it can see, so the number of rounds grows with the logarithm of the
    longest chain.  Edges stay in tables, never on the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = cut(small)
        # settled when no id that others hang on hangs on another itself, and each has one parent
        loose = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or new.alias("x").join(new.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1).count()
        edges = new
        if not loose:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def links(texts: DataFrame) -> DataFrame:
    """Verified pairs (a, b, similarity) of ``texts`` (id, text: distinct), enough to join all candidate pairs' components."""
    sketched = cut(texts.mapInArrow(_sketch, "id long, keys array<long>"))
    members = cut(_members(sketched.select("id", F.posexplode("keys").alias("sketch", "key"))))
    pairs = cut(_stars(members))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    held = cut(texts.join(ids.hint("merge"), "id", "left_semi"))

    def verified(p):
        p = p.join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return cut(p.mapInArrow(_verify, "a long, b long, similarity double"))

    linked = verified(pairs).where(F.col("similarity") >= SIMILARITY)
    # buckets that the stars left in several components: their members' other pairs are settled without loss
    label = components(linked)
    named = members.select("id", "sketch", "key").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    open_ = named.groupBy("sketch", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sketch", "key")
    left = cut(named.join(open_, ["sketch", "key"], "left_semi"))
    if left.isEmpty():
        return linked
    ids = left.select("id").distinct()
    texts = cut(held.join(ids, "id", "left_semi").join(sketched, "id"))
    return linked.unionByName(_settled(left, texts))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, is_copy (an exact copy of a smaller doc_id), and ``keep`` (one of each class)."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a digest stands for the text: exact copies have it in common.  A null text is a class of its own.
    digest = F.when(F.col("text").isNotNull(), F.unhex(F.sha2(F.col("text"), 256))).otherwise(F.concat(F.lit("null").cast("binary"), F.col("doc_id").cast("string").cast("binary")))
    member = cut(docs.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("digest")))
    first = member.groupBy("digest").agg(F.min("doc_id").alias("id"))
    copies = cut(member.join(first, "digest").select("doc_id", "id"))
    others = copies.where("doc_id <> id").select("doc_id").distinct()
    texts = docs.join(others.hint("merge"), "doc_id", "left_anti").where("text IS NOT NULL").withColumnRenamed("doc_id", "id")
    label = components(links(texts))
    out = copies.join(label, "id", "left").select("doc_id", F.coalesce("label", "id").alias("class_id"), (F.col("doc_id") != F.col("id")).alias("is_copy"))
    size = out.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return out.join(size, "class_id").select("doc_id", "class_id", "class_size", "is_copy", (F.col("doc_id") == F.col("class_id")).alias("keep"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the near copies: of each class the smallest doc_id stays.  Rows without a doc_id stay as they are."""
    gone = classes(docs).where("NOT keep").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")  # both sides grow with the corpus


"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and an end symbol.  The root is the corpus's smoothed word
distribution; deeper states are contexts of one and two previous words.  A context stays
in the tree if its next symbols diverge from those of the context one word shorter: two
of its successors agree significantly more often (collision test, three sigma) than two
draws from the shorter context would.  Its distribution has the successors seen twice or
more, discounted by 0.75; what is left over goes to the shorter context.  A text is
scored with, at each symbol, the longest suffix of its past that is a state.

Everything is counted over all training rows.  Counts of words and of successors come
together by key from all shards, each shard having summed up its own first; the answers go
back to the shards that asked, as columns in the order asked, and each shard scores its texts.  A shard is a piece of a
split of about ``SHARD_BYTES`` of text, so what a task holds does not grow with the splits.  Contexts that hold more
than a quarter of a bucket's share of all symbols are dealt out by successor instead, so no task gets
a frequent word's whole neighbourhood.

Defined cases: a null or empty text is the end symbol alone; a row without a doc_id is
training and is scored; with no training rows every symbol has the unseen probability;
repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield.llm.common import (EXCHANGE, LOWER, REPLY, SPACED, blobs, buckets, by_bucket, cut, grouped_sums, lookup, mix, narrow, pack, payloads, release, replies,
                                  spans, steps, top_bits, unblob, unpack, utf8, with_shard, word_hash)

DISCOUNT = 0.75
SUPPORT = 2  # a successor is kept from so many occurrences
GROW = 4  # a context may grow by a word from so many occurrences
SIGMAS = 3.0
DEPTH = 2
#: Bytes of text of a shard (a longer document is in one), and the shards of a split, at most; the last one takes the rest.
SHARD_BYTES = 12 << 20
SPLIT_SHARDS = 1024
#: Words or pairs that a bucket names as its most frequent; all buckets have as many heavy ones as four times their number at most.
MOST = 128
END = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0x2545F4914F6CDD1D)


def pack0(*columns: np.ndarray) -> bytes:
    return pack(*map(narrow, columns))


def answer(bucket: int, *columns: np.ndarray) -> bytes:
    """A reply to one shard and bucket: columns in the order of what was asked, mostly zeros and small numbers."""
    return pack(bucket, *map(narrow, columns), level=1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K + b)


def symbols(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols (each text's words, then its end) as hashes, and each one's document."""
    buf, off = utf8(texts)
    buf = LOWER[buf]
    s, e, d = spans(buf, off, SPACED)
    n = len(off) - 1
    out, doc = np.full(len(s) + n, END, np.uint64), np.empty(len(s) + n, np.int64)
    at = np.arange(len(s)) + d
    out[at] = word_hash(buf, s, e)
    ends = np.bincount(d, minlength=n).cumsum() + np.arange(n)
    doc[at], doc[ends] = d, np.arange(n)
    return out, doc


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a split with the numbers of their shards instead of the split's.  A row's shard follows from the bytes of
    text before it, so every pass deals the same rows to it, however they come in batches."""
    before = 0
    for b in steps(batches):
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = before + np.cumsum(size)
        piece = np.minimum((end - size) // SHARD_BYTES, SPLIT_SHARDS - 1)
        before, place = int(end[-1]), b.schema.get_field_index("shard")
        shard = pa.array(b.column("shard").to_numpy().astype(np.int64) * SPLIT_SHARDS + piece, pa.int32())
        b = b.set_column(place, "shard", shard)
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for lo, hi in zip(edges, edges[1:]):
            yield b.slice(lo, hi - lo)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    """The shards of a split, one at a time."""
    for _, own in groupby(_numbered(batches), lambda b: b.column("shard")[0].as_py()):
        yield _Shard(own)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return blobs(_numbered(batches))


class _Shard:
    """A shard's symbols as numbers: ``hash`` has its distinct symbols in order, ``word`` the place of each symbol there.

    Everything said about a shard's words, pairs and triples is a column in the order of the distinct ones, which is the
    same in every pass; so answers need no keys."""

    def __init__(self, batches):
        held, self.batches, self.id = [], [], None
        for b in batches:
            if "shard" in b.schema.names:
                self.id = b.column("shard")[0].as_py()
            sym, doc = symbols(b.column("text"))
            held.append((sym, np.bincount(doc, minlength=b.num_rows)))
            self.batches.append(b.drop_columns(["text"]))
        join = lambda k, kind: np.concatenate([np.empty(0, kind), *(h[k] for h in held)])
        sym, self.size = join(0, np.uint64), join(1, np.int64)
        del held
        self.hash, self.word = _distinct(sym)
        del sym
        learn = np.concatenate([np.empty(0, bool), *(~b.column("held_out").to_numpy(zero_copy_only=False) for b in self.batches)])
        self.learn = np.repeat(learn, self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.past = np.full(len(self.word), 2, np.uint8)  # symbols of the text before each one, 2 at most
        self.past[self.begin] = 0
        second = self.begin + 1
        self.past[second[self.size > 1]] = 1
        release()

    def counts(self, inverse: np.ndarray, at, size: int) -> np.ndarray:
        return np.bincount(inverse[self.learn[at]], minlength=size)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value in them."""
    at = np.argsort(x)
    x = x[at]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    which = np.cumsum(new, dtype=np.int32)
    which -= 1
    x = x[new]
    place = np.empty(len(at), np.int32)
    place[at] = which
    return x, place


class _Entries:
    """The distinct (context, next symbol) entries of one depth in a shard, dealt out to buckets."""

    def __init__(self, shard: _Shard, at: np.ndarray, before: np.ndarray, names, heavy: np.ndarray, count: int):
        """``at``: the symbols looked at; ``before``: the number of each one's context; names: their hashes, by number."""
        key = before.astype(np.uint64)
        key <<= np.uint64(32)
        key |= shard.word[at].astype(np.uint64)
        key, self.inverse = _distinct(key)
        self.at = at
        release()
        self.n = shard.counts(self.inverse, at, len(key))
        ctx, sym = names((key >> np.uint64(32)).astype(np.int64)), shard.hash[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        bucket = top_bits(ctx, count).astype(np.int32)
        big = lookup(heavy, ctx)[1]
        bucket[big] = top_bits(pair(ctx[big], sym[big]), count)
        del big
        self.order = np.argsort(bucket, kind="stable")  # in a bucket, entries of a context are neighbours
        bucket, self.ctx, self.sym = bucket[self.order], ctx[self.order], sym[self.order]
        self.key = key
        new = np.ones(len(key), bool)
        new[1:] = (self.ctx[1:] != self.ctx[:-1]) | (bucket[1:] != bucket[:-1])
        self.first = np.flatnonzero(new)
        self.edges = np.searchsorted(bucket, np.arange(count + 1))
        self.runs = np.searchsorted(self.first, self.edges)
        self.run = np.empty(len(key), np.int32)
        self.run[self.order] = np.cumsum(new, dtype=np.int32) - 1
        del bucket, new
        release()

    def blocks(self, shard: int, rates: np.ndarray | None = None) -> pa.RecordBatch:
        """(bucket, shard, payload) rows; a payload has each context once, the number of its successors, the successors, their
        counts, and the contexts' agreement rates in the tree so far (none: the root's)."""
        own, packed = np.flatnonzero(np.diff(self.edges)), []
        length = np.diff(np.append(self.first, len(self.sym)))
        n = self.n[self.order]
        rates = None if rates is None else rates[self.order][self.first]
        for k in own:
            part, run = slice(self.edges[k], self.edges[k + 1]), slice(self.runs[k], self.runs[k + 1])
            packed.append(pack0(self.ctx[self.first[run]], length[run], self.sym[part], n[part], rates[run] if rates is not None else np.empty(0)))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([shard] * len(own), pa.int32()), pa.array(packed, pa.binary())], ["bucket", "shard", "payload"])

    def hear(self, told: pa.Table, heavy: tuple) -> None:
        """``seen`` of each entry, and ``total``, ``mass`` and ``rate`` of each run of a context (total 0: no state)."""
        seen = np.zeros(len(self.order), np.int64)
        total, kept, distinct, agree = (np.zeros(len(self.first), np.int64) for _ in range(4))
        for k, n, *states in payloads(told):
            seen[self.edges[k]:self.edges[k + 1]] = n
            for x, y in zip((total, kept, distinct, agree), states, strict=True):
                x[self.runs[k]:self.runs[k + 1]] = y
        total, mass = total.astype(float), kept - DISCOUNT * distinct
        rate = agree / np.maximum(total * (total - 1) / 2, 1)
        at, ok = lookup(heavy[0], self.ctx[self.first])
        for x, y in zip((total, mass, rate), heavy[1:], strict=True):
            x[ok] = y[at[ok]]
        self.seen = np.empty(len(seen), np.int64)
        self.seen[self.order] = seen
        self.total, self.mass, self.rate = total, mass, rate
        del self.ctx, self.sym, self.order, seen
        release()


def _pairs(shard: _Shard, heavy: np.ndarray, count: int) -> _Entries:
    at = np.flatnonzero(shard.past >= 1).astype(np.int32)
    return _Entries(shard, at, shard.word[at - 1], lambda k: shard.hash[k], heavy, count)


def _triples(shard: _Shard, pairs: _Entries, heavy: np.ndarray, count: int) -> tuple[_Entries, np.ndarray]:
    """Entries of the two-word contexts to try, and their shorter contexts' agreement rates (successors of a word that is no
    state are not told, so they count as 0 here)."""
    entry = np.zeros(len(shard.word), np.int32)  # of the pair that each symbol ends
    entry[pairs.at] = pairs.inverse
    at = np.flatnonzero(shard.past >= 2).astype(np.int32)
    at = at[(pairs.total > 0)[pairs.run[entry[at]]] & (pairs.seen >= GROW)[entry[at - 1]]]
    a, b = (pairs.key >> np.uint64(32)).astype(np.int32), (pairs.key & np.uint64(0xFFFFFFFF)).astype(np.int32)
    found = _Entries(shard, at, entry[at - 1], lambda k: pair(shard.hash[a[k]], shard.hash[b[k]]), heavy, count)
    rates = np.empty(len(found.n))
    rates[found.inverse] = pairs.rate[pairs.run[entry[at]]]
    return found, rates


def _count_words(count: int):
    def run(batches):
        for shard in _shards(batches):
            yield by_bucket(shard.id, top_bits(shard.hash, count), count, shard.hash, shard.counts(shard.word, slice(None), len(shard.hash)))
            del shard
    return run


def _sum_words(table: pa.Table) -> pa.Table:
    parts = list(payloads(table))
    size = np.array([len(p[0]) for p in parts])
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts])
    keys, total = grouped_sums(h, n)
    bucket, rows, at = table.column("bucket")[0].as_py(), [], 0
    for shard, k in zip(table.column("shard").to_pylist(), size.tolist(), strict=True):
        own = total[np.searchsorted(keys, h[at:at + k])]
        rows.append((shard, answer(bucket, own)))
        at += k
    most = np.argsort(total)[-MOST:]
    rows.append((-1, pack0(np.array([total.sum(), (total > 0).sum(), (total.astype(float) * (total - 1)).sum()], float), keys[most], total[most])))
    return replies(rows)


def _count_pairs(heavy: np.ndarray, count: int):
    def run(batches):
        for shard in _shards(batches):
            yield _pairs(shard, heavy, count).blocks(shard.id)
            del shard
    return run


def _diverges(total: np.ndarray, agree: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """agree: pairs of occurrences with the same successor; rate: how often two draws from the shorter context agree."""
    expected = rate * total * (total - 1) / 2
    return (agree >= 1) & (agree > expected + SIGMAS * np.sqrt(np.maximum(expected, 1e-12)))


def _sum_successors(heavy: np.ndarray, rate: float):
    """Reply, in the order asked: counts of kept successors (else 0); of contexts that stay total, kept occurrences, kept successors and agreeing pairs.
    Shard -1: sums of the contexts that are dealt out by successor, and the most frequent successors."""
    def run(table: pa.Table) -> pa.Table:
        parts = list(payloads(table))
        size = np.array([len(p[2]) for p in parts])
        ctx = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        sym, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3].astype(np.int64) for p in parts])
        at = np.lexsort((sym, ctx))
        c, s = ctx[at], sym[at]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])))
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[at], first)
        kept = total >= SUPPORT
        group = np.empty(len(at), np.int64)
        group[at] = np.cumsum(new) - 1
        c = c[first]
        begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        names = c[begin]
        totals, agree, mass, distinct = (np.add.reduceat(x, begin) for x in (total, total * (total - 1.0) / 2, np.where(kept, total, 0), kept.astype(np.int64)))
        sums = [totals.astype(float), agree, mass - DISCOUNT * distinct]
        big = lookup(heavy, names)[1]
        known = np.concatenate([p[0] for p in parts])
        once = np.argsort(known)
        rates = np.concatenate([p[4] if len(p[4]) else np.full(len(p[0]), rate) for p in parts])[once][np.searchsorted(known[once], names)]
        stays = ~big & _diverges(sums[0], sums[1], rates)
        which = np.cumsum(np.concatenate(([True], c[1:] != c[:-1]))) - 1  # each distinct successor's context
        told = kept & (stays | big)[which]
        bucket, rows, k0 = table.column("bucket")[0].as_py(), [], 0
        for shard, k, p in zip(table.column("shard").to_pylist(), size.tolist(), parts, strict=True):
            g = group[k0:k0 + k]
            state = np.searchsorted(names, p[0])
            rows.append((shard, answer(bucket, np.where(told[g], total[g], 0), *(np.where(stays[state], x[state], 0) for x in (totals, mass, distinct, agree.astype(np.int64))))))
            k0 += k
        most = np.argsort(total)[-MOST:]
        rows.append((-1, pack0(names[big], *(x[big] for x in (*sums, rates)), pair(c, s[first])[most], total[most])))
        return replies(rows)
    return run


def _heavy_states(found: DataFrame) -> tuple:
    """The dealt-out contexts that stay: sorted names, totals, kept masses, agreement rates; as many as four times the buckets at most."""
    def rows(batches):
        for b in batches:
            for x in b.column("payload").to_pylist():
                names, *sums = unpack(x)[:5]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(y.astype(float)) for y in sums)], ["name", "total", "agree", "mass", "rate"])
    got = found.where("shard = -1").select("payload").mapInArrow(rows, "name long, total double, agree double, mass double, rate double").groupBy("name").agg(
        F.sum("total"), F.sum("agree"), F.sum("mass"), F.min("rate")).collect()
    got = sorted((np.int64(r[0]).view(np.uint64), *r[1:]) for r in got)
    names = np.array([r[0] for r in got], np.uint64)
    total, agree, mass, rate = (np.array([r[k] for r in got], float) for k in (1, 2, 3, 4))
    stays = _diverges(total, agree, rate)
    return names[stays], total[stays], mass[stays], (agree / np.maximum(total * (total - 1) / 2, 1))[stays]


def _whole(texts: pa.Table) -> _Shard:
    return _Shard(unblob(x.as_buffer()) for x in texts.column("payload"))


def _grow(heavy: list, states: tuple, count: int):
    """Successors of the two-word contexts to try."""
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"bucket": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        shard = _whole(texts)
        pairs = _pairs(shard, heavy[0], count)
        pairs.hear(told, states)
        found, rates = _triples(shard, pairs, heavy[1], count)
        return pa.Table.from_batches([found.blocks(texts.column("shard")[0].as_py(), rates)])
    return run


def _score(total: float, distinct: float, heavy: list, states: list[tuple], count: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        at_level = told.column("level").to_numpy()
        own = lambda k: told.filter(pa.array(at_level == k))
        shard = _whole(texts)
        edges = np.searchsorted(top_bits(shard.hash, count), np.arange(count + 1))
        n = np.zeros(len(shard.hash), np.int64)
        for k, x in payloads(own(0)):
            n[edges[k]:edges[k + 1]] = x
        add = lambda x: np.add.reduceat(x, shard.begin)  # noqa: E731  every document has its end symbol
        p = ((n + 0.5) / (total + 0.5 * (distinct + 1)))[shard.word]
        columns, level = [shard.size, add((n > 0)[shard.word].astype(np.int64)), np.full(len(shard.size), int(total)), add(np.log10(p))], None
        for depth, name in enumerate(states):
            level = _triples(shard, level, heavy[1], count)[0] if depth else _pairs(shard, heavy[0], count)
            level.hear(own(depth + 1), name)
            go = np.flatnonzero((level.total > 0)[level.run[level.inverse]])
            at, entry = level.at[go], level.inverse[go]
            del go
            seen, run = level.seen[entry], level.run[entry]
            p[at] = np.where(seen >= SUPPORT, seen - DISCOUNT, 0.0) / level.total[run] + (1 - level.mass[run] / level.total[run]) * p[at]
            del at, entry, seen, run
            release()
        columns.append(add(np.log10(p)))
        keys = pa.Table.from_batches(shard.batches)
        release()
        return pa.Table.from_arrays([keys.column("doc_id"), keys.column("held_out"), *map(pa.array, columns)],
                                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; ``docs`` has doc_id, text and
    held_out (not learned from)."""
    spark = docs.sparkSession
    # shards are many: a bucket for each shuffle partition keeps their payloads few; a context is heavy from a quarter of a bucket's share
    count, shares = buckets(spark, 1), buckets(spark)
    docs = with_shard(docs.select("doc_id", "text", "held_out"))
    kind = dict(docs.dtypes)["doc_id"]
    words = cut(docs.mapInArrow(_count_words(count), EXCHANGE).groupBy("bucket").applyInArrow(_sum_words, REPLY))
    sums = [unpack(r[0]) for r in words.where("shard = -1").select("payload").collect()]  # three sums and MOST words for each bucket
    total, distinct, agree = (float(sum(s[0][k] for s in sums)) for k in range(3))
    rate = agree / max(total * (total - 1), 1)
    often = lambda tops: np.sort(np.array([k for keys, n in tops for k, x in zip(keys, n.tolist(), strict=True) if x >= max(total / shares, 1)], np.uint64))
    heavy = [often([(s[1], s[2]) for s in sums])]  # by level
    texts = docs.mapInArrow(_blobs, REPLY)
    told, states = [words.where("shard >= 0").withColumn("level", F.lit(0))], []
    for level in range(1, DEPTH + 1):
        if level == 1:
            sent = docs.mapInArrow(_count_pairs(heavy[0], count), EXCHANGE)
        else:
            sent = texts.groupBy("shard").cogroup(found.where("shard >= 0").groupBy("shard")).applyInArrow(_grow(heavy, states[-1], count), EXCHANGE)
        found = cut(sent.groupBy("bucket").applyInArrow(_sum_successors(heavy[-1], rate), REPLY))
        states.append(_heavy_states(found))
        told.append(found.where("shard >= 0").withColumn("level", F.lit(level)))
        if level < DEPTH:
            heavy.append(often([unpack(r[0])[5:] for r in found.where("shard = -1").select("payload").collect()]))
    answers = told[0]
    for t in told[1:]:
        answers = answers.unionByName(t)
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        _score(total, distinct, heavy, states, count), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

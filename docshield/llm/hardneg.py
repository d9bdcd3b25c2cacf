"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors are turned into integers, ordered by label and by their place on a Hilbert curve
through all dimensions, and written as Parquet rows of up to ``BLOCK`` vectors.  Each such
block carries a zone map: the smallest and largest value of each dimension.  Anchors are
put together to blocks in the same order.  A search asks, for each anchor, for the k best
rows in each of its score windows.  Interval arithmetic on a block's zone map bounds the
scores inside it from both sides; a block is read for an anchor block only if, for one of its
anchors, the bounds meet a window.  A first round reads each anchor's most promising block;
the k-th best score found there narrows the windows of the second, which reads the rest.
First the positives are searched (one open window among the blocks of the anchor's label), then
their scores make the windows of the negatives (among the blocks of other labels).

Zone maps and anchor blocks meet in a grid of cells of bounded size; the pairs chosen there
bring a block's vectors to the anchors, which a task streams through with k rows kept for each
anchor and window.  Nothing but counts and a mean and a spread per dimension comes to the driver.

Defined cases: rows with a null label, vec_id or vector, or a null or non-finite component,
take no part; of rows that share a vec_id the one with the least (label, vector) counts;
vectors of different lengths are not compared; ties go to the smaller vec_id; a component
outside 32 bits after scaling, or a score outside 64, is an error; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield.llm.common import cut

BLOCK = 1024  # vectors of a block
ANCHORS = 512  # anchors of an anchor block
CELL = 1024  # zone maps of a cell
CELL_ANCHORS = 64  # anchor blocks of a cell
READ = 128  # blocks that one run of a task reads for an anchor block
BITS = 3  # cells of the curve in each dimension: 2**BITS
POSITIVES, NEGATIVES = 5, 3
FAR = 1 << 62


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (n x d, values under 2**bits) on the Hilbert curve, as rows of bytes in sorting order."""
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations, from the coarsest level on
        low = np.uint32(q - 1)
        for i in range(d):
            on = (x[i] & np.uint32(q)) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        flip ^= np.where(x[d - 1] & np.uint32(q), np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]  # coarse bits of all dimensions first
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vec (whole numbers): the rows that take part."""
    x, i = F.col("embedding"), F.col("vec_id").cast("long")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.when(F.pmod(i, F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = embeddings.where(i.isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    rows = rows.select(i.alias("vec_id"), label.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def _lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy()
    return off - off[0], col.values.slice(off[0], off[-1] - off[0]).to_numpy()


def _sums(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        off, x = _lists(b.column("vec"))
        place = np.arange(len(x)) - np.repeat(off[:-1], np.diff(off))
        n = int(place.max()) + 1 if len(x) else 0
        own = np.stack([np.bincount(place, w, minlength=n) for w in (None, x.astype(float), x.astype(float) ** 2)]) if n else np.zeros((3, 0))
        for k in range(n):
            total[k] = total.get(k, 0) + own[:, k]
    got = np.array(list(total.values())).reshape(-1, 3)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array(got[:, k]) for k in range(3))], ["place", "n", "s", "ss"])


def _keyed(mean: np.ndarray, spread: np.ndarray):
    """Adds the length and the place on the curve; dimensions with the widest spread are the curve's first."""
    def run(batches):
        for b in batches:
            off, x = _lists(b.column("vec"))
            size = np.diff(off)
            keys: list[bytes | None] = [None] * len(size)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                v = np.stack([x[off[k]:off[k + 1]] for k in at]).astype(float) if d else np.zeros((len(at), 1))
                if d:
                    order = np.argsort(-spread[:d], kind="stable")
                    v = (v[:, order] - mean[:d][order]) / np.maximum(spread[:d][order], 1e-9)
                half = 1 << (BITS - 1)
                cells = np.clip(np.floor(v * half / 2) + half, 0, 2 * half - 1)  # the mean is a border of cells, two spreads on either side are covered
                for k, key in zip(at, hilbert(cells, BITS), strict=True):
                    keys[k] = key.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(size.astype(np.int32)), pa.array(keys, pa.binary()), b.column("vec")], ["vec_id", "label", "dim", "key", "vec"])
    return run


def _runs(b: pa.RecordBatch, *names: str):
    """First and last row of each run of equal values."""
    cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
    new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows > 1 else []
    edges = [0, *new, b.num_rows]
    return zip(edges[:-1], edges[1:], strict=True)


def _blocked(size: int):
    """Blocks of the ordered rows, each of one label and length."""
    def run(batches):
        task, nth, held, n, kind = TaskContext.get().partitionId(), 0, [], 0, None

        def block():
            nonlocal nth, held, n
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            at = np.argsort(ids)
            ids, x = ids[at], x[at]
            if x.size and np.abs(x).max() >= 1 << 31:
                raise ValueError("a component, scaled by 256, is outside 32 bits")
            row = [(task << 33) + nth, *kind, ids.tolist(), x.astype("<i4").tobytes(), x.min(axis=0).tolist(), x.max(axis=0).tolist()]
            nth, held, n = nth + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], BLOCK_NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            off, x = _lists(b.column("vec"))
            ids = b.column("vec_id").to_numpy()
            for s, e in _runs(b, "label", "dim"):
                own = (b.column("label")[s].as_py(), b.column("dim")[s].as_py())
                if n and own != kind:
                    yield block()
                kind = own
                while s < e:
                    t = min(e, s + size - n)
                    held.append((ids[s:t], x[off[s]:off[t]].reshape(t - s, own[1])))
                    n += t - s
                    s = t
                    if n == size:
                        yield block()
        if n:
            yield block()
    return run


BLOCK_NAMES = ["block", "label", "dim", "ids", "vecs", "lo", "hi"]
BLOCK_SCHEMA = "block long, label long, dim int, ids array<long>, vecs binary, lo array<long>, hi array<long>"


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of ``rows`` (vec_id, label, vec) along the curve, with their zone maps."""
    sums = rows.mapInArrow(_sums, "place int, n double, s double, ss double").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("place").collect()  # a row for each dimension
    n, s, ss = (np.array([r[k] for r in sums], float) for k in ("n", "s", "ss"))
    mean = s / n if len(n) else s
    spread = np.sqrt(np.maximum(ss / n - mean ** 2, 0)) if len(n) else s
    keyed = rows.mapInArrow(_keyed(mean, spread), "vec_id long, label long, dim int, key binary, vec array<long>")
    order = ["label", "dim", "key", "vec_id"]
    return cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocked(size), BLOCK_SCHEMA))


def _matrix(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(n, dim)


def anchors_of(blocks: DataFrame, every: int, size: int = ANCHORS) -> DataFrame:
    """vec_id, label, dim, vec, ablock: the rows whose id is divisible by ``every``, put together along the curve."""
    def chosen(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.array(r["ids"])
                at = np.flatnonzero(ids % every == 0)
                x = _matrix(r["vecs"], r["dim"], len(ids))[at]
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array([r["label"]] * m, pa.int64()), pa.array([r["dim"]] * m, pa.int32()), pa.array([r["block"]] * m, pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "label", "dim", "block", "vec"])

    def numbered(batches):
        task, nth, n, kind = TaskContext.get().partitionId(), -1, size, None
        for b in batches:
            number = np.empty(b.num_rows, np.int64)
            for s, e in _runs(b, "label", "dim") if b.num_rows else ():
                own = (b.column("label")[s].as_py(), b.column("dim")[s].as_py())
                if own != kind:
                    kind, n = own, size
                while s < e:
                    if n == size:
                        nth, n = nth + 1, 0
                    t = min(e, s + size - n)
                    number[s:t] = (task << 33) + nth
                    n += t - s
                    s = t
            yield b.drop_columns(["block"]).append_column("ablock", pa.array(number))

    order = ["label", "dim", "block", "vec_id"]
    found = blocks.mapInArrow(chosen, "vec_id long, label long, dim int, block long, vec binary")
    return cut(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbered, "vec_id long, label long, dim int, vec binary, ablock long"))


ANCHOR_ROW = "array<struct<vec_id:bigint,vec:binary,lows:array<bigint>,highs:array<bigint>>>"


def _packed(anchors: DataFrame) -> DataFrame:
    """A row for each anchor block, of at most ANCHORS anchors."""
    return anchors.groupBy("ablock", "label", "dim").agg(F.array_sort(F.collect_list(F.struct("vec_id", "vec", "lows", "highs"))).alias("anchors"))


class _Anchors:
    def __init__(self, r: dict) -> None:
        a = r["anchors"]
        self.ablock, self.label, self.dim = r["ablock"], r["label"], r["dim"]
        self.ids = np.array([x["vec_id"] for x in a], np.int64)
        self.x = _matrix(b"".join(x["vec"] for x in a), self.dim, len(a))
        self.lows, self.highs = (np.array([x[k] for x in a], np.int64).reshape(len(a), -1) for k in ("lows", "highs"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in double precision where that holds them, else as Python's integers."""
    most = max(1, a.shape[1]) * int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0))
    return a.astype(float) @ b.astype(float).T if most < 1 << 53 else a.astype(object) @ b.astype(object).T


def bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that any vector inside the zones (z x d) can have with each row of ``x``."""
    x, lo, hi = (v.astype(np.int64) for v in (x, lo, hi))
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)


def _choose(packed: DataFrame, blocks: DataFrame, counts: tuple[int, int], same: bool, seed: bool) -> DataFrame:
    """(ablock, block, most): the blocks that some anchor of an anchor block must read; with ``seed`` each anchor's most promising one in each cell."""
    parts, salts = -(-counts[0] // CELL), -(-counts[1] // CELL_ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(n, 1))).cast("int")
    empty = lambda t: F.lit(None).cast(t)
    zones = blocks.select(share("block", parts).alias("part"), every(salts).alias("salt"), F.lit(0).alias("kind"), "block", "label", "dim", "lo", "hi", empty(ANCHOR_ROW).alias("anchors"))
    asked = packed.select(every(parts).alias("part"), share("ablock", salts).alias("salt"), F.lit(1).alias("kind"), F.col("ablock").alias("block"), "label", "dim", empty("array<bigint>").alias("lo"), empty("array<bigint>").alias("hi"), "anchors")

    def pairs(batches):
        cell, zones, table = None, [], {}
        for b in batches:
            for r in b.to_pylist():
                if (r["part"], r["salt"]) != cell:
                    cell, zones, table = (r["part"], r["salt"]), [], {}
                if r["kind"] == 0:
                    zones.append((r["block"], r["label"], r["dim"], r["lo"], r["hi"]))
                    continue
                a = _Anchors(r | {"ablock": r["block"]})
                if a.dim not in table:
                    own = [z for z in zones if z[2] == a.dim]
                    table[a.dim] = (np.array([z[0] for z in own], np.int64), np.array([z[1] for z in own], np.int64), *(np.array([z[k] for z in own], np.int64).reshape(len(own), a.dim) for k in (3, 4)))
                ids, labels, lo, hi = table[a.dim]
                mine = (labels == a.label) == same
                if not mine.any():
                    continue
                ids = ids[mine]
                least, most = bounds(a.x, lo[mine], hi[mine])
                need = np.zeros(most.shape, bool)
                for w in range(a.lows.shape[1]):
                    need |= ((most >= a.lows[:, w:w + 1]) & (least <= a.highs[:, w:w + 1])).astype(bool)
                most = np.where(need, most, -np.inf).astype(float)
                if seed:
                    top = np.argmax(most, axis=1)
                    at = np.unique(top[need[np.arange(len(top)), top]])
                else:
                    at = np.flatnonzero(need.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array([a.ablock] * len(at), pa.int64()), pa.array(ids[at]), pa.array(most[:, at].max(axis=0) if len(at) else np.empty(0))], ["ablock", "block", "most"])

    grid = zones.unionByName(asked).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")
    return grid.mapInArrow(pairs, "ablock long, block long, most double")


def _better(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, at, -1), np.take_along_axis(ids, at, -1)


class _Found:
    """The k best rows of each anchor and window so far: more score first, then the smaller id."""

    def __init__(self, a: _Anchors, k: int) -> None:
        self.a, self.k = a, k
        shape = (*a.lows.shape, k)
        self.score, self.ids = np.full(shape, -np.inf), np.full(shape, FAR, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        a, k = self.a, self.k
        s = _product(a.x, x)
        if s.dtype == object:
            if max(abs(int(s.max())), abs(int(s.min()))) >= 1 << 53:
                self.score = self.score.astype(object)
            else:
                s = s.astype(float)
        at = np.minimum(np.searchsorted(ids, a.ids), len(ids) - 1)
        own = ids[at] == a.ids  # an anchor is not a row of its own
        s[np.flatnonzero(own), at[own]] = -np.inf
        row = np.arange(len(a.ids))
        for w in range(a.lows.shape[1]):
            low = np.maximum(a.lows[:, w], self.score[:, w, -1])
            left = np.where(s <= a.highs[:, w:w + 1], s, -np.inf)
            got, who = [], []
            for _ in range(k):  # ids ascend, so the first of the largest has the smallest id
                top = np.argmax(left, axis=1)
                value = left[row, top]
                fits = (value >= low).astype(bool)
                if not fits.any():
                    break
                got.append(np.where(fits, value, -np.inf))
                who.append(np.where(fits, ids[top], FAR))
                left[row, top] = -np.inf
            if got:
                self.score[:, w], self.ids[:, w] = _better(np.concatenate([self.score[:, w], np.stack(got, 1)], 1), np.concatenate([self.ids[:, w], np.stack(who, 1)], 1), k)

    def batch(self) -> pa.RecordBatch:
        i, w, j = np.nonzero(self.ids != FAR)
        score = pa.array([int(v) for v in self.score[i, w, j]], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(self.a.ids[i]), pa.array(w.astype(np.int32)), pa.array(self.ids[i, w, j]), score], ["vec_id", "w", "id", "score"])


def _read(packed: DataFrame, pairs: DataFrame, blocks: DataFrame, count: int, k: int) -> DataFrame:
    """(vec_id, w, id, score): the k best rows of each task for each anchor and window, from the chosen blocks."""
    salts = -(-max(count, 1) // READ)
    empty = lambda t: F.lit(None).cast(t)
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    heads = packed.join(pairs.select("ablock", salt.alias("salt")).distinct(), "ablock").select(
        "ablock", "salt", F.lit(0).alias("kind"), F.lit(0.0).alias("most"), "label", "dim", "anchors", empty("array<bigint>").alias("ids"), empty("binary").alias("vecs"))
    bodies = pairs.join(blocks.select("block", "label", "dim", "ids", "vecs"), "block").select(
        "ablock", salt.alias("salt"), F.lit(1).alias("kind"), "most", "label", "dim", empty(ANCHOR_ROW).alias("anchors"), "ids", "vecs")

    def scored(batches):
        found = None
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if found is not None:
                        yield found.batch()
                    found = _Found(_Anchors(r), k)
                else:
                    found.add(np.array(r["ids"], np.int64), _matrix(r["vecs"], r["dim"], len(r["ids"])))
        if found is not None:
            yield found.batch()

    order = ["ablock", "salt", "kind", F.col("most").desc()]
    return heads.unionByName(bodies).repartition("ablock", "salt").sortWithinPartitions(*order).mapInArrow(scored, "vec_id long, w int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("vec_id", "w").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(vec_id, w, id, score, rank): for each anchor the k best rows of the same label, or of the others, in each window of scores.

    ``anchors`` has vec_id, label, dim, vec, ablock, lows and highs (the windows' ends, included; as many for each anchor)."""
    counts = (blocks.count(), anchors.select("ablock").distinct().count())
    packed = cut(_packed(anchors))
    seeds = cut(_choose(packed, blocks, counts, same, seed=True))
    first = cut(_best(_read(packed, seeds, blocks, counts[0], k), k))
    # the k-th best score so far closes a window from below
    floor = first.where(F.col("rank") == k).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floor"))
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("floor", w), low)))
    packed = cut(_packed(anchors.join(floor, "vec_id", "left").withColumn("lows", raised)))
    rest = cut(_choose(packed, blocks, counts, same, seed=False).join(seeds.select("ablock", "block"), ["ablock", "block"], "left_anti"))
    return cut(_best(first.drop("rank").unionByName(_read(packed, rest, blocks, counts[0], k)), k))


def hard_negatives(embeddings: DataFrame, every: int = 50, block: int = BLOCK, together: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by ``every``."""
    blocks = blocks_of(quantised(embeddings), block)
    anchors = anchors_of(blocks, every, together)
    whole = lambda *values: F.array(*(F.lit(v).cast("long") for v in values))
    positives = search(anchors.withColumns({"lows": whole(-FAR), "highs": whole(FAR)}), blocks, POSITIVES, True).select(
        "vec_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 50 p <= 100 n <= 95 p for whole n
    low, high = F.expr("(positive_score + pmod(positive_score, 2)) div 2"), F.expr("95 * ((positive_score - pmod(positive_score, 100)) div 100) + 95 * pmod(positive_score, 100) div 100")
    window = positives.select("vec_id", "w", F.when(low <= high, low).otherwise(F.lit(FAR)).alias("low"), F.when(low <= high, high).otherwise(F.lit(-FAR)).alias("high"))
    window = window.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("ws"))
    padded = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda k: F.coalesce(F.get("ws", k)[name], F.lit(none).cast("long")))
    asking = anchors.join(window, "vec_id").withColumns({"lows": padded("low", FAR), "highs": padded("high", -FAR)}).drop("ws")
    negatives = search(asking, blocks, NEGATIVES, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return negatives.join(positives, ["vec_id", "w"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB SQL.
HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

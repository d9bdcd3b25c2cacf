"""DP operators over DataFrames: noisy embeddings, the dp_audit table (S11,
A3) and the privacy–utility sweep (V8)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import vectors as V
from docshield.operators.cells import _matrix, _packed, _unpacked, release
from docshield.operators.search import RESCORE_ROWS, _fold, vector_search
from docshield.sources.files import cut

SWEEP_EPSILONS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 100.0, 1000.0]
#: Queries of a task of the sweep, about; rows of a packed block of chunks, at most; queries whose scores are made at once; blocks that reach a task at once.
SWEEP_QUERIES = 8192
SWEEP_BLOCK = 1024
SWEEP_TILE = 256
SWEEP_BATCH = 4


def dp_embed(df: DataFrame, *, key: str, vec_col: str = "embedding", id_col: str = "chunk_id",
             epsilon: float = C.DP_EPSILON, mechanism: str = C.DP_MECHANISM, delta: float = C.DP_DELTA,
             clip: float = C.DP_CLIP, out_col: str = "embedding") -> DataFrame:
    """V6 on a table of stored vectors (queries are never noised)."""
    v = V.as_double(vec_col)
    return df.withColumn(out_col, V.dp_noisy(v, F.col(id_col), key, epsilon, mechanism, delta, clip))


def dp_audit(vectors: DataFrame, *, key: str, id_col: str = "chunk_id", vec_col: str = "v",
             doc_col: str = "doc_id", epsilon: float = C.DP_EPSILON, mechanism: str = C.DP_MECHANISM,
             delta: float = C.DP_DELTA, clip: float = C.DP_CLIP,
             sensitivity: float = C.DP_SENSITIVITY) -> DataFrame:
    """Mean noise statistics per document (a partial aggregate)."""
    n = vectors.select(doc_col, V.noise_stats(vec_col, V.dp_noisy(vec_col, F.col(id_col), key, epsilon, mechanism,
                                                                    delta, clip)).alias("s"))
    return n.groupBy(doc_col).agg(
        F.lit(float(epsilon)).alias("epsilon"), F.lit(float(sensitivity)).alias("sensitivity"),
        _exact_mean("s.noise_l2_norm").alias("noise_l2_mean"), _exact_mean("s.cosine_sim").alias("cosine_sim_mean"),
        F.count(F.lit(1)).alias("chunks_processed"))


def _exact_mean(c: str):
    """Mean of values already rounded to 6 places, summed exactly as integers."""
    s = F.sum(F.round(F.col(c) * 1e6).cast("long"))
    n = F.count(F.lit(1))
    return F.floor((s * 2 + n) / (n * 2)) / 1e6  # half-up in integer micro-units


def privacy_utility_sweep(queries: DataFrame, chunks: DataFrame, *, key: str, k: int = C.TOP_K,
                          epsilons=SWEEP_EPSILONS, mechanism: str = C.DP_MECHANISM) -> DataFrame:
    """V8: recall@k of search over noised chunks against search over clean
    chunks, per epsilon.  One search job covers the whole sweep."""
    scales = []
    for e in epsilons:
        if e <= 0:
            raise ValueError(f"epsilon must be > 0, got {e}")
        scales.append(V.gaussian_sigma(e, C.DP_DELTA, C.DP_CLIP) if mechanism == "gaussian" else C.DP_CLIP / e)
    noisy_hits = noised_search(queries, chunks, k, key=key, scales=scales, mechanism=mechanism)
    clean_hits = _cut_in_batches(vector_search(queries, chunks, k).select("query_id", "chunk_id"), SWEEP_BATCH)
    hit = noisy_hits.join(clean_hits.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    per_q = hit.groupBy("ei", "query_id").agg(F.count_if(F.col("hit") == 1).alias("n_hit"))
    eps_df = chunks.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(epsilons)], "ei int, epsilon double")
    return (per_q.groupBy("ei").agg(F.round(F.avg(F.col("n_hit") / k), 6).alias("recall_at_k"),
                                    F.count(F.lit(1)).alias("n_queries"))
            .join(eps_df, "ei").select("epsilon", "recall_at_k", "n_queries"))


def noised_search(queries: DataFrame, chunks: DataFrame, k: int, *, key: str, scales: list[float], mechanism: str) -> DataFrame:
    """(ei, query_id, chunk_id): the top-k of each query over its tenant's chunks (cosine, ties by chunk_id), noised by each of ``scales``.

    A chunk is stored once, as its clipped vector and unit noise, in blocks of a tenant; a task for about ``SWEEP_QUERIES`` queries
    reads the blocks one after the other and noises them for each scale as it meets them.  So what is written does not grow with
    the scales, and neither side is shuffled more than once."""
    spark = chunks.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = ["a", "b"] if mechanism == "gaussian" else [""]
    c = chunks.select("chunk_id", F.col("tenant_id").cast("string").alias("tenant_id"), "embedding").where("embedding IS NOT NULL AND tenant_id IS NOT NULL")
    c = c.repartition(n_tasks, "chunk_id").sortWithinPartitions("tenant_id")
    c = c.select("chunk_id", "tenant_id", V.l2_clip(V.as_double("embedding"), C.DP_CLIP).alias("clipped"))
    drawn = ", ".join(f"u{i} array<double>" for i in range(len(salts)))
    c = c.mapInArrow(_uniforms(key, salts), f"chunk_id string, tenant_id string, clipped array<double>, {drawn}")
    if mechanism == "gaussian":
        unit = F.zip_with("u0", "u1", lambda a, b: V.noise_of(mechanism, 1.0, a, b))
    else:
        unit = F.transform("u0", lambda a: V.noise_of(mechanism, 1.0, a))
    blocks = _cut_in_batches(c.select("tenant_id", "chunk_id", "clipped", unit.alias("unit")).mapInArrow(_pack_blocks, "tenant_id string, payload binary"), SWEEP_BLOCK)
    q = queries.select("query_id", F.col("tenant_id").cast("string").alias("tenant_id"), "qvec").where("qvec IS NOT NULL AND tenant_id IS NOT NULL")
    n = q.count()
    parts = max(math.ceil(n / SWEEP_QUERIES), min(n, spark.sparkContext.defaultParallelism), 1)
    asked = q.repartition(parts, "query_id").mapInArrow(_pack_all, "queries binary")
    # one partition on the chunks' side: a task reads the blocks one after the other, the queries come with the first
    met = blocks.coalesce(1).withColumn("n", F.monotonically_increasing_id()).hint("shuffle_replicate_nl").crossJoin(asked)
    met = met.select("tenant_id", "payload", F.when(F.col("n") == 0, F.col("queries")).alias("queries"))
    found = met.mapInArrow(_noised_scorer(k, scales), "ei int, query_id long, chunk_id string")
    return _cut_in_batches(found, SWEEP_BATCH)


def _cut_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` of rows that carry vectors or blocks of them: so many at a time go to the Python workers, as the buffers for them are kept besides the heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(rows))
    try:
        return cut(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _uniforms(key: str, salts: list[str]):
    """mapInArrow body: ``vectors.prf_uniform`` of a chunk's dimensions, a column for each salt (Spark's own is interpreted, 15 us a number)."""
    def run(batches):
        tails: list[list[bytes]] = [[] for _ in salts]
        for whole in batches:
            for lo in range(0, whole.num_rows, SWEEP_BLOCK):
                b = whole.slice(lo, SWEEP_BLOCK)
                size = pc.list_value_length(b.column("clipped")).to_numpy(zero_copy_only=False).astype(np.int64)
                for s, t in zip(salts, tails):
                    t.extend(f"{d}{s and '|' + s}".encode() for d in range(len(t), int(size.max())))
                heads = [f"{key}|{x}|".encode() for x in b.column("chunk_id").to_pylist()]
                off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                for i, t in enumerate(tails):
                    digests = b"".join([hashlib.sha256(h + x).digest() for h, m in zip(heads, size.tolist()) for x in t[:m]])
                    top = np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> np.uint64(12)
                    b = b.append_column(f"u{i}", pa.ListArray.from_arrays(off, pa.array((top.astype(np.float64) + 0.5) / V.TWO52)))
                yield b
        release()
    return run


def _pack_blocks(batches):
    """(tenant_id, payload): rows of a tenant, which are neighbours, together."""
    for b in batches:
        tenant = b.column("tenant_id").dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(tenant)) + 1).tolist(), len(tenant)]
        for lo, hi in zip(edges, edges[1:]):
            for at in range(lo, hi, SWEEP_BLOCK):
                own = b.slice(at, min(SWEEP_BLOCK, hi - at))
                yield pa.RecordBatch.from_pydict({"tenant_id": [own.column("tenant_id")[0].as_py()], "payload": pa.array([_packed(pa.Table.from_batches([own.drop_columns(["tenant_id"])]))], pa.binary())})


def _pack_all(batches):
    """All rows of a task as one payload."""
    held = [b for b in batches if b.num_rows]
    if held:
        payload = _packed(pa.Table.from_batches(held))
        held.clear()
        yield pa.RecordBatch.from_pydict({"queries": pa.array([payload], pa.binary())})
    release()


class _Best:
    """The best ``k`` chunks of each query (rows of ``vectors``) for one scale, equal scores at the k-th place included."""

    def __init__(self, vectors: np.ndarray, norm: np.ndarray, k: int):
        self.vectors, self.norm, self.k = vectors, norm, k
        self.floor = np.full(len(vectors), -np.inf)
        self.held: list[tuple] = []
        self.rows = 0

    def near(self, at: slice, scores: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of ``scores`` (of the queries ``at``, off by ``slack`` at most) that could be among the k best."""
        bar = self.floor[at] - slack
        none = np.flatnonzero(np.isneginf(bar))
        if len(none) and scores.shape[1] > self.k:
            bar[none] = np.partition(scores[none], scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k] - 2.0 * slack
        bar = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
        some = np.flatnonzero(scores.max(axis=1) >= bar)  # few, once there are floors
        flat = np.flatnonzero(scores[some] >= bar[some][:, None])
        return some[flat // scores.shape[1]] + at.start, flat % scores.shape[1]

    def add(self, q: np.ndarray, c: np.ndarray, noisy: np.ndarray, norm: np.ndarray, ids: np.ndarray) -> None:
        """Score pairs as ``vectors.cosine`` does, in its order of operations; ``noisy`` has the chunks' vectors as rows."""
        for lo in range(0, len(q), RESCORE_ROWS):
            qi, ci = q[lo:lo + RESCORE_ROWS], c[lo:lo + RESCORE_ROWS]
            score = _fold(noisy[ci] * self.vectors[qi]) / (norm[ci] * self.norm[qi])
            keep = np.isfinite(score) & (score >= self.floor[qi])
            self.held.append((qi[keep], score[keep], ids[ci[keep]]))
            self.rows += len(self.held[-1][0])
        if self.rows and (np.isneginf(self.floor).any() or self.rows > 4 * self.k * len(self.floor)):
            self.cut()

    def cut(self) -> None:
        q, score, ids = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        at = np.lexsort((-score, q))
        q, score, ids = q[at], score[at], ids[at]
        last = np.searchsorted(q, q) + self.k - 1
        full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == q)
        self.floor[q[full]] = score[last[full]]
        keep = score >= self.floor[q]
        self.held = [(q[keep], score[keep], ids[keep])]
        self.rows = len(self.held[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and ids, ties by id."""
        if not self.rows:
            return np.empty(0, np.int64), np.empty(0, object)
        self.cut()
        q, score, ids = self.held[0]
        at = np.lexsort((pc.rank(pa.array(ids, pa.string()), tiebreaker="dense").to_numpy(), -score, q))
        q, ids = q[at], ids[at]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[keep], ids[keep]


def _norm(columns: np.ndarray) -> np.ndarray:
    """``vectors.l2_norm`` of each column, in its order of operations."""
    total = np.zeros(columns.shape[1])
    for x in columns:
        total += x * x
    return np.sqrt(total)


class _Asked:
    """Queries of a tenant against its chunks, noised by each scale.

    A score is (q.clipped + scale q.unit) / norm: two products of 32-bit matrices serve all scales.  They only rule out."""

    def __init__(self, qids: np.ndarray, vectors: np.ndarray, k: int, scales: list[float]):
        norm = _norm(np.ascontiguousarray(vectors.T))
        ok = np.isfinite(norm) & (norm > 0)
        vectors, norm, self.qids, self.scales = vectors[ok], norm[ok], qids[ok], scales
        self.unit = (vectors / norm[:, None]).astype(np.float32)
        self.best = [_Best(vectors, norm, k) for _ in scales]

    def meet(self, clipped: np.ndarray, unit: np.ndarray, ids: np.ndarray) -> None:
        """``clipped`` and ``unit`` have a chunk in each column."""
        ok = np.isfinite(_norm(clipped) + _norm(unit))
        if not len(self.qids) or not ok.any():
            return
        if not ok.all():
            clipped, unit, ids = clipped[:, ok], unit[:, ok], ids[ok]
        size, length, between = _norm(clipped), _norm(unit), np.einsum("ij,ij->j", clipped, unit)
        told = []
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for scale in self.scales:
                n = np.sqrt(np.maximum(size * size + 2.0 * scale * between + (scale * length) ** 2, 0.0))
                # the rounding of a score, against what is added up in it: much where noise and vector cancel out
                off = (size + scale * length) / n
                far = np.flatnonzero(~(off < 1e3))
                if len(far):
                    n[far] = _norm(clipped[:, far] + unit[:, far] * scale)
                    off[far] = (size + scale * length)[far] / n[far]
                none = ~np.isfinite(off)  # no direction
                told.append((np.float32(scale), (1.0 / n).astype(np.float32), float(off[~none].max(initial=0.0)) * (len(clipped) + 16) * float(np.finfo(np.float32).eps), none))
        both = clipped.astype(np.float32), unit.astype(np.float32)
        found: list[list] = [[] for _ in self.scales]
        for lo in range(0, len(self.qids), SWEEP_TILE):
            at = slice(lo, min(lo + SWEEP_TILE, len(self.qids)))
            x, y = (self.unit[at] @ z for z in both)
            scores = np.empty_like(x)
            for own, hits, (scale, inverse, slack, none) in zip(self.best, found, told):
                np.multiply(y, scale, out=scores)
                scores += x
                scores *= inverse
                if none.any():
                    scores[:, none] = -np.inf
                hits.append(own.near(at, scores, slack))
        for own, hits, scale in zip(self.best, found, self.scales):
            q, c = (np.concatenate([h[i] for h in hits]) for i in range(2))
            if len(q):
                some = np.unique(c)
                v = clipped[:, some] + unit[:, some] * scale
                v /= _norm(v)  # vectors.l2_normalize; what has no direction was not met
                own.add(q, np.searchsorted(some, c), np.ascontiguousarray(v.T), _norm(v), ids[some])


def _noised_scorer(k: int, scales: list[float]):
    """mapInArrow body: the blocks of chunks against the queries that come with the first of them."""
    def run(batches):
        asked: dict[str, _Asked] = {}
        for b in batches:
            for tenant, payload, given in zip(*(b.column(x) for x in ("tenant_id", "payload", "queries"))):
                if given.is_valid:
                    table = _unpacked(given.as_buffer())
                    for t in table.column("tenant_id").unique().to_pylist():
                        own = table.filter(pc.equal(table.column("tenant_id"), t))
                        asked[t] = _Asked(own.column("query_id").to_numpy(), _matrix(own.column("qvec")), k, scales)
                if tenant.as_py() in asked:
                    table = _unpacked(payload.as_buffer())
                    clipped, unit = (np.ascontiguousarray(_matrix(table.column(x)).T) for x in ("clipped", "unit"))
                    asked[tenant.as_py()].meet(clipped, unit, np.array(table.column("chunk_id").to_pylist(), object))
        for own in asked.values():
            for ei, best in enumerate(own.best):
                q, ids = best.best()
                if len(q):
                    yield pa.RecordBatch.from_pydict({"ei": pa.array(np.full(len(q), ei, np.int32)), "query_id": pa.array(own.qids[q], pa.int64()), "chunk_id": pa.array(ids, pa.string())})
        asked.clear()
        release()
    return run

"""Exact top-k search with both sides large.

Chunks with the same vector, scope and access terms are one row with their k least ids, as no others can be
found.  These rows stand in cells: the tenant and the nearest of at most ``PIVOTS`` pivot vectors.  A cell is cut
to packed blocks of about ``BLOCK_CHUNKS`` rows, queries to packed blocks of about ``BLOCK_QUERIES``.  Each query
first meets one block of its own cell; the k-th score found there is its floor.  Then one task for a
few query blocks reads all chunk blocks from the shared folder, one after the other, and holds the k best of each
query.  So both sides are shuffled once and only k rows of a query leave a task: what is written grows with the
tables, only the products of blocks grow with both.

A block knows the least and greatest distance to its pivot, so the triangle inequality bounds the score that a
query block can reach there (angles for cosine, Euclidean for l2), and blocks bounded below all floors are not
met.  The bound is exact; vectors in no clusters are pruned little and then meet all blocks of their tenant.

A product of blocks (cosine: of 32-bit unit vectors) only rules out; what could be among the k best by its
rounding is scored in 64 bits.  Nothing but the pivots' pool and the number of blocks comes to the driver.
``chunk_id`` and ``query_id`` are taken to be unique.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docshield.operators.search import CANDIDATE_SCHEMA, RESCORE_ROWS, SCORE_CELLS, _exact, _role_bits, _trim
from docshield.session import ensure_checkpoint_dir
from docshield.sources.files import cut

PIVOTS = 32
#: Rows that the pivots are picked from, farthest first.
PIVOT_POOL = 256
BLOCK_CHUNKS = 4096
BLOCK_QUERIES = 4096
#: Tasks that read the chunk blocks, at most; each holds its share of the query blocks.
MAX_TASKS = 2000
#: Cells up to this number (rows of a tenant and four numbers) are broadcast; beyond it Spark's joins decide.
CELLS_BROADCAST = 100_000
#: Room for the rounding of distances: the arc cosine of a rounded product is off by 1e-7 at most.
DISTANCE_SLACK = 1e-6


def distances(vectors: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each vector (rows) to each pivot (columns): the angle, or the Euclidean distance."""
    dots = vectors @ pivots.T
    if metric == "cosine":
        norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(pivots, axis=1)[None, :]
        return np.arccos(np.clip(dots / norms, -1.0, 1.0))
    return np.sqrt(np.maximum(np.sum(vectors * vectors, axis=1)[:, None] + np.sum(pivots * pivots, axis=1)[None, :] - 2.0 * dots, 0.0))


def best_score(query: Column, low: Column, high: Column, metric: str, far: Column | None = None) -> Column:
    """The greatest score a chunk at ``low`` to ``high`` from a pivot can have with a query at ``query`` (to ``far``) from it."""
    gap = F.greatest(query - high, low - (query if far is None else far), F.lit(0.0)) - DISTANCE_SLACK
    if metric == "cosine":
        return F.cos(F.greatest(gap, F.lit(0.0))) + DISTANCE_SLACK
    return F.lit(1.0) - F.greatest(gap, F.lit(0.0)) / math.sqrt(2.0) + DISTANCE_SLACK


def release() -> None:
    """Give freed memory back: a task's workers wait for the next one, or for another stage's, and would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def _matrix(column) -> np.ndarray:
    """An Arrow column of vectors as rows of doubles; a null component is not a number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes == sizes[0]).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column.to_pylist()])


def _usable(vectors: np.ndarray, metric: str) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1)
    return np.isfinite(norms) & ((norms > 0) | (metric != "cosine"))


def _pivots(rows: DataFrame, metric: str) -> np.ndarray:
    """``rows`` has ids and embedding."""
    first = F.get("ids", F.lit(0))
    pool = rows.select("embedding").orderBy(F.xxhash64(first), first).limit(PIVOT_POOL).toPandas()["embedding"]
    if not len(pool):
        return np.zeros((0, 0))
    vectors = np.vstack([np.asarray(v, dtype=np.float64) for v in pool])
    vectors = vectors[_usable(vectors, metric)]
    if not len(vectors):
        return np.zeros((0, 0))
    picked, away = [0], distances(vectors, vectors[:1], metric)[:, 0]
    while len(picked) < PIVOTS and away.max() > DISTANCE_SLACK:
        picked.append(int(away.argmax()))
        away = np.minimum(away, distances(vectors, vectors[picked[-1:]], metric)[:, 0])
    return vectors[picked]


def _measured(df: DataFrame, vector: str, pivots: np.ndarray, metric: str) -> DataFrame:
    """``df`` with its nearest pivot and the distance to it; rows without a usable vector go."""
    def run(batches):
        for b in batches:
            mat = _matrix(b.column(vector))
            ok = _usable(mat, metric) if len(mat) else np.zeros(0, dtype=bool)
            if ok.any():
                away = distances(mat[ok], pivots, metric)
                b = b.filter(pa.array(ok))
                yield b.append_column("pivot", pa.array(away.argmin(1).astype(np.int32))).append_column("dist", pa.array(away.min(1)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, pivot int, dist double")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(payload) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


class Found:
    """Rows of a chunk block: vectors, ids and the places of each pair of roles and level."""

    def __init__(self, table: pa.Table, metric: str, authorize: bool):
        self.vectors = _matrix(table.column("embedding"))
        self.near = _comparable(self.vectors, metric)
        self.ids = np.empty(len(self.vectors), dtype=object)
        self.ids[:] = table.column("ids").to_pylist()
        self.first = np.array([x[0] for x in self.ids], dtype=object)
        self.terms: dict = {}
        if authorize:
            for i, (roles, level) in enumerate(zip(table.column("acl_roles").to_pylist(), table.column("level").to_pylist())):
                self.terms.setdefault((tuple(roles or ()), level), []).append(i)
        else:
            self.terms[None] = np.arange(len(self.vectors))


def _comparable(vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
    return vectors


class Asked:
    """A block of queries and the best k of each among the chunk blocks met."""

    def __init__(self, table: pa.Table, k: int, metric: str, authorize: bool):
        self.k, self.metric = k, metric
        self.qids = table.column("query_id").to_numpy()
        self.vectors = _matrix(table.column("qvec"))
        self.near = _comparable(self.vectors, metric)
        self.floor = np.full(len(self.qids), -np.inf)
        if "floor" in table.column_names:
            given = table.column("floor").to_numpy()
            self.floor = np.where(np.isnan(given), -np.inf, given)
        self.held: list[pd.DataFrame] = []
        self.rows = 0
        self.opened: dict = {None: np.arange(len(self.qids))}
        if authorize:
            roles = table.column("roles").to_pylist()
            self.vocab: dict = {}
            for rs in roles:
                for r in rs or ():
                    self.vocab.setdefault(r, len(self.vocab))
            self.bits, self.level = _role_bits(roles, self.vocab), table.column("clearance_level").to_numpy()

    def _open(self, terms) -> np.ndarray:
        """The queries that ``terms`` let see a chunk."""
        if terms not in self.opened:
            roles, level = terms
            meets = ((self.bits & _role_bits([roles], self.vocab)) != 0).any(axis=1)
            self.opened[terms] = np.flatnonzero(meets & (level <= self.level))
        return self.opened[terms]

    def meet(self, part: Found) -> None:
        for terms, places in part.terms.items():
            asked, places = self._open(terms), np.asarray(places)
            step = max(1, SCORE_CELLS // max(len(asked), 1))
            for lo in range(0, len(places) if len(asked) else 0, step):
                self._score(part, places[lo:lo + step], asked)

    def _score(self, part: Found, places: np.ndarray, asked: np.ndarray) -> None:
        q, c = self.near[asked], part.near[places]
        s = q @ c.T
        d = q.shape[1]
        least = self.floor[asked]
        if self.metric == "cosine":
            slack = np.full(len(asked), (d + 8) * float(np.finfo(np.float32).eps))
        else:  # the squared distance, which has no root to enlarge the rounding
            qq, cc = np.sum(q * q, axis=1), np.sum(c * c, axis=1)
            s = 2.0 * s - qq[:, None] - cc[None, :]
            slack = (d + 8) * 4 * np.finfo(np.float64).eps * (qq + cc.max())
            with np.errstate(over="ignore", invalid="ignore"):
                least = np.where(np.isfinite(least), -2.0 * (1.0 - least) ** 2 * (1 + 1e-12) - 1e-30, -np.inf)
        bar = least - slack
        none = np.flatnonzero(np.isneginf(bar))
        if len(none) and len(places) > self.k:
            bar[none] = np.partition(s[none], len(places) - self.k, axis=1)[:, len(places) - self.k] - 2 * slack[none]
        # a score that rounds to its type's nearest must not fall under the bar by the comparison alone
        near = s >= (np.nextafter(bar.astype(np.float32), np.float32(-np.inf)) if s.dtype == np.float32 else bar)[:, None]
        # few queries have any here, and finding the places in the whole matrix takes longer than the product
        some = np.flatnonzero(near.any(axis=1))
        flat = np.flatnonzero(near[some])
        qi, ci = some[flat // len(places)], flat % len(places)
        for lo in range(0, len(qi), RESCORE_ROWS):
            at, of = asked[qi[lo:lo + RESCORE_ROWS]], places[ci[lo:lo + RESCORE_ROWS]]
            score = _exact(part.vectors[of], self.vectors[at], self.metric)
            keep = np.isfinite(score) & (score >= self.floor[at])
            at, of, score = at[keep], of[keep], score[keep]
            self.held.append(pd.DataFrame({"q": at, "chunk_id": part.first[of], "score": score, "ids": part.ids[of]}))
            self.rows += len(at)
            if self.rows > 2 * self.k * len(self.qids) + RESCORE_ROWS:
                self._cut()

    def _cut(self) -> None:
        floor = self.floor.copy()
        self.held = [_trim(self.held, self.k, floor)]
        self.floor = np.maximum(self.floor, floor)
        self.rows = len(self.held[0])

    def best(self):
        """(query_id, chunk_id, score, rank): the k best of each query, all ids of equal vectors counted."""
        if not self.rows:
            return
        self._cut()
        all_rows = self.held[0]
        for lo in range(0, len(self.qids), 1024):
            rows = all_rows[(all_rows["q"] >= lo) & (all_rows["q"] < lo + 1024)]
            if len(rows):
                rows = rows[["q", "score", "ids"]].explode("ids").sort_values(["q", "score", "ids"], ascending=[True, False, True])
                rank = rows.groupby("q").cumcount() + 1
                rows = rows[(rank <= self.k).to_numpy()]
                yield pd.DataFrame({"query_id": self.qids[rows["q"].to_numpy()], "chunk_id": rows["ids"].to_numpy(), "score": rows["score"].to_numpy(),
                                    "rank": rank[rank <= self.k].to_numpy().astype(np.int32)})


RANKED = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64()), ("rank", pa.int32())])
FLOORS = pa.schema([("query_id", pa.int64()), ("floor", pa.float64())])


def distinct_vectors(c: DataFrame, k: int, tenant_scoped: bool, authorize: bool) -> DataFrame:
    """scope, embedding[, acl_roles, level], ids: chunks that differ in nothing but their id as one row with the k least ids."""
    key = (["tenant_id"] if tenant_scoped else []) + ["embedding"] + (["acl_roles", "level"] if authorize else [])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("chunk_id"))
    rows = c.withColumn("place", place).where(F.col("place") <= k).groupBy(*key).agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return rows.select((F.col("tenant_id").cast("string") if tenant_scoped else F.lit("")).alias("scope"), *(x for x in key if x != "tenant_id"), "ids")


def search_cells(q: DataFrame, c: DataFrame, k: int, metric: str, tenant_scoped: bool, authorize: bool, *,
                 block_chunks: int = BLOCK_CHUNKS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, chunk_id, score, rank); columns of ``q`` and ``c`` as ``vector_search`` selects them."""
    spark = q.sparkSession
    ensure_checkpoint_dir(spark)
    empty = spark.createDataFrame([], CANDIDATE_SCHEMA + ", rank int")
    rows = cut(distinct_vectors(c, k, tenant_scoped, authorize))
    # a pool without a usable vector still needs one pivot; any vector is right
    pivots = _pivots(rows, metric)
    if not len(pivots):
        pivots = _pivots(rows.where(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) > 0), metric)
        if not len(pivots):
            return empty
    rows = _measured(rows, "embedding", pivots, metric)
    asked = q.withColumn("scope", F.col("tenant_id").cast("string") if tenant_scoped else F.lit("")).drop("tenant_id")
    asked = cut(_measured(asked, "qvec", pivots, metric).drop("dist"))
    cells = rows.groupBy("scope", "pivot").agg(F.ceil(F.count(F.lit(1)) / block_chunks).alias("blocks"))
    sizes = asked.groupBy("scope", "pivot").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(cells.join(sizes, ["scope", "pivot"], "full").select("scope", "pivot", "blocks", F.ceil(F.col("n") / block_queries).alias("q_parts"),
                                                                   F.ceil(F.col("n") / F.col("blocks") / block_queries).alias("parts")))
    n_cells, n_parts = cells.agg(F.count(F.lit(1)), F.sum("q_parts")).first()
    if not n_parts:
        return empty
    small = F.broadcast if n_cells <= CELLS_BROADCAST else lambda df: df
    key = ["scope", "pivot"]
    block_of = F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("blocks")).alias("block")
    rows = rows.join(small(cells.where("blocks IS NOT NULL")), key)
    terms = ["acl_roles", "level"] if authorize else []

    def pack(table: pa.Table) -> pa.Table:
        dist = table.column("dist").to_numpy()
        told = {"scope": table.column("scope")[0].as_py(), "pivot": table.column("pivot")[0].as_py(), "block": table.column("block")[0].as_py()}
        return pa.Table.from_pylist([told | {"low": float(dist.min()), "high": float(dist.max()), "payload": _packed(table.select(["embedding", *terms, "ids"]))}], PACKED)

    blocks = cut(rows.select(*key, block_of, "dist", "embedding", *terms, "ids").groupBy(*key, "block").applyInArrow(pack, "scope string, pivot int, block long, low double, high double, payload binary"))

    # each query meets one block of its cell: the k-th score there is its floor
    home = [*key, "block", "part"]
    met = rows.where("parts IS NOT NULL").select(*key, block_of, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "embedding", *terms, "ids")
    own = asked.join(small(cells.where("blocks IS NOT NULL")), key).withColumns({"block": F.pmod(F.xxhash64("query_id"), F.col("blocks")), "part": F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("parts"))})

    def floors(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and chunks.num_rows:
            block = Asked(queries, k, metric, authorize)
            block.meet(Found(chunks, metric, authorize))
            found = [f[f["rank"] == k].rename(columns={"score": "floor"})[["query_id", "floor"]] for f in block.best()]
        return pa.concat_tables([pa.Table.from_pandas(f, FLOORS, preserve_index=False) for f in found]) if found else FLOORS.empty_table()

    floor = own.drop("blocks", "q_parts", "parts").groupBy(*home).cogroup(met.groupBy(*home)).applyInArrow(floors, "query_id long, floor double")

    def pack_queries(table: pa.Table) -> pa.Table:
        away = distances(_matrix(table.column("qvec")), pivots, metric)
        floor = table.column("floor").to_numpy()
        told = {"q_scope": table.column("scope")[0].as_py(), "q_block": f"{table.column('pivot')[0]}:{table.column('part')[0]}", "near": away.min(0).tolist(), "far": away.max(0).tolist(),
                "least": None if np.isnan(floor).any() else float(floor.min()), "q_payload": _packed(table.drop_columns(["scope", "pivot", "part"]))}
        return pa.Table.from_pylist([told], PACKED_QUERIES)

    part = [*key, "part"]
    queries = asked.join(floor, "query_id", "left").join(small(cells.select(*key, "q_parts")), key).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("q_parts"))).drop("q_parts")
    queries = queries.repartition(min(int(n_parts), MAX_TASKS), *part).groupBy(*part).applyInArrow(pack_queries, "q_scope string, q_block string, near array<double>, far array<double>, least double, q_payload binary")

    def search(batches):
        held: dict = {}
        last, chunks = None, None
        for b in batches:
            names = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                to, of = (names["scope"][i].as_py(), names["q_block"][i].as_py()), (names["scope"][i].as_py(), names["pivot"][i].as_py(), names["block"][i].as_py())
                if to not in held:
                    held[to] = Asked(_unpacked(names["q_payload"][i].as_buffer()), k, metric, authorize)
                if of != last:
                    last, chunks = of, Found(_unpacked(names["payload"][i].as_buffer()), metric, authorize)
                held[to].meet(chunks)
        for block in held.values():
            for f in block.best():
                yield from pa.Table.from_pandas(f, RANKED, preserve_index=False).to_batches()
        held.clear()
        chunks = None
        release()

    # one partition on the chunks' side: a task reads them one after the other for its own query blocks
    bound = best_score(F.get("near", F.col("pivot")), F.col("low"), F.col("high"), metric, F.get("far", F.col("pivot")))
    meets = (F.col("scope") == F.col("q_scope")) & (F.col("least").isNull() | (bound >= F.col("least")))
    pairs = blocks.coalesce(1).hint("shuffle_replicate_nl").join(queries, meets)
    return pairs.select("scope", "pivot", "block", "q_block", "payload", "q_payload").mapInArrow(search, CANDIDATE_SCHEMA + ", rank int")


PACKED = pa.schema([("scope", pa.string()), ("pivot", pa.int32()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("payload", pa.binary())])
PACKED_QUERIES = pa.schema([("q_scope", pa.string()), ("q_block", pa.string()), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64())), ("least", pa.float64()), ("q_payload", pa.binary())])

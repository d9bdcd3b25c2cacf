"""Exact top-k vector search.

Plan shape: a query batch that fits (its rows and bytes are checked in the job
that fetches it) is broadcast, and each chunk partition scores its rows with
numpy matrix products, one Arrow batch at a time.  A task holds the best ``k``
of each query and only these leave it, so the chunk side is never shuffled and
no query×chunk pair is ever written out; a final ``row_number() <= k`` window
(planned with a partial WindowGroupLimit) picks the global top-k per query.
Hot tenants therefore cost CPU in the tasks that hold their chunks, not shuffle
volume.  Larger batches (or ``method="cells"``) stay on the executors, and both sides
are shuffled once: see ``operators/cells.py``.  A score that is no number (zero vectors) is no candidate.

``method="sql"`` is the same search written as a tenant equi-join against
the broadcast query block with a higher-order dot product; it is kept as
the reference plan and for callers that want no Python workers at all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield.functions import vectors as V

BROADCAST_MAX_QUERIES = 20000
BROADCAST_MAX_BYTES = 64 << 20

CANDIDATE_SCHEMA = "query_id long, chunk_id string, score double"
SCORE_CELLS = 4_000_000


def bounded_rows(df: DataFrame, limit: int) -> int:
    """Row count, stopping after ``limit + 1`` rows (bounded cost)."""
    return df.limit(limit + 1).count()


def _topk_window(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _role_bits(roles_lists, vocab):
    """Role sets as bitmasks: one row of 64-bit words for each list."""
    out = np.zeros((len(roles_lists), len(vocab) // 64 + 1), dtype=np.uint64)
    for i, rs in enumerate(roles_lists):
        for r in (rs if rs is not None else []):
            j = vocab.get(r)
            if j is not None:
                out[i, j // 64] |= np.uint64(1 << (j % 64))
    return out


def _roles_meet(a, b):
    """Which of ``a``'s role sets (rows) share a role with which of ``b``'s (columns)."""
    meet = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(a.shape[1]):
        meet |= (a[:, None, k] & b[None, :, k]) != 0
    return meet


def _block_payload(block: pd.DataFrame, metric: str, tenant_scoped: bool, authorize: bool):
    qids = block["query_id"].to_numpy(dtype=np.int64)
    qmat = np.vstack([np.asarray(v, dtype=np.float64) for v in block["qvec"]])
    payload = {"qids": qids, "qmat": qmat, "qnorm": np.linalg.norm(qmat, axis=1),
               "qsq": np.sum(qmat * qmat, axis=1), "metric": metric,
               "qten": block["tenant_id"].to_numpy(dtype=object) if tenant_scoped else None}
    if authorize:
        vocab = {}
        for rs in block["roles"]:
            for r in (rs if rs is not None else []):
                vocab.setdefault(r, len(vocab))
        payload.update(vocab=vocab, qbits=_role_bits(list(block["roles"]), vocab),
                       qlevel=block["clearance_level"].to_numpy(dtype=np.int64))
    return payload


#: Rounding of a matrix product depends on a row's place in it; scores this close count as equal until they are re-scored.
TIE_SLACK = 1e-9
RESCORE_ROWS = 100_000


def _fold(a: np.ndarray) -> np.ndarray:
    """Row sums from left to right, as ``aggregate`` adds: the same vector gets the same sum in any batch."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k]
    return total


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """``vectors.cosine`` or ``vectors.l2_relevance`` of paired rows, in their order of operations."""
    if metric == "cosine":
        return _fold(a * b) / (np.sqrt(_fold(a * a)) * np.sqrt(_fold(b * b)))
    return 1.0 - np.sqrt(_fold((a - b) * (a - b))) / math.sqrt(2.0)


def _trim(held: list[pd.DataFrame], k: int, floor: np.ndarray) -> pd.DataFrame:
    """The k best rows of each query; ``floor`` takes the k-th score of those that have k."""
    best = pd.concat(held, ignore_index=True).sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
    place = best.groupby("q").cumcount()
    full = best[place == k - 1]
    floor[full["q"].to_numpy()] = full["score"].to_numpy()
    return best[place < k]


def best_of(frames, p: dict, k: int):
    """(query_id, chunk_id, score): at most k rows for each query of the payload over all ``frames`` of chunks."""
    qids, held, rows = p["qids"], [], 0
    floor = np.full(len(qids), -np.inf)
    # bound each score matrix to ~4M doubles (32 MB) whatever the block size
    step = max(1, SCORE_CELLS // max(len(qids), 1))
    for big in frames:
        for lo in range(0, len(big), step):
            for part in _score(big.iloc[lo:lo + step], p, k, floor):
                held.append(part)
                rows += len(part)
                if rows > 2 * k * len(qids) + RESCORE_ROWS:
                    held = [_trim(held, k, floor)]
                    rows = len(held[0])
    if held:
        best = _trim(held, k, floor)
        for lo in range(0, len(best), RESCORE_ROWS):
            part = best.iloc[lo:lo + RESCORE_ROWS]
            yield pd.DataFrame({"query_id": qids[part["q"].to_numpy()], "chunk_id": part["chunk_id"].to_numpy(),
                                "score": part["score"].to_numpy()})


def _score(pdf: pd.DataFrame, p: dict, k: int, floor: np.ndarray):
    qmat = p["qmat"]
    cmat = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
    dots = cmat @ qmat.T
    if p["metric"] == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            s = dots / (np.linalg.norm(cmat, axis=1)[:, None] * p["qnorm"][None, :])
    else:  # l2 relevance
        d2 = np.sum(cmat * cmat, axis=1)[:, None] + p["qsq"][None, :] - 2.0 * dots
        s = 1.0 - np.sqrt(np.maximum(d2, 0.0)) / math.sqrt(2.0)
    s = np.where(np.isfinite(s), s, -np.inf)
    if p["qten"] is not None:
        ct = pdf["tenant_id"].to_numpy(dtype=object)
        s = np.where(ct[:, None] == p["qten"][None, :], s, -np.inf)
    if "vocab" in p:
        cbits = _role_bits(list(pdf["acl_roles"]), p["vocab"])
        clev = pdf["level"].to_numpy(dtype=np.int64)
        ok = _roles_meet(cbits, p["qbits"]) & (clev[:, None] <= p["qlevel"][None, :])
        s = np.where(ok, s, -np.inf)
    # the k-th best score per query so far, less the rounding of the matrix product: whatever could
    # be among the k best, ties included, is scored anew
    least = floor
    if k < len(s):
        least = np.maximum(least, -np.partition(-s, k - 1, axis=0)[k - 1])
    ri, qi = np.nonzero((s >= least[None, :] - TIE_SLACK) & np.isfinite(s))
    for lo in range(0, len(ri), RESCORE_ROWS):
        r, q = ri[lo:lo + RESCORE_ROWS], qi[lo:lo + RESCORE_ROWS]
        yield pd.DataFrame({"q": q, "chunk_id": pdf["chunk_id"].to_numpy(dtype=object)[r],
                            "score": _exact(cmat[r], qmat[q], p["metric"])})


def _scorer(bc, k: int):
    """mapInPandas body: the chunks of a task against the broadcast query block."""
    def run(batches):
        yield from best_of(batches, bc.value, k)
    return run


def vector_search(queries: DataFrame, chunks: DataFrame, k: int, *, metric: str = "cosine",
                  tenant_scoped: bool = True, authorize: bool = False, method: str = "arrow",
                  broadcast_max: int = BROADCAST_MAX_QUERIES) -> DataFrame:
    """Top-k chunks per query: (query_id, chunk_id, score, rank).

    ``queries(query_id, tenant_id, qvec[, roles, clearance_level])``;
    ``chunks(chunk_id, tenant_id, embedding[, acl_roles, level])``.  Ties are
    broken by chunk_id.  ``tenant_scoped``: a query only sees its tenant's
    chunks.  ``authorize``: the graph pre-filter (J1/J2) — a chunk is a
    candidate only if one of its ACL roles is a query role and its level is
    within the query's clearance.  Both filters apply before the top-k, as
    the store-side filter does.
    """
    if metric not in ("cosine", "l2_relevance"):
        raise ValueError("metric must be cosine or l2_relevance")
    qcols = ["query_id", "tenant_id", "qvec"] + (["roles", "clearance_level"] if authorize else [])
    ccols = ["chunk_id", "tenant_id", "embedding"] + (["acl_roles", "level"] if authorize else [])
    q = queries.select(*qcols).where(F.col("qvec").isNotNull())
    c = chunks.select(*ccols).where(F.col("embedding").isNotNull())
    if tenant_scoped:
        q, c = q.where(F.col("tenant_id").isNotNull()), c.where(F.col("tenant_id").isNotNull())
    if method == "sql":
        return _search_sql(q, c, k, metric, tenant_scoped, authorize, broadcast_max)
    if method == "arrow":
        # one job both checks the size and fetches the block: at most broadcast_max + 1 rows reach the driver
        block = q.limit(broadcast_max + 1).toPandas()
        if len(block) == 0:
            return queries.sparkSession.createDataFrame([], CANDIDATE_SCHEMA + ", rank int")
        if len(block) <= broadcast_max and _payload_bytes(block) <= BROADCAST_MAX_BYTES:
            bc = queries.sparkSession.sparkContext.broadcast(_block_payload(block, metric, tenant_scoped, authorize))
            return _topk_window(c.mapInPandas(_scorer(bc, k), CANDIDATE_SCHEMA), k)
    from docshield.operators.cells import search_cells
    return search_cells(q, c, k, metric, tenant_scoped, authorize)


def _payload_bytes(block: pd.DataFrame) -> int:
    return 8 * int(block["qvec"].map(len).sum())


def _search_sql(q, c, k, metric, tenant_scoped, authorize, broadcast_max):
    if not tenant_scoped:
        raise ValueError("the sql method needs an equi-join key; use method='arrow' for global search")
    n = bounded_rows(q, broadcast_max)
    qb = F.broadcast(q) if n <= broadcast_max else q
    qd = qb.withColumnRenamed("tenant_id", "q_tenant")
    j = c.join(qd, c.tenant_id == qd.q_tenant)
    if authorize:
        j = j.where(F.arrays_overlap("acl_roles", "roles") & (F.col("level") <= F.col("clearance_level")))
    a, b = V.as_double("embedding"), V.as_double("qvec")
    score = V.cosine(a, b) if metric == "cosine" else V.l2_relevance(a, b)
    cands = j.select("query_id", "chunk_id", score.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return _topk_window(cands, k)

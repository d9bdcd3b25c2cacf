"""Guarded retrieval (R8, T1, T2, W1, T18) and the ACL retrieve variant.

Shape: one vector search with the store-side pre-filters (tenant, graph
authorization), then bounded joins that attach chunk and query attributes
to the k×overfetch candidates, one window per query for the trust scan
stop-rule, and a per-query aggregate of at most ``top_k`` chunks for the
context.  Nothing here groups more than ``top_k * overfetch`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import access as A
from docshield.functions import text as T
from docshield.operators.access import with_graph
from docshield.operators.search import bounded_rows, vector_search
from docshield.sources.files import cut

#: Hashes of chunk ids (8 bytes each) that are broadcast, at most.
WANTED_BROADCAST = 2_000_000


def prepare_queries(queries: DataFrame) -> DataFrame:
    return queries.withColumn("clearance_level", A.clearance_level("roles"))


def prepare_chunks(chunks: DataFrame, strict: bool = C.UNKNOWN_CLASS_STRICT) -> DataFrame:
    return chunks.withColumn("level", A.level_index("sensitivity_class", strict))


def retrieve_candidates(queries: DataFrame, chunks: DataFrame, *, top_k: int = C.TOP_K,
                        overfetch: int = C.OVERFETCH_FACTOR, threshold: float = C.SIMILARITY_THRESHOLD,
                        use_graph: bool = True, method: str = "arrow", graph: DataFrame | None = None,
                        texts: bool = True) -> DataFrame:
    """Candidates with their filter outcome, trust and action, per query.

    ``graph``: profiles of the registered documents (``access.graph_profiles``); the search then only sees chunks
    whose document the graph's edges open to the query.  Without it the chunk's own roles and class stand for the edges.

    A chunk's trust is judged once, before it meets its candidates, and no text passes the search, the joins or the
    window: ``with_texts`` adds it to the rows that need it (``texts``: to all).

    Output: query_id, rank, chunk_id, doc_id, score, block_reason, trust,
    action (blocked | drop | wrap | pass | unscanned), used, counted_blocked[,
    chunk_text, text (wrapped when flagged)].
    """
    q = prepare_queries(queries)
    c = prepare_chunks(chunks)
    searched = c if graph is None else with_graph(c, graph)
    cands = vector_search(q, searched, top_k * overfetch, tenant_scoped=True, authorize=use_graph, method=method)
    # the one-row explode keeps Catalyst from cutting the text anew for each phrase of the trust
    meta = c.select("chunk_id", "doc_id", F.col("tenant_id").alias("chunk_tenant"), "level",
                    "sensitivity_class", "acl_roles", F.explode(F.array("text")).alias("text")) \
        .withColumn("trust", T.trust_tenths("text")).drop("text")
    qa = q.select("query_id", "tenant_id", "roles", "clearance_level")
    j = cands.join(meta, "chunk_id").join(qa, "query_id")
    block = (F.when(F.col("score") < threshold, "below_threshold")
             .when(F.col("chunk_tenant") != F.col("tenant_id"), "tenant_boundary")
             .when(F.col("level") > F.col("clearance_level"), "clearance_insufficient")
             .when(~A.role_match("acl_roles", "roles"), "acl_role_mismatch"))
    j = j.withColumn("block_reason", block)
    passing = F.col("block_reason").isNull()
    kept = passing & (F.col("trust") >= 4)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("kept_upto", F.sum(F.when(kept, 1).otherwise(0)).over(w))
    scanned = passing & ((kept & (F.col("kept_upto") <= top_k)) | (~kept & (F.col("kept_upto") < top_k)))
    action = (F.when(~passing, "blocked").when(~scanned, "unscanned")
              .when(F.col("trust") < 4, "drop").when(F.col("trust") < 6, "wrap").otherwise("pass"))
    j = j.withColumn("action", action)
    # written once: logs and answers read the same candidates, and none of them searches again
    decided = cut(j.select(
        "query_id", "rank", "chunk_id", "doc_id", "score", "block_reason", "trust", "action",
        F.col("action").isin("wrap", "pass").alias("used"),
        (F.col("action").isin("blocked", "drop")).alias("counted_blocked")))
    return with_texts(decided, chunks) if texts else decided


def with_texts(cands: DataFrame, chunks: DataFrame) -> DataFrame:
    """``retrieve_candidates``' rows with chunk_text, and text as the context shows it.

    Only texts whose chunk is among ``cands`` are shuffled, as long as the hashes of its ids can be broadcast; a text that
    gets through by an equal hash meets no row in the join."""
    texts = chunks.select("chunk_id", F.col("text").alias("chunk_text"))
    wanted = cands.select(F.xxhash64("chunk_id").alias("wanted")).distinct()
    if bounded_rows(wanted, WANTED_BROADCAST) <= WANTED_BROADCAST:
        texts = texts.join(F.broadcast(wanted), F.xxhash64("chunk_id") == F.col("wanted"), "left_semi")
    wrapped = F.concat(F.lit("[FLAGGED UNTRUSTED CHUNK (Trust: "), T.trust_display("trust"), F.lit(")]\n"),
                       F.col("chunk_text"), F.lit(C.FLAG_CLOSE))
    j = cands.join(texts, "chunk_id")
    return j.select(*cands.columns, "chunk_text", F.when(F.col("action") == "wrap", wrapped).otherwise(F.col("chunk_text")).alias("text"))


def retrieval_summary(queries: DataFrame, cands: DataFrame) -> DataFrame:
    """Chunks used and blocked count per query (queries without
    candidates get zeros)."""
    agg = cands.groupBy("query_id").agg(
        F.count_if("used").alias("chunks_used"), F.count_if("counted_blocked").alias("rbac_blocked"))
    return queries.select("query_id").join(agg, "query_id", "left").select(
        "query_id", F.coalesce("chunks_used", F.lit(0)).cast("bigint").alias("chunks_used"),
        F.coalesce("rbac_blocked", F.lit(0)).cast("bigint").alias("rbac_blocked"))


def build_context(cands: DataFrame) -> DataFrame:
    """Used chunk texts in rank order, fenced (at most top_k per query)."""
    used = cands.where("used")
    g = used.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    ctx = F.array_join(F.transform("parts", lambda x: x["text"]), C.CONTEXT_SEPARATOR)
    return g.select("query_id", ctx.alias("context"),
                    F.concat(F.lit(C.CONTEXT_BEGIN), ctx, F.lit(C.CONTEXT_END)).alias("fenced_context"))


def prompt_message(fenced, question) -> "F.Column":
    return F.concat(F.lit("Context:\n"), fenced, F.lit(C.CONTEXT_REMINDER), F.lit("\n\nQuestion: "), question)


def acl_retrieve(queries: DataFrame, chunks: DataFrame, *, top_k: int = C.TOP_K,
                 fetch_k: int = C.ACL_FETCH_K, mode: str = "drop") -> DataFrame:
    """Unfiltered top fetch_k, then the RBAC filter, then the first top_k.

    Post-filter semantics: fewer than top_k rows can come back.
    """
    from docshield.operators.access import rbac_decide, rbac_apply
    cands = vector_search(queries, chunks, fetch_k, tenant_scoped=False)
    meta = chunks.select("chunk_id", F.col("tenant_id").alias("chunk_tenant"), "sensitivity_class",
                         "acl_roles", "acl_users", "text")
    qa = queries.select("query_id", "user_id", "tenant_id", "roles")
    d = rbac_decide(cands.join(meta, "chunk_id").join(qa, "query_id"))
    kept = rbac_apply(d, mode)
    w = Window.partitionBy("query_id").orderBy("rank")
    return (kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top_k), d)

"""The guarded query pipeline as one DataFrame plan (§3.2).

queries → daily budget (W2) → two-pass routing (T13–T17) → clearance (R2) →
graph-authorized, tenant-scoped search (J1–J3) → filter order (R8) → trust
scan (T1, T2) → context (T18) → answers (input) → canary + PII re-scan
(O1, O2) → grounding (T20) → one row per query (O3, A11), plus the audit,
canary and injection logs (S8–S10).

Shuffles: the budget window (by user, day), the search's top-k window (by
query), and joins keyed by query id.  Only non-blocked queries are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.operators import answers as AN
from docshield.operators import retrieval as R
from docshield.operators import route as RT
from docshield.sources import fixtures as FX
from docshield.sources.files import cut


def budget(queries: DataFrame, max_per_day: int = C.DAILY_QUERY_BUDGET) -> DataFrame:
    """N-th request of a user on a UTC day; over the budget ⇒ blocked.
    Blocked requests still count toward the day."""
    from docshield.operators.analytics import daily_budget
    return daily_budget(queries, max_per_day, key="user_id", order=("ts", "query_id")) \
        .withColumnRenamed("allowed", "budget_ok")


def run(queries: DataFrame, chunks: DataFrame, scores: DataFrame, answers: DataFrame,
        rewrites: DataFrame | None = None, *, person_names=None,
        max_per_day: int = C.DAILY_QUERY_BUDGET, method: str = "arrow", graph: DataFrame | None = None):
    """Returns (per_query, candidates without texts).  ``graph``: see ``retrieval.retrieve_candidates``."""
    q = budget(queries, max_per_day)
    q = RT.two_pass(q, scores, rewrites)
    q = q.withColumn("stage_block", F.when(~F.col("budget_ok"), F.lit("dp_budget_exceeded"))
                     .when(F.col("route.action") == "block", F.col("route.category")))
    # written once: the search, its candidates and each log read the routed queries, and each log the answers
    q = cut(q)
    a = cut(answers.select("query_id", "response", "latency_ms"))
    allowed = q.where(F.col("stage_block").isNull())
    decided = R.retrieve_candidates(allowed, chunks, method=method, graph=graph, texts=False)
    used = R.with_texts(decided.where("used"), chunks)
    # two bounded aggregates give the counts and the (<= top_k) context parts: only used chunks are fetched with their text
    counts = decided.groupBy("query_id").agg(
        F.count_if("used").alias("chunks_used"), F.count_if("counted_blocked").alias("rbac_blocked"))
    parts = used.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    per_q = counts.join(parts, "query_id", "left").select(
        "query_id", "chunks_used", "rbac_blocked",
        F.array_join(F.transform("parts", lambda x: x["text"]), C.CONTEXT_SEPARATOR).alias("context"))
    j = q.join(per_q, "query_id", "left").join(a, "query_id", "left")
    answered = F.col("stage_block").isNull() & (F.coalesce("chunks_used", F.lit(0)) > 0)
    j = j.withColumn("status", F.when(F.col("stage_block").isNotNull(), "blocked")
                     .when(~answered, "no_context").otherwise("answered"))
    j = j.withColumn("llm_response", F.when(answered, F.coalesce("response", F.lit(C.BREAKER_RESPONSE))))
    j = AN.sanitize(j, "llm_response", "out", person_names=person_names)
    safe = (F.when(F.col("status") == "blocked", F.concat(F.lit("Your request was blocked: "), F.col("stage_block"), F.lit(".")))
            .when(F.col("status") == "no_context", F.lit(C.NO_CONTEXT_RESPONSE))
            .otherwise(F.col("out_safe")))
    is_ans = F.col("status") == "answered"
    per_query = j.select(
        "query_id", "user_id", "tenant_id", "session_id", "ts", "query", "standalone_query", "safe_query",
        "route", "blocked_at", "stage_block", "status", safe.alias("safe_response"),
        F.when(is_ans, F.col("chunks_used")).otherwise(F.lit(0)).cast("bigint").alias("chunks_used"),
        F.when(is_ans, F.col("rbac_blocked")).otherwise(F.lit(0)).cast("bigint").alias("rbac_blocked"),
        F.when(is_ans, F.col("out_pii_count")).otherwise(F.lit(0)).cast("bigint").alias("pii_redacted"),
        (is_ans & (F.size("out_canaries") > 0)).alias("canary_leaked"),
        F.when(is_ans, F.col("out_canaries")).otherwise(F.array().cast("array<string>")).alias("canary_tokens"),
        F.when(is_ans, F.col("out_violations")).otherwise(F.lit("[]")).alias("violations"),
        F.when(is_ans, AN.grounding(F.col("out_safe"), F.col("context"))).otherwise(F.lit("none")).alias("hallucination_risk"),
        F.coalesce("latency_ms", F.lit(0)).cast("bigint").alias("latency_ms"))
    return per_query, decided


def for_tables(spark, sf, **kw):
    return run(FX.queries(spark, sf), FX.chunks(spark, sf), FX.scores(spark, sf), FX.answers(spark, sf),
               FX.rewrites(spark, sf), person_names=FX.PERSON_NAMES, **kw)


def trace_id(query_id) -> "F.Column":
    return F.sha2(F.concat(F.lit("trace|"), F.col(query_id).cast("string")), 256)


def audit_log(per_query: DataFrame, *, compat: bool = False, person_names=None,
              model: str = "gemini-1.5-flash") -> DataFrame:
    """S10 with H1 scrub-before-log and the H3 checksum.  ``compat`` keeps
    only answered queries, as the original writes audit rows only there."""
    d = per_query if not compat else per_query.where(F.col("status") == "answered")
    d = d.withColumn("trace_id", trace_id("query_id")) \
         .withColumn("logged_query", F.coalesce("safe_query", "query"))
    d = AN.sanitize(d, "logged_query", "aq", person_names=person_names)
    d = AN.sanitize(d, "safe_response", "ar", person_names=person_names)
    return d.select(
        F.col("trace_id").alias("id"), "trace_id", F.col("user_id").cast("string").alias("user_id"), "tenant_id",
        F.col("aq_safe").alias("query"), F.col("ar_safe").alias("response"), "chunks_used", "rbac_blocked",
        "pii_redacted", "canary_leaked", "violations", "latency_ms", F.lit(model).alias("model"),
        F.col("route.action").alias("route_action"), F.col("route.category").alias("route_category"),
        F.col("ts").alias("timestamp"),
        AN.audit_checksum(F.col("trace_id"), F.col("user_id"), F.col("aq_safe"), F.col("ts")).alias("checksum"))


def canary_alerts(per_query: DataFrame) -> DataFrame:
    """One row per leaked token."""
    d = per_query.where("canary_leaked").select("query_id", "user_id", "tenant_id", "safe_query", "ts",
                                               F.explode("canary_tokens").alias("canary_token"))
    return d.select(F.sha2(F.concat_ws("|", trace_id("query_id"), "canary_token"), 256).alias("id"),
                    trace_id("query_id").alias("trace_id"), F.col("user_id").cast("string").alias("user_id"),
                    "tenant_id", "canary_token", F.col("safe_query").alias("query"), F.col("ts").alias("detected_at"))


def injection_log(per_query: DataFrame, cands: DataFrame, chunks: DataFrame) -> DataFrame:
    """Raw-query blocks, rephrased-query blocks and flagged chunks (``chunks`` has their texts)."""
    base = [trace_id("query_id").alias("trace_id"), F.col("user_id").cast("string").alias("user_id"), "tenant_id"]
    raw = per_query.where(F.col("blocked_at") == "raw").select(
        "query_id", *base, F.col("query").alias("raw_query"), F.col("route.action").alias("action"),
        F.col("route.category").alias("category"), F.col("route.confidence").alias("confidence"),
        F.col("ts").alias("detected_at"), F.lit(0).alias("k"))
    reph = per_query.where(F.col("blocked_at") == "rephrased").select(
        "query_id", *base, F.col("standalone_query").alias("raw_query"), F.col("route.action").alias("action"),
        F.col("route.category").alias("category"), F.col("route.confidence").alias("confidence"),
        F.col("ts").alias("detected_at"), F.lit(1).alias("k"))
    flagged = R.with_texts(cands.where(F.col("action").isin("drop", "wrap")), chunks).join(
        per_query.select("query_id", "user_id", "tenant_id", "ts"), "query_id")
    chunk_text = F.col("chunk_text")
    fl = flagged.select(
        "query_id", *base, F.concat(F.lit("Retrieved chunk injection: "), F.substring(chunk_text, 1, 200)).alias("raw_query"),
        F.lit("flag").alias("action"), F.lit("indirect_prompt_injection").alias("category"),
        F.round(F.lit(1.0) - F.col("trust") / 10.0, 4).alias("confidence"), F.col("ts").alias("detected_at"),
        (F.lit(100) + F.col("rank")).alias("k"))
    u = raw.unionByName(reph).unionByName(fl)
    return u.select(F.sha2(F.concat_ws("|", F.lit("inj"), F.col("query_id").cast("string"), F.col("k").cast("string")), 256).alias("id"),
                    "trace_id", "user_id", "tenant_id", "raw_query", "action", "category",
                    F.col("confidence").cast("double").alias("confidence"), "detected_at")

"""Registered access-control and retrieval queries (R1–R8, J1–J10, W1, T1, T2,
T18, S12, A12) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import access as A
from docshield.functions import text as T
from docshield.functions import vectors as V
from docshield.operators import access as AO
from docshield.operators import retrieval as R
from docshield.operators.search import vector_search
from docshield.oracle import sql as S
from docshield.oracle.fixtures import with_ctes, LEVELS
from docshield.sources import fixtures as FX
from docshield.sources.files import cut

ROLE_SAMPLES = [("r1", ["employee"]), ("r2", ["contractor"]), ("r3", []), ("r4", ["manager", "employee"]),
                ("r5", ["admin", "anonymous"]), ("r6", ["superadmin"])]


def _q(spark, sf):
    return FX.queries(spark, sf)


def _c(spark, sf):
    return FX.chunks(spark, sf)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def q_vector_topk(spark, sf):
    t = vector_search(_q(spark, sf), _c(spark, sf), C.TOP_K)
    return t.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                    F.round("score", 6).alias("score"))


def q_vector_topk_cells(spark, sf):
    """The same search with neither side on the driver: query blocks meet chunk blocks."""
    t = vector_search(_q(spark, sf), _c(spark, sf), C.TOP_K, method="cells")
    return t.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                    F.round("score", 6).alias("score"))


def q_cosine_pairs(spark, sf):
    q, c = _q(spark, sf), _c(spark, sf)
    t = vector_search(q, c, C.TOP_K)
    j = t.join(q.select("query_id", "qvec"), "query_id").join(c.select("chunk_id", "embedding"), "chunk_id")
    a, b = V.as_double("qvec"), V.as_double("embedding")
    return j.select("query_id", "chunk_id", F.round(V.cosine(a, b), 6).alias("cosine"),
                    F.round(V.l2_relevance(a, b), 6).alias("l2_relevance"),
                    F.round(V.dot(a, b), 6).alias("dot"))


def _global_pairs(spark, sf, k=C.ACL_FETCH_K):
    q, c = _q(spark, sf), _c(spark, sf)
    cands = vector_search(q, c, k, tenant_scoped=False)
    meta = c.select("chunk_id", F.col("tenant_id").alias("chunk_tenant"), "sensitivity_class",
                    "acl_roles", "acl_users", "text")
    qa = q.select("query_id", F.col("user_id").cast("string").alias("user_id"), "tenant_id", "roles")
    return cands.join(meta, "chunk_id").join(qa, "query_id")


def q_access_decision(spark, sf):
    p = _global_pairs(spark, sf)
    return p.select("query_id", "chunk_id", A.resolve_clearance("roles").alias("clearance"),
                    A.access_reason("roles", "sensitivity_class", "acl_roles", "user_id", "acl_users").alias("reason"))


def q_rbac_filter(spark, sf):
    d = AO.rbac_decide(_global_pairs(spark, sf))
    return d.select("query_id", "chunk_id", "reason", "allowed")


def q_rbac_user_acl(spark, sf):
    p = _global_pairs(spark, sf)
    return p.select("query_id", "chunk_id", A.user_match("acl_users", "user_id").alias("user_ok"),
                    A.role_match("acl_roles", "roles").alias("role_ok"))


def q_rbac_modes(spark, sf):
    """Each mode applied to the decided pairs, counted by what it returns; the decisions are made once and written."""
    d = cut(AO.rbac_decide(_global_pairs(spark, sf)).select("query_id", "chunk_id", "reason", "allowed", "text"))
    modes = ("drop", "redact", "audit_only")
    kept = None
    for mode in modes:
        one = AO.rbac_apply(d, mode).select("query_id", F.lit(mode).alias("mode"), (F.col("text") == C.RBAC_REDACTED_TEXT).alias("hidden"))
        kept = one if kept is None else kept.unionByName(one)
    kept = kept.groupBy("query_id", "mode").agg(F.count(F.lit(1)).alias("n_returned"), F.count_if("hidden").alias("n_redacted"))
    blocked = d.groupBy("query_id").agg(F.count_if(~F.col("allowed")).alias("n_blocked"))
    out = blocked.withColumn("mode", F.explode(F.array(*(F.lit(m) for m in modes)))).join(kept, ["query_id", "mode"], "left")
    return out.select("mode", "query_id", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_returned", "n_redacted", "n_blocked")))


def q_rbac_violations(spark, sf):
    d = AO.rbac_decide(_global_pairs(spark, sf))
    v = d.where(~F.col("allowed"))
    from pyspark.sql import Window
    return v.select("query_id", "chunk_id", "reason", "sensitivity_class", "clearance",
                    F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("bigint").alias("blocked_count"))


def q_acl_retrieve(spark, sf):
    q, c = _q(spark, sf), _c(spark, sf)
    q = q.withColumn("user_id", F.col("user_id").cast("string"))
    kept, _ = R.acl_retrieve(q, c)
    return kept.select("query_id", F.col("pos").cast("bigint").alias("pos"), "chunk_id", F.round("score", 6).alias("score"))


def q_resolve_clearance(spark, sf):
    p = FX.principals(spark, sf).select(F.col("user_id").cast("string").alias("principal"), "roles")
    s = spark.createDataFrame(ROLE_SAMPLES, "principal string, roles array<string>")
    u = p.unionByName(s)
    return u.select("principal", F.array_join("roles", ",").alias("roles"), A.resolve_clearance("roles").alias("clearance"))


def _registrations(spark, sf):
    c = _c(spark, sf)
    return c.select("doc_id", "tenant_id", "sensitivity_class", "acl_roles", F.lit("chunks").alias("source"),
                    F.lit(0).alias("registered_at")).distinct()


def q_acl_edges(spark, sf):
    docs, edges, _ = AO.graph_tables(_registrations(spark, sf))
    return edges.join(docs, "doc_id").select("role", "doc_id", "tenant_id", "sensitivity_class")


def q_graph_authorized_docs(spark, sf):
    docs, edges, _ = AO.graph_tables(_registrations(spark, sf))
    prof = AO.doc_access_profiles(docs, edges)
    return AO.authorized_doc_counts(FX.principals(spark, sf), prof)


def _guarded(spark, sf):
    return R.retrieve_candidates(_q(spark, sf), _c(spark, sf), texts=False)


def q_guarded_retrieval(spark, sf):
    g = _guarded(spark, sf)
    return g.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"),
                    F.coalesce("block_reason", F.lit("")).alias("block_reason"), F.col("trust").cast("bigint").alias("trust"),
                    "action")


def _graph_chunks(spark, sf):
    return AO.graph_profiles(FX.registrations(spark, sf))


def q_graph_profiles(spark, sf):
    """Documents as the graph knows them after all register calls."""
    g = _graph_chunks(spark, sf)
    return g.select("doc_id", F.col("graph_level").cast("bigint").alias("graph_level"), F.array_join("graph_roles", ",").alias("roles"),
                    F.array_join("graph_tenants", ",").alias("tenants"))


def q_graph_retrieval(spark, sf):
    """Guarded retrieval whose pre-filter follows the graph's edges."""
    g = R.retrieve_candidates(_q(spark, sf), _c(spark, sf), graph=_graph_chunks(spark, sf), texts=False)
    return g.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"),
                    F.coalesce("block_reason", F.lit("")).alias("block_reason"), "action")


def q_retrieval_summary(spark, sf):
    q = _q(spark, sf)
    return R.retrieval_summary(q, R.retrieve_candidates(q, _c(spark, sf), texts=False))


def q_context_build(spark, sf):
    q = _q(spark, sf)
    ctx = R.build_context(R.retrieve_candidates(q, _c(spark, sf)))
    j = ctx.join(q.select("query_id", "query"), "query_id")
    return j.select("query_id", "fenced_context",
                    F.sha2(R.prompt_message(F.col("fenced_context"), F.col("query")), 256).alias("prompt_sha"))


def q_chunk_trust(spark, sf):
    c = _c(spark, sf)
    return c.select("chunk_id", T.count_present(F.lower("text"), C.CHUNK_TRUST_PHRASES).cast("bigint").alias("n_phrases"),
                    T.count_present("text", C.ZERO_WIDTH_CHARS).cast("bigint").alias("n_zero_width"),
                    T.trust_tenths("text").cast("bigint").alias("trust_tenths"),
                    T.trust_display(T.trust_tenths("text")).alias("trust"))


def q_chunk_trust_action(spark, sf):
    c = _c(spark, sf).withColumn("t", T.trust_tenths("text"))
    act = F.when(F.col("t") < 4, "drop").when(F.col("t") < 6, "wrap").otherwise("pass")
    flagged = F.concat(F.lit("[FLAGGED UNTRUSTED CHUNK (Trust: "), T.trust_display("t"), F.lit(")]\n"),
                       F.col("text"), F.lit(C.FLAG_CLOSE))
    return c.select("chunk_id", act.alias("action"),
                    F.when(act == "wrap", flagged).when(act == "pass", F.col("text")).alias("out_text"),
                    F.when(F.col("t") < 6, F.round(1 - F.col("t") / 10.0, 4)).alias("confidence"))


def q_active_sessions(spark, sf):
    r = AO.resolve_sessions(FX.session_requests(spark, sf), FX.auth_sessions(spark, sf), FX.users(spark, sf))
    return r.select("request_id", "status", "user_id", "role", "tenant_id")


SIGNUP_EXTRA = [("s1", "Customer#000000001", 1), ("s2", "new_user_a", 2), ("s3", "new_user_a", 3),
                ("s4", "new_user_b", 1)]


def _signups(spark, sf):
    """Every customer signs up again (all rejected) plus a few new names."""
    u = FX.users(spark, sf).select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("request_id"),
                                   "username", F.col("user_id").alias("requested_at"))
    return u.unionByName(spark.createDataFrame(SIGNUP_EXTRA, "request_id string, username string, requested_at long"))


def q_signup_dedup(spark, sf):
    return AO.signup_dedup(_signups(spark, sf), FX.users(spark, sf)).select("request_id", "username", "accepted")


def _grants(spark, sf):
    p = FX.principals(spark, sf)
    return p.select("user_id", "tenant_id", F.explode("roles").alias("role")).unionByName(
        p.select("user_id", F.lit("tenant_other").alias("tenant_id"), F.lit("admin").alias("role")))


def q_effective_roles(spark, sf):
    users = FX.principals(spark, sf).select("user_id", "tenant_id")
    e = AO.effective_roles(users, _grants(spark, sf))
    return e.select("user_id", "tenant_id", F.array_join("roles", ",").alias("roles"),
                    A.resolve_clearance("roles").alias("clearance"))


def q_stale_hashes(spark, sf):
    return AO.stale_hashes(FX.users(spark, sf)).select("user_id", "scheme", F.col("iterations").cast("bigint").alias("iterations"))


QUERIES = {
    "vector_topk": q_vector_topk,
    "vector_topk_cells": q_vector_topk_cells,
    "cosine_pairs": q_cosine_pairs,
    "access_decision": q_access_decision,
    "rbac_filter": q_rbac_filter,
    "rbac_user_acl": q_rbac_user_acl,
    "rbac_modes": q_rbac_modes,
    "rbac_violations": q_rbac_violations,
    "acl_retrieve": q_acl_retrieve,
    "resolve_clearance": q_resolve_clearance,
    "acl_edges": q_acl_edges,
    "graph_profiles": q_graph_profiles,
    "graph_retrieval": q_graph_retrieval,
    "graph_authorized_docs": q_graph_authorized_docs,
    "guarded_retrieval": q_guarded_retrieval,
    "retrieval_summary": q_retrieval_summary,
    "context_build": q_context_build,
    "chunk_trust": q_chunk_trust,
    "chunk_trust_action": q_chunk_trust_action,
    "active_sessions": q_active_sessions,
    "signup_dedup": q_signup_dedup,
    "effective_roles": q_effective_roles,
    "stale_hashes": q_stale_hashes,
}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

def role_level_sql(r: str) -> str:
    arms = " ".join(f"WHEN {S.q(k)} THEN {C.SENSITIVITY_LEVELS.index(v)}" for k, v in C.ROLE_CLEARANCE.items())
    return f"(CASE {r} {arms} END)"


def clearance_level_sql(roles: str) -> str:
    return f"coalesce(list_max(list_filter(list_transform({roles}, lambda r: {role_level_sql('r')}), lambda x: x IS NOT NULL)), 0)"


def level_name_sql(idx: str) -> str:
    return f"{LEVELS}[{idx} + 1]"


def level_index_sql(cls: str) -> str:
    unknown = len(C.SENSITIVITY_LEVELS) if C.UNKNOWN_CLASS_STRICT else 0
    return (f"(CASE WHEN {cls} IS NULL THEN 0 WHEN list_position({LEVELS}, {cls}) IS NOT NULL "
            f"THEN list_position({LEVELS}, {cls}) - 1 ELSE {unknown} END)")


def role_match_sql(acl, roles):
    return f"(len({acl}) = 0 OR len(list_intersect({acl}, {roles})) > 0)"


def user_match_sql(acl_users, uid):
    return f"({acl_users} IS NULL OR len({acl_users}) = 0 OR {uid} IS NULL OR list_contains({acl_users}, {uid}))"


def access_reason_sql(roles, cls, acl, uid, acl_users):
    ul = clearance_level_sql(roles)
    return (f"(CASE WHEN {level_index_sql(cls)} > {ul} THEN 'clearance_insufficient: ' || {level_name_sql(ul)} || ' < ' || coalesce({cls}, 'PUBLIC') "
            f"WHEN NOT {role_match_sql(acl, roles)} THEN 'acl_role_mismatch' "
            f"WHEN NOT {user_match_sql(acl_users, uid)} THEN 'acl_user_mismatch' ELSE 'ok' END)")


def filter_reason_sql(ut, ct, roles, cls, acl, uid, acl_users):
    return f"(CASE WHEN coalesce({ct}, 'default') <> {ut} THEN 'tenant_boundary' ELSE {access_reason_sql(roles, cls, acl, uid, acl_users)} END)"


def _dbl(v):
    return f"list_transform({v}, lambda x: x::DOUBLE)"


def cosine_sql(a, b):
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def l2rel_sql(a, b):
    return f"(1.0 - sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) / sqrt(2.0))"


def topk_ctes(k: int, scoped: bool = True, authorize: bool = False, name: str = "tk", qsrc: str = "queries") -> str:
    join = "JOIN" if True else ""
    on = "ON c.tenant_id = q.tenant_id" if scoped else "ON TRUE"
    auth = ""
    if authorize:
        auth = (f" AND len(list_intersect(c.acl_roles, q.roles)) > 0 AND {level_index_sql('c.sensitivity_class')} "
                f"<= {clearance_level_sql('q.roles')}")
    return f"""
{name}_q AS (SELECT query_id, tenant_id, roles, {_dbl('qvec')} AS qv FROM {qsrc} WHERE qvec IS NOT NULL),
{name}_c AS (SELECT chunk_id, tenant_id, sensitivity_class, acl_roles, {_dbl('embedding')} AS ev FROM chunks),
{name}_p AS (SELECT q.query_id, c.chunk_id, {cosine_sql('q.qv', 'c.ev')} AS score
             FROM {name}_q q {join} {name}_c c {on}{auth}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
                          FROM {name}_p) WHERE rank <= {k})"""


def o_vector_topk():
    return with_ctes(["queries", "chunks"], "SELECT query_id, cast(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score FROM tk",
                     extra=topk_ctes(C.TOP_K))


def o_cosine_pairs():
    return with_ctes(["queries", "chunks"], f"""
        SELECT t.query_id, t.chunk_id, round({cosine_sql('q.qv', 'c.ev')}, 6) AS cosine,
               round({l2rel_sql('q.qv', 'c.ev')}, 6) AS l2_relevance, round(list_dot_product(q.qv, c.ev), 6) AS dot
        FROM tk t JOIN tk_q q USING (query_id) JOIN tk_c c USING (chunk_id)""", extra=topk_ctes(C.TOP_K))


def _global_ctes():
    return topk_ctes(C.ACL_FETCH_K, scoped=False, name="g") + """,
gp AS (SELECT g.query_id, g.chunk_id, g.score, g.rank, c.tenant_id AS chunk_tenant, c.sensitivity_class, c.acl_roles,
              c.acl_users, c.text, cast(q.user_id AS VARCHAR) AS user_id, q.tenant_id, q.roles
       FROM g JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id))"""


def _freason():
    return filter_reason_sql("tenant_id", "chunk_tenant", "roles", "sensitivity_class", "acl_roles", "user_id", "acl_users")


def o_access_decision():
    return with_ctes(["queries", "chunks"], f"""
        SELECT query_id, chunk_id, {level_name_sql(clearance_level_sql('roles'))} AS clearance,
               {access_reason_sql('roles', 'sensitivity_class', 'acl_roles', 'user_id', 'acl_users')} AS reason FROM gp""",
                     extra=_global_ctes())


def o_rbac_filter():
    return with_ctes(["queries", "chunks"], f"SELECT query_id, chunk_id, {_freason()} AS reason, {_freason()} = 'ok' AS allowed FROM gp",
                     extra=_global_ctes())


def o_rbac_user_acl():
    return with_ctes(["queries", "chunks"], f"""
        SELECT query_id, chunk_id, {user_match_sql('acl_users', 'user_id')} AS user_ok,
               {role_match_sql('acl_roles', 'roles')} AS role_ok FROM gp""", extra=_global_ctes())


def o_rbac_modes():
    body = f"""
        SELECT m.mode, d.query_id,
               cast(count(*) FILTER (WHERE d.reason = 'ok' OR (m.mode <> 'drop' AND d.reason <> 'tenant_boundary')) AS BIGINT) AS n_returned,
               cast(count(*) FILTER (WHERE m.mode = 'redact' AND d.reason <> 'ok' AND d.reason <> 'tenant_boundary') AS BIGINT) AS n_redacted,
               cast(count(*) FILTER (WHERE d.reason <> 'ok') AS BIGINT) AS n_blocked
        FROM (SELECT query_id, {_freason()} AS reason FROM gp) d
        CROSS JOIN (VALUES ('drop'), ('redact'), ('audit_only')) m(mode)
        GROUP BY m.mode, d.query_id"""
    return with_ctes(["queries", "chunks"], body, extra=_global_ctes())


def o_rbac_violations():
    return with_ctes(["queries", "chunks"], f"""
        SELECT query_id, chunk_id, reason, sensitivity_class, clearance,
               cast(count(*) OVER (PARTITION BY query_id) AS BIGINT) AS blocked_count
        FROM (SELECT query_id, chunk_id, sensitivity_class, {_freason()} AS reason,
                     {level_name_sql(clearance_level_sql('roles'))} AS clearance FROM gp) WHERE reason <> 'ok'""",
                     extra=_global_ctes())


def o_acl_retrieve():
    return with_ctes(["queries", "chunks"], f"""
        SELECT query_id, cast(pos AS BIGINT) AS pos, chunk_id, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos
          FROM gp WHERE {_freason()} = 'ok') WHERE pos <= {C.TOP_K}""", extra=_global_ctes())


def o_resolve_clearance():
    vals = ", ".join(f"({S.q(k)}, {S.qlist(v) if v else '[]::VARCHAR[]'})" for k, v in ROLE_SAMPLES)
    return with_ctes(["principals"], f"""
        SELECT principal, array_to_string(roles, ',') AS roles, {level_name_sql(clearance_level_sql('roles'))} AS clearance
        FROM (SELECT cast(user_id AS VARCHAR) AS principal, roles FROM principals
              UNION ALL SELECT * FROM (VALUES {vals}) v(principal, roles))""")


def _reg_ctes():
    return """
reg AS (SELECT DISTINCT doc_id, tenant_id, sensitivity_class, acl_roles FROM chunks),
gdocs AS (SELECT doc_id, arg_max(tenant_id, tenant_id) AS tenant_id, max(sensitivity_class) AS sensitivity_class
          FROM reg GROUP BY doc_id),
gedges AS (SELECT DISTINCT unnest(acl_roles) AS role, doc_id FROM reg)"""


def o_acl_edges():
    return with_ctes(["chunks"], "SELECT e.role, e.doc_id, d.tenant_id, d.sensitivity_class FROM gedges e JOIN gdocs d USING (doc_id)",
                     extra=_reg_ctes())


def o_graph_authorized_docs():
    return with_ctes(["principals", "chunks"], f"""
        SELECT p.user_id, p.tenant_id, {level_name_sql(clearance_level_sql('p.roles'))} AS clearance,
               cast(count(DISTINCT d.doc_id) AS BIGINT) AS n_authorized_docs
        FROM principals p
        LEFT JOIN gdocs d ON d.tenant_id = p.tenant_id
             AND {level_index_sql('d.sensitivity_class')} <= {clearance_level_sql('p.roles')}
             AND EXISTS (SELECT 1 FROM gedges e WHERE e.doc_id = d.doc_id AND list_contains(p.roles, e.role))
        GROUP BY p.user_id, p.tenant_id, p.roles""", extra=_reg_ctes())


def _history_ctes():
    """The register calls and the graph they leave, from the rules of FIXTURES: latest class, all roles, all tenants."""
    return f"""
own AS (SELECT DISTINCT doc_id, tenant_id, sensitivity_class, acl_roles, coalesce(try_cast(doc_id AS BIGINT), 0) AS k,
               try_cast(doc_id AS BIGINT) AS n FROM chunks),
calls AS (SELECT doc_id, tenant_id, sensitivity_class, acl_roles, k FROM own
          UNION ALL SELECT doc_id, tenant_id, 'PUBLIC', ['executive'], k - 5000000 FROM own WHERE n % 6 = 0
          UNION ALL SELECT doc_id, tenant_id, 'RESTRICTED', acl_roles, k + 5000000 FROM own WHERE n % 10 = 0
          UNION ALL SELECT doc_id, 'tenant_' || ((n + 1) % 4), sensitivity_class, acl_roles, k - 9000000 FROM own WHERE n % 9 = 0),
classes AS (SELECT doc_id, sensitivity_class FROM calls
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, tenant_id DESC, sensitivity_class DESC) = 1),
opened AS (SELECT doc_id, list_sort(list(DISTINCT role)) AS roles FROM (SELECT doc_id, unnest(acl_roles) AS role FROM calls) GROUP BY doc_id),
owners AS (SELECT doc_id, list_sort(list(DISTINCT tenant_id)) AS tenants FROM calls GROUP BY doc_id),
graph AS (SELECT doc_id, {level_index_sql('sensitivity_class')} AS level, roles, tenants
          FROM classes JOIN opened USING (doc_id) JOIN owners USING (doc_id))"""


def o_graph_profiles():
    return with_ctes(["chunks"], """
        SELECT doc_id, cast(level AS BIGINT) AS graph_level, array_to_string(roles, ',') AS roles,
               array_to_string(tenants, ',') AS tenants FROM graph""", extra=_history_ctes())


def o_graph_retrieval():
    top = f"""
gr AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, c.chunk_id, {cosine_sql(_dbl('q.qvec'), _dbl('c.embedding'))} AS score
    FROM queries q JOIN chunks c ON c.tenant_id = q.tenant_id JOIN graph g ON g.doc_id = c.doc_id
    WHERE q.qvec IS NOT NULL AND list_contains(g.tenants, q.tenant_id) AND len(list_intersect(g.roles, q.roles)) > 0
          AND g.level <= {clearance_level_sql('q.roles')})) WHERE rank <= {C.TOP_K * C.OVERFETCH_FACTOR})"""
    return with_ctes(["queries", "chunks"], """
        SELECT query_id, cast(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score, coalesce(block_reason, '') AS block_reason,
               action FROM grx""", extra=_history_ctes() + "," + top + _outcome_ctes("queries"))


def guarded_ctes(qsrc: str = "queries"):
    k = C.TOP_K * C.OVERFETCH_FACTOR
    return topk_ctes(k, scoped=True, authorize=True, name="gr", qsrc=qsrc) + _outcome_ctes(qsrc)


def _outcome_ctes(qsrc: str) -> str:
    return f""",
gr1 AS (
  SELECT t.query_id, t.rank, t.chunk_id, c.doc_id, t.score, c.text,
         CASE WHEN t.score < {C.SIMILARITY_THRESHOLD} THEN 'below_threshold'
              WHEN c.tenant_id <> q.tenant_id THEN 'tenant_boundary'
              WHEN {level_index_sql('c.sensitivity_class')} > {clearance_level_sql('q.roles')} THEN 'clearance_insufficient'
              WHEN NOT {role_match_sql('c.acl_roles', 'q.roles')} THEN 'acl_role_mismatch' END AS block_reason,
         {S.trust_tenths('c.text')} AS trust
  FROM gr t JOIN chunks c USING (chunk_id) JOIN {qsrc} q USING (query_id)),
gr2 AS (
  SELECT *, sum(CASE WHEN block_reason IS NULL AND trust >= 4 THEN 1 ELSE 0 END)
            OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS kept_upto
  FROM gr1),
gr3 AS (
  SELECT *, CASE WHEN block_reason IS NOT NULL THEN 'blocked'
                 WHEN (trust >= 4 AND kept_upto > {C.TOP_K}) OR (trust < 4 AND kept_upto >= {C.TOP_K}) THEN 'unscanned'
                 WHEN trust < 4 THEN 'drop' WHEN trust < 6 THEN 'wrap' ELSE 'pass' END AS action
  FROM gr2),
grx AS (
  SELECT *, action IN ('wrap', 'pass') AS used, action IN ('blocked', 'drop') AS counted_blocked,
         CASE WHEN action = 'wrap' THEN '[FLAGGED UNTRUSTED CHUNK (Trust: ' || printf('%.1f', trust / 10.0) || ')]' || chr(10)
              || text || {S.q(C.FLAG_CLOSE)} ELSE text END AS out_text
  FROM gr3)"""


def o_guarded_retrieval():
    return with_ctes(["queries", "chunks"], """
        SELECT query_id, cast(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score, coalesce(block_reason, '') AS block_reason,
               cast(trust AS BIGINT) AS trust, action FROM grx""", extra=guarded_ctes())


def o_retrieval_summary():
    return with_ctes(["queries", "chunks"], """
        SELECT q.query_id, cast(coalesce(sum(CASE WHEN g.used THEN 1 ELSE 0 END), 0) AS BIGINT) AS chunks_used,
               cast(coalesce(sum(CASE WHEN g.counted_blocked THEN 1 ELSE 0 END), 0) AS BIGINT) AS rbac_blocked
        FROM queries q LEFT JOIN grx g USING (query_id) GROUP BY q.query_id""", extra=guarded_ctes())


def o_context_build():
    ctx = f"string_agg(out_text, {S.q(C.CONTEXT_SEPARATOR)} ORDER BY rank)"
    return with_ctes(["queries", "chunks"], f"""
        SELECT c.query_id, c.fenced_context,
               sha256('Context:' || chr(10) || c.fenced_context || {S.q(C.CONTEXT_REMINDER)} || chr(10) || chr(10) || 'Question: ' || q.query) AS prompt_sha
        FROM (SELECT query_id, {S.q(C.CONTEXT_BEGIN)} || {ctx} || {S.q(C.CONTEXT_END)} AS fenced_context
              FROM grx WHERE used GROUP BY query_id) c JOIN queries q USING (query_id)""", extra=guarded_ctes())


def o_chunk_trust():
    return with_ctes(["chunks"], f"""
        SELECT chunk_id, cast({S.count_present('lower(text)', C.CHUNK_TRUST_PHRASES)} AS BIGINT) AS n_phrases,
               cast({S.count_present('text', C.ZERO_WIDTH_CHARS)} AS BIGINT) AS n_zero_width,
               cast({S.trust_tenths('text')} AS BIGINT) AS trust_tenths, printf('%.1f', {S.trust_tenths('text')} / 10.0) AS trust
        FROM chunks""")


def o_chunk_trust_action():
    return with_ctes(["chunks"], f"""
        SELECT chunk_id, CASE WHEN t < 4 THEN 'drop' WHEN t < 6 THEN 'wrap' ELSE 'pass' END AS action,
               CASE WHEN t < 4 THEN NULL WHEN t < 6 THEN '[FLAGGED UNTRUSTED CHUNK (Trust: ' || printf('%.1f', t / 10.0) || ')]' || chr(10) || text || {S.q(C.FLAG_CLOSE)}
                    ELSE text END AS out_text,
               CASE WHEN t < 6 THEN round(1 - t / 10.0, 4) END AS confidence
        FROM (SELECT chunk_id, text, {S.trust_tenths('text')} AS t FROM chunks)""")


def o_active_sessions():
    return with_ctes(["session_requests", "auth_sessions", "users"], """
        SELECT request_id, status, CASE WHEN status = 'valid' THEN user_id END AS user_id,
               CASE WHEN status = 'valid' THEN role END AS role, CASE WHEN status = 'valid' THEN tenant_id END AS tenant_id
        FROM (SELECT r.request_id, s.user_id, u.role, u.tenant_id,
                     CASE WHEN s.expires_at IS NULL OR u.username IS NULL THEN 'invalid'
                          WHEN s.revoked_at IS NOT NULL AND s.revoked_at <= r.at THEN 'invalid'
                          WHEN s.expires_at <= r.at THEN 'expired' ELSE 'valid' END AS status
              FROM session_requests r LEFT JOIN auth_sessions s USING (token_hash) LEFT JOIN users u ON u.user_id = s.user_id)""")


def o_signup_dedup():
    vals = ", ".join(f"({S.q(a)}, {S.q(b)}, {c})" for a, b, c in SIGNUP_EXTRA)
    return with_ctes(["users"], f"""
        SELECT request_id, username, coalesce(acc, false) AS accepted FROM (
          SELECT s.*, (s.username NOT IN (SELECT username FROM users)
                       AND row_number() OVER (PARTITION BY s.username, s.username IN (SELECT username FROM users)
                                              ORDER BY s.requested_at, s.request_id) = 1) AS acc
          FROM (SELECT 'c' || cast(user_id AS VARCHAR) AS request_id, username, user_id AS requested_at FROM users
                UNION ALL SELECT * FROM (VALUES {vals}) v(request_id, username, requested_at)) s)""")


def o_effective_roles():
    return with_ctes(["principals"], f"""
        SELECT user_id, tenant_id, array_to_string(roles, ',') AS roles, {level_name_sql(clearance_level_sql('roles'))} AS clearance
        FROM (SELECT p.user_id, p.tenant_id, coalesce(list_sort(list_distinct(list(g.role) FILTER (WHERE g.role IS NOT NULL))), []::VARCHAR[]) AS roles
              FROM principals p LEFT JOIN (
                SELECT user_id, tenant_id, unnest(roles) AS role FROM principals
                UNION ALL SELECT user_id, 'tenant_other', 'admin' FROM principals) g
              ON g.user_id = p.user_id AND g.tenant_id = p.tenant_id
              GROUP BY p.user_id, p.tenant_id)""")


def o_stale_hashes():
    return with_ctes(["users"], f"""
        SELECT user_id, split_part(password_hash, '$', 1) AS scheme, try_cast(split_part(password_hash, '$', 2) AS BIGINT) AS iterations
        FROM users WHERE split_part(password_hash, '$', 1) <> {S.q(C.PASSWORD_SCHEME)}
           OR try_cast(split_part(password_hash, '$', 2) AS BIGINT) IS NULL
           OR try_cast(split_part(password_hash, '$', 2) AS BIGINT) < {C.PBKDF2_MIN_ITERATIONS}""")


ORACLE = {
    "vector_topk": o_vector_topk,
    "vector_topk_cells": o_vector_topk,
    "cosine_pairs": o_cosine_pairs,
    "access_decision": o_access_decision,
    "rbac_filter": o_rbac_filter,
    "rbac_user_acl": o_rbac_user_acl,
    "rbac_modes": o_rbac_modes,
    "rbac_violations": o_rbac_violations,
    "acl_retrieve": o_acl_retrieve,
    "resolve_clearance": o_resolve_clearance,
    "acl_edges": o_acl_edges,
    "graph_profiles": o_graph_profiles,
    "graph_retrieval": o_graph_retrieval,
    "graph_authorized_docs": o_graph_authorized_docs,
    "guarded_retrieval": o_guarded_retrieval,
    "retrieval_summary": o_retrieval_summary,
    "context_build": o_context_build,
    "chunk_trust": o_chunk_trust,
    "chunk_trust_action": o_chunk_trust_action,
    "active_sessions": o_active_sessions,
    "signup_dedup": o_signup_dedup,
    "effective_roles": o_effective_roles,
    "stale_hashes": o_stale_hashes,
}

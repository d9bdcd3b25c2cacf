"""Relational access control: graph tables, authorization, RBAC filtering,
sessions, sign-up dedup, effective roles (S12, J1, J2, J6, J9, J10, R4–R7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import access as A


# ---------------------------------------------------------------------------
# ACL graph
# ---------------------------------------------------------------------------

def graph_tables(registrations: DataFrame):
    """Role–Document–Tenant graph as relations.

    ``registrations(doc_id, tenant_id, sensitivity_class, acl_roles, source,
    registered_at)``: one row per register call.  Documents are upserted
    (latest registration wins on class/tenant/source); role edges are only
    ever added, never removed, so edges from every registration remain.
    """
    # latest registration per document as a partial (map-side) max, so a
    # document registered millions of times is never ranked in one task
    latest = registrations.groupBy("doc_id").agg(F.max(F.struct(
        "registered_at", "tenant_id", "sensitivity_class", F.coalesce("source", F.lit("unknown")).alias("source"))).alias("m"))
    docs = latest.select("doc_id", "m.tenant_id", "m.sensitivity_class", "m.source")
    edges = registrations.select(F.explode("acl_roles").alias("role"), "doc_id").distinct()
    tenants = registrations.select(F.col("tenant_id").alias("id")).distinct()
    return docs, edges, tenants


def graph_profiles(registrations: DataFrame) -> DataFrame:
    """The graph as one row per document: doc_id, graph_level, graph_roles, graph_tenants.

    The class is that of the latest registration (ties: the greater tenant, then the greater class).  Roles and
    tenants are those of every registration, as edges are never removed: a role or tenant that an
    earlier registration gave still counts.  One pass: the distinct role lists and tenants of a document are gathered
    map-side first, so a document registered millions of times is no large group.  Documents without any role are left out.
    """
    latest = F.max(F.struct("registered_at", "tenant_id", "sensitivity_class"))
    g = registrations.groupBy("doc_id").agg(latest.alias("m"), F.collect_set("acl_roles").alias("lists"), F.collect_set("tenant_id").alias("tenants"))
    roles = F.array_sort(F.array_distinct(F.filter(F.flatten("lists"), lambda r: r.isNotNull())))
    return g.select("doc_id", A.level_index("m.sensitivity_class").alias("graph_level"), roles.alias("graph_roles"),
                    F.array_sort("tenants").alias("graph_tenants")).where((F.size("graph_roles") > 0) & (F.size("graph_tenants") > 0))


def with_graph(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """The graph pre-filter's view of chunks (J2): the document's graph roles and level stand for the chunk's own.
    Chunks of documents that are not registered, or not under the chunk's tenant, are no candidates."""
    j = chunks.join(profiles, "doc_id").where(F.array_contains("graph_tenants", F.col("tenant_id")))
    return j.select("chunk_id", "tenant_id", "embedding", F.col("graph_roles").alias("acl_roles"), F.col("graph_level").alias("level"))


def doc_access_profiles(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents grouped by (tenant, level, role set) with their count.

    The number of distinct profiles is bounded by tenants × levels × role
    subsets, so this is what gets joined to principals instead of the
    document list itself.
    """
    roles = edges.groupBy("doc_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    d = documents.join(roles, "doc_id")
    return (d.groupBy("tenant_id", A.level_index("sensitivity_class").alias("level"), "roles")
            .agg(F.count(F.lit(1)).alias("n_docs")))


def authorized_doc_counts(principals: DataFrame, profiles: DataFrame) -> DataFrame:
    """J1 in aggregate form: how many documents each principal may reach.

    A document is reachable when one of its roles is a principal role, it
    sits in the principal's tenant and its class is within the clearance.
    """
    p = principals.select("user_id", "tenant_id", "roles", A.clearance_level("roles").alias("clearance_level"))
    # profiles are few (tenants x levels x role sets); AQE broadcasts them
    # when their measured size is under the threshold, else it shuffles
    j = p.join(profiles.withColumnRenamed("roles", "doc_roles"), "tenant_id")
    j = j.where(F.arrays_overlap("roles", "doc_roles") & (F.col("level") <= F.col("clearance_level")))
    counts = j.groupBy("user_id").agg(F.sum("n_docs").alias("n_authorized_docs"))
    return (p.join(counts, "user_id", "left")
            .select("user_id", "tenant_id", A.level_name("clearance_level").alias("clearance"),
                    F.coalesce("n_authorized_docs", F.lit(0)).cast("bigint").alias("n_authorized_docs")))


def authorized_pairs(candidates: DataFrame, requests: DataFrame, documents: DataFrame,
                     edges: DataFrame) -> DataFrame:
    """J1/J2 per candidate: keep (query, doc) pairs the graph authorizes.

    Candidates are bounded (k per query), so this is a bounded left-semi
    join rather than a materialised list of every authorized document.
    """
    r = requests.select("query_id", F.col("tenant_id").alias("q_tenant"), F.explode("roles").alias("role"),
                        A.clearance_level("roles").alias("clearance_level"))
    c = candidates.join(r, "query_id").join(edges, ["doc_id", "role"])
    c = c.join(documents.select("doc_id", F.col("tenant_id").alias("d_tenant"), "sensitivity_class"), "doc_id")
    ok = c.where((F.col("d_tenant") == F.col("q_tenant"))
                 & (A.level_index("sensitivity_class") <= F.col("clearance_level")))
    return candidates.join(ok.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")


# ---------------------------------------------------------------------------
# RBAC filter over (request, chunk) pairs
# ---------------------------------------------------------------------------

def rbac_decide(pairs: DataFrame, strict: bool = C.UNKNOWN_CLASS_STRICT) -> DataFrame:
    """Adds ``reason`` (R4 order) and ``allowed`` to (request, chunk) pairs.

    Pairs carry: user_id, roles, tenant_id (request) and chunk_tenant,
    sensitivity_class, acl_roles, acl_users (chunk).
    """
    reason = A.filter_reason("tenant_id", "chunk_tenant", "roles", "sensitivity_class", "acl_roles",
                             "user_id", "acl_users", strict)
    return pairs.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok") \
        .withColumn("clearance", A.resolve_clearance("roles"))


def rbac_apply(decided: DataFrame, mode: str = "drop") -> DataFrame:
    """Drop | redact | audit_only.  Tenant-boundary rows are never kept."""
    if mode not in ("drop", "redact", "audit_only"):
        raise ValueError("mode must be drop, redact or audit_only")
    if mode == "drop":
        return decided.where("allowed")
    keep = decided.where(F.col("allowed") | (F.col("reason") != "tenant_boundary"))
    if mode == "redact":
        return keep.withColumn("text", F.when(F.col("allowed"), F.col("text"))
                               .otherwise(F.lit(C.RBAC_REDACTED_TEXT)))
    return keep


# ---------------------------------------------------------------------------
# Sessions, sign-ups, roles
# ---------------------------------------------------------------------------

def resolve_sessions(requests: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Token → user as of the request instant, with a reason per request.

    A token is ``valid`` when known, not revoked at that instant and not
    expired; otherwise ``invalid`` (unknown or revoked) or ``expired``.
    """
    s = sessions.select("token_hash", "user_id", "expires_at", "revoked_at")
    j = requests.join(s, "token_hash", "left").join(users.select("user_id", "username", "role", F.col("tenant_id").alias("user_tenant")), "user_id", "left")
    status = (F.when(F.col("expires_at").isNull() | F.col("username").isNull(), "invalid")
              .when(F.col("revoked_at").isNotNull() & (F.col("revoked_at") <= F.col("at")), "invalid")
              .when(F.col("expires_at") <= F.col("at"), "expired")
              .otherwise("valid"))
    return j.select("request_id", "token_hash", "at", status.alias("status"),
                    F.when(status == "valid", F.col("user_id")).alias("user_id"),
                    F.when(status == "valid", F.col("role")).alias("role"),
                    F.when(status == "valid", F.col("user_tenant")).alias("tenant_id"))


def signup_dedup(signups: DataFrame, existing: DataFrame) -> DataFrame:
    """Reject names already registered; inside a batch the first wins."""
    fresh = signups.join(existing.select("username"), "username", "left_anti")
    # first request per name as a partial min, not a rank over all attempts
    firsts = fresh.groupBy("username").agg(F.min(F.struct("requested_at", "request_id")).alias("f")) \
        .select(F.col("f.request_id").alias("request_id"))
    return signups.join(firsts.withColumn("accepted", F.lit(True)), "request_id", "left") \
        .withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def effective_roles(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Roles granted to a user within their tenant (set, sorted)."""
    g = grants.select("user_id", F.col("tenant_id").alias("g_tenant"), "role")
    j = users.select("user_id", "tenant_id").join(g, (users.user_id == g.user_id) & (users.tenant_id == g.g_tenant), "left")
    return j.groupBy(users.user_id, "tenant_id").agg(
        F.array_sort(F.collect_set("role")).alias("roles"))


def stale_hashes(users: DataFrame, scheme: str = C.PASSWORD_SCHEME,
                 min_iterations: int = C.PBKDF2_MIN_ITERATIONS) -> DataFrame:
    """Users whose stored hash lacks the scheme or has too few iterations."""
    parts = F.split("password_hash", r"\$")
    it = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
    sch = F.try_element_at(parts, F.lit(1))
    bad = (sch != scheme) | it.isNull() | (it < min_iterations)
    return users.where(bad).select("user_id", "username", sch.alias("scheme"),
                                   it.alias("iterations"))

"""DuckDB versions of the derived tables in ``docshield.sources.fixtures``.

Each entry is a CTE body; ``with_ctes(names, body)`` prepends the needed
definitions (dependencies first).
"""

from __future__ import annotations

from docshield import constants as C
from docshield.oracle.sql import q, normalize_list
from docshield.sources import fixtures as FX

EPOCH = f"TIMESTAMP '{FX.EPOCH}'"


def ts(seconds: str) -> str:
    return f"({EPOCH} + to_seconds({seconds}))"


def tenant_of(k: str) -> str:
    return f"('tenant_' || cast({k} % 4 AS VARCHAR))"


def acl_string_of(k: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(FX.ACL_CYCLE))
    return f"(CASE {k} % 5 {arms} END)"


def roles_of(u: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(FX.ROLE_CYCLE))
    r = f"(CASE {u} % 6 {arms} END)"
    return f"(CASE WHEN {u} % 7 = 0 THEN [{r}, 'employee'] ELSE [{r}] END)"


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(v for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


def planted_docs_sql() -> str:
    rows = [(q(d), q(t), q(FX.PLANTED_SOURCE), q(FX.PLANTED_TENANT), q(FX.PLANTED_ACL),
             ts(str(40 * 86400 - i * 60)))
            for i, (d, t) in enumerate(FX.PLANTED_DOCS)]
    return ("SELECT doc_id, text, source, tenant_id, acl_roles, ingested_at FROM "
            + _values(rows, ["doc_id", "text", "source", "tenant_id", "acl_roles", "ingested_at"]))


def qlist_router() -> str:
    return "[" + ", ".join(q(x) for x in C.ROUTER_LABELS) + "]"


def cats() -> str:
    return "[" + ", ".join(q(x) for x in C.INJECTION_CATEGORIES + ["other"]) + "]"


LEVELS = "[" + ", ".join(q(x) for x in C.SENSITIVITY_LEVELS) + "]"
STEP = C.CHUNK_SIZE - C.CHUNK_OVERLAP

CTES = {
    "docs_raw": ([], f"""
        SELECT cast(doc_id AS VARCHAR) AS doc_id, text, source, {tenant_of('doc_id')} AS tenant_id,
               {acl_string_of('doc_id')} AS acl_roles, {ts('doc_id * 60')} AS ingested_at
        FROM documents
        UNION ALL {planted_docs_sql()}"""),
    "principals": ([], f"""
        SELECT user_id, {tenant_of('user_id')} AS tenant_id, {roles_of('user_id')} AS roles
        FROM (SELECT DISTINCT user_id FROM events)"""),
    "chunks": ([], f"""
        SELECT cast(d.doc_id AS VARCHAR) || '_chunk_' || cast(i AS VARCHAR) AS chunk_id,
               cast(d.doc_id AS VARCHAR) AS doc_id, {tenant_of('d.doc_id')} AS tenant_id,
               substr(d.text, i * {STEP} + 1, {C.CHUNK_SIZE}) AS text, e.embedding,
               {LEVELS}[e.label % 5 + 1] AS sensitivity_class,
               {normalize_list(acl_string_of('d.doc_id'))} AS acl_roles,
               CASE WHEN d.doc_id % 7 = 0 THEN [cast(d.doc_id % 150 AS VARCHAR)] ELSE []::VARCHAR[] END AS acl_users
        FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id,
             LATERAL (SELECT unnest(range(0, cast(greatest(ceil((length(d.text) - {C.CHUNK_OVERLAP}) / {STEP}.0), 1) AS BIGINT))) AS i)
        UNION ALL
        SELECT v.chunk_id, 'pdoc_' || v.chunk_id, {q(FX.PLANTED_TENANT)}, v.text, e.embedding, 'PUBLIC',
               {"[" + ", ".join(q(r) for r in FX.PLANTED_CHUNK_ROLES) + "]"}, []::VARCHAR[]
        FROM {_values([(q(a), q(b)) for a, b in FX.PLANTED_CHUNKS], ['chunk_id', 'text'])}
        CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {FX.PLANTED_CHUNK_VEC}) e"""),
    "queries": ([], f"""
        SELECT u.query_id, u.user_id, {tenant_of('u.user_id')} AS tenant_id, {roles_of('u.user_id')} AS roles,
               u.session_id, u.query, {ts('u.k * 300')} AS ts, e.embedding AS qvec, {C.TOP_K} AS top_k
        FROM (
          SELECT conv_id * 100 + turn AS query_id, conv_id % 150 AS user_id, cast(conv_id AS VARCHAR) AS session_id,
                 text AS query, conv_id * 8 + turn AS k
          FROM conversations WHERE role = 'user'
          UNION ALL
          SELECT query_id, user_id, 'planted', query, -query_id FROM {_values([(str(a), str(b), q(c)) for a, b, c in FX.PLANTED_QUERIES], ['query_id', 'user_id', 'query'])}
        ) u
        CROSS JOIN (SELECT count(*) AS n_emb FROM embeddings) n
        LEFT JOIN embeddings e ON e.vec_id = u.k % n.n_emb"""),
    "scores": (["queries"], f"""
        SELECT query_id, {qlist_router()}[abs(query_id) % 5 + 1] AS top_label,
               (abs(query_id) % 100) / 100.0 AS top_score
        FROM queries
        WHERE cast(trunc(query_id / 100) AS BIGINT) NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""),
    "guard_scores": (["queries"], f"""
        SELECT query_id,
               CASE WHEN l.doc_id % 6 = 0 THEN NULL ELSE l.toxic = 0 END AS is_safe,
               {cats()}[l.doc_id % 5 + 1] AS category,
               CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE 0.5 + (l.doc_id % 50) / 100.0 END AS confidence
        FROM queries qq JOIN labels l ON abs(cast(trunc(qq.query_id / 100) AS BIGINT)) = l.doc_id"""),
    "answers": ([], f"""
        SELECT a.query_id, a.response, coalesce(cast(trunc(ev.value * 10) AS INTEGER), 0) AS latency_ms
        FROM (SELECT conv_id * 100 + turn - 1 AS query_id, text AS response, conv_id * 8 + turn - 1 AS k
              FROM conversations WHERE role = 'assistant') a
        LEFT JOIN events ev ON ev.event_id = a.k
        UNION ALL SELECT * FROM {_values([(str(a), q(b), str(c)) for a, b, c in FX.PLANTED_ANSWERS], ['query_id', 'response', 'latency_ms'])}"""),
    "rewrites": ([], f"""
        SELECT u.conv_id * 100 + u.turn AS query_id, u.text || ' ' || p.text AS standalone_query,
               CASE WHEN (u.conv_id + u.turn) % 11 <> 0 THEN {qlist_router()}[(u.conv_id * 3 + u.turn) % 5 + 1] END AS top_label,
               CASE WHEN (u.conv_id + u.turn) % 11 <> 0 THEN ((u.conv_id * 3 + u.turn) * 7 % 100) / 100.0 END AS top_score
        FROM conversations u JOIN conversations p ON p.conv_id = u.conv_id AND p.turn + 1 = u.turn
        WHERE u.role = 'user'"""),
    "users": ([], f"""
        SELECT c_custkey AS user_id, c_name AS username,
               concat_ws('$', CASE WHEN c_custkey % 10 = 0 THEN 'sha256' ELSE {q(C.PASSWORD_SCHEME)} END,
                         cast(CASE WHEN c_custkey % 3 = 0 THEN {C.PBKDF2_MIN_ITERATIONS - 1} ELSE {C.PBKDF2_MIN_ITERATIONS} END AS VARCHAR),
                         substr(sha256('salt' || cast(c_custkey AS VARCHAR)), 1, 16), sha256(c_name)) AS password_hash,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'employee' WHEN 'BUILDING' THEN 'manager'
                    WHEN 'FURNITURE' THEN 'executive' WHEN 'HOUSEHOLD' THEN 'anonymous' WHEN 'MACHINERY' THEN 'admin' END AS role,
               'tenant_' || cast(c_nationkey AS VARCHAR) AS tenant_id, {ts('c_custkey * 600')} AS created_at
        FROM customer"""),
    "auth_sessions": ([], f"""
        SELECT sha256('sess|' || cast(event_id AS VARCHAR)) AS id, user_id,
               sha256('tok|' || cast(event_id AS VARCHAR)) AS token_hash,
               ts + INTERVAL {C.SESSION_TTL_SEC} SECOND AS expires_at,
               CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 30 SECOND END AS revoked_at,
               ts AS created_at
        FROM events"""),
    "session_requests": ([], """
        SELECT event_id AS request_id,
               CASE WHEN event_id % 13 = 0 THEN sha256('bogus|' || cast(event_id AS VARCHAR))
                    ELSE sha256('tok|' || cast(event_id AS VARCHAR)) END AS token_hash,
               ts + to_seconds(cast(trunc(value * 100) AS BIGINT)) AS at
        FROM events"""),
}


def _order(names):
    seen, out = set(), []

    def visit(n):
        if n in seen:
            return
        seen.add(n)
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(names, body: str, extra: str = "") -> str:
    parts = [f"{n} AS ({CTES[n][1]})" for n in _order(names)]
    if extra:
        parts.append(extra.strip().rstrip(","))
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body

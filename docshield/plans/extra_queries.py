"""Registered request-check, dictionary-join, schema and file queries
(P8, P9, P12, J7, J8, S1, S7, S13, S14, UD2) and oracles where SQL applies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import lists as L
from docshield.operators import analytics as AN
from docshield.operators import chunking as CH
from docshield.operators import ingest as I
from docshield.operators import requests as RQ
from docshield.operators import route as RT
from docshield.oracle import sql as S
from docshield.oracle.fixtures import with_ctes
from docshield.plans import ingest_queries as IQ
from docshield.sources import fixtures as FX
from docshield.sources import files as FS
from docshield.sources.tables import read

CLAIM_EXTRA = [("x1", 7, "tenant_3", ["admin"]), ("x2", 8, "tenant_1", ["manager"]), ("x3", 999999, "tenant_0", ["employee"])]
VAULT_KEY = "0123456789abcdef0123456789abcdef"


def q_query_validate(spark, sf):
    v = RQ.validate_queries(FX.queries(spark, sf))
    return v.select("query_id", "valid", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"),
                    F.length("query").cast("bigint").alias("query_chars"))


def _claims(spark, sf):
    q = FX.queries(spark, sf).select(F.col("query_id").cast("string").alias("request_id"), "user_id", "tenant_id", "roles")
    x = spark.createDataFrame(CLAIM_EXTRA, "request_id string, user_id long, tenant_id string, roles array<string>")
    return q.unionByName(x)


def q_claim_check(spark, sf):
    c = RQ.check_claims(_claims(spark, sf), FX.principals(spark, sf))
    return c.select("request_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"),
                    F.array_join("ungranted_roles", ",").alias("ungranted_roles"))


def _tokens(spark):
    return spark.createDataFrame([(t,) for t in C.CANARY_TOKENS], "token string")


def q_canary_join(spark, sf):
    j = RQ.canary_join(FX.answers(spark, sf), _tokens(spark))
    return j.select("query_id", "token")


#: Characters of a benchmark text that mark a document as holding it.
OPENING = 24


def q_canary_index(spark, sf):
    """Documents that hold the opening of a benchmark text: the containment join with a token table that grows."""
    tokens = read(spark, sf, "benchmark").select(F.substring("text", 1, OPENING).alias("token"))
    j = RQ.canary_join(read(spark, sf, "documents").select("doc_id", "text"), tokens, "text", "doc_id")
    return j.select("doc_id", "token")


def _gazetteer(spark):
    return spark.createDataFrame([(n, "PERSON") for n in FX.PERSON_NAMES], "name string, entity_type string")


def q_gazetteer_pii(spark, sf):
    g = RQ.gazetteer_join(FX.docs_raw(spark, sf), _gazetteer(spark))
    return g.select("doc_id", "entity_type", "name", F.col("n").cast("bigint").alias("n"))


def q_flatten_schema(spark, sf):
    r = RT.route_with_scores(FX.queries(spark, sf), FX.scores(spark, sf)).select("query_id", "route")
    f = L.flatten_schema(r)
    return f.select("query_id", "`route.action`", "`route.category`", F.round("`route.confidence`", 4).alias("route.confidence"),
                    "`route.is_safe`")


def q_doc_source_gate(spark, sf):
    path = FS.scratch_path(spark, "docs-files")
    FS.write_documents_as_files(FX.docs_raw(spark, sf, planted=False), path)
    d = FS.read_document_files(spark, path)
    doc_id = F.regexp_extract("path", r"doc_id=([^/]+)", 1)
    return d.select(doc_id.alias("doc_id"), "source", F.col("length").cast("bigint").alias("length"),
                    F.coalesce("reject_code", F.lit(0)).alias("reject_code"), "accepted",
                    F.sha2("text", 256).alias("text_sha"))


def q_quarantine_vault(spark, sf):
    v = I.quarantine_vault(IQ._scan(spark, sf), VAULT_KEY)
    d = I.decrypt_vault(v, VAULT_KEY)
    return v.join(d, "doc_id").select("doc_id", "reason", "file_name", "encrypted",
                                      F.get_json_object("json", "$.doc_id").alias("decrypted_doc_id"),
                                      F.length("payload").cast("bigint").alias("payload_bytes"))


def q_canary_seed(spark, sf):
    c = FS.seed_canaries(spark, FX.chunks(spark, sf, planted=False).select(
        "chunk_id", "doc_id", "tenant_id", "text", "sensitivity_class", "acl_roles"))
    return c.groupBy("tenant_id", "sensitivity_class").agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"))


def q_events_export(spark, sf):
    from docshield.plans.analytics_queries import _feed, _feed_cols
    path = FS.scratch_path(spark, "events-export")
    FS.export_json(_feed_cols(_feed(spark, sf)), path)
    return spark.read.json(path).select("id", "time", "type", "risk")


def q_udtf_chunk(spark, sf):
    CH.register_chunk_udtf(spark)
    FX.docs_raw(spark, sf).createOrReplaceTempView("docshield_docs_raw")
    return spark.sql("""
        SELECT d.doc_id, c.chunk_index, length(c.chunk) AS n_chars
        FROM docshield_docs_raw d, LATERAL chunk_text(d.text, 512, 64) c""")


def q_chunk_table(spark, sf):
    """The chunk table written partitioned by tenant (dynamic overwrite)
    to the shared scratch folder and read back."""
    path = FS.scratch_path(spark, "chunk-table")
    chunks = CH.chunk_table(IQ._scan(spark, sf), "fixed")
    CH.write_chunk_table(chunks, path, "batch-1")
    t = CH.read_chunk_table(spark, path, chunks.schema)
    return t.select("chunk_id", "doc_id", "tenant_id", "sensitivity_class", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {
    "chunk_table": q_chunk_table,
    "query_validate": q_query_validate,
    "claim_check": q_claim_check,
    "canary_join": q_canary_join,
    "canary_index": q_canary_index,
    "gazetteer_pii": q_gazetteer_pii,
    "flatten_schema": q_flatten_schema,
    "doc_source_gate": q_doc_source_gate,
    "quarantine_vault": q_quarantine_vault,
    "canary_seed": q_canary_seed,
    "events_export": q_events_export,
    "udtf_chunk": q_udtf_chunk,
}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

def o_query_validate():
    idp = S.q(C.ID_PATTERN)
    return with_ctes(["queries"], f"""
        SELECT query_id, reason IS NULL AS valid, coalesce(reason, '') AS reject_reason, cast(length(q) AS BIGINT) AS query_chars
        FROM (SELECT query_id, trim(query) AS q,
                CASE WHEN trim(query) IS NULL OR length(trim(query)) < {C.QUERY_MIN_CHARS} OR length(trim(query)) > {C.QUERY_MAX_CHARS} THEN 'query_length'
                     WHEN NOT coalesce(regexp_matches(cast(user_id AS VARCHAR), {idp}), false) THEN 'user_id'
                     WHEN NOT coalesce(regexp_matches(tenant_id, {idp}), false) THEN 'tenant_id'
                     WHEN NOT (top_k BETWEEN {C.TOP_K_MIN} AND {C.TOP_K_MAX}) THEN 'top_k' END AS reason
              FROM queries)""")


def o_claim_check():
    vals = ", ".join(f"({S.q(a)}, {b}, {S.q(c)}, {S.qlist(d)})" for a, b, c, d in CLAIM_EXTRA)
    return with_ctes(["queries", "principals"], f"""
        SELECT request_id,
               CASE WHEN p.tenant_id IS NULL THEN 'unknown_user' WHEN p.tenant_id <> c.tenant_id THEN 'tenant_mismatch'
                    WHEN len(list_filter(c.roles, lambda r: NOT list_contains(coalesce(p.roles, []::VARCHAR[]), r))) > 0 THEN 'role_not_granted'
                    ELSE '' END AS reject_reason,
               array_to_string(list_sort(list_distinct(list_filter(c.roles, lambda r: NOT list_contains(coalesce(p.roles, []::VARCHAR[]), r)))), ',') AS ungranted_roles
        FROM (SELECT cast(query_id AS VARCHAR) AS request_id, user_id, tenant_id, roles FROM queries
              UNION ALL SELECT * FROM (VALUES {vals}) v(request_id, user_id, tenant_id, roles)) c
        LEFT JOIN principals p USING (user_id)""")


def o_canary_join():
    return with_ctes(["answers"], f"""
        SELECT a.query_id, t.token FROM answers a JOIN (SELECT unnest({S.qlist(C.CANARY_TOKENS)}) AS token) t
        ON contains(a.response, t.token)""")


def o_canary_seed():
    return with_ctes(["chunks"], f"""
        SELECT tenant_id, sensitivity_class, cast(sum(n) AS BIGINT) AS n_chunks FROM (
          SELECT tenant_id, sensitivity_class, 1 AS n FROM chunks WHERE NOT starts_with(doc_id, 'pdoc_')
          UNION ALL VALUES ('system', 'RESTRICTED', {len(C.CANARY_TOKENS)}))
        GROUP BY tenant_id, sensitivity_class""")


def o_events_export():
    from docshield.plans.analytics_queries import ALL, FEED_SEL, _all_ctes
    return with_ctes(ALL, f"SELECT id, time, type, risk FROM ({FEED_SEL} FROM feed)", extra=_all_ctes())


def o_canary_index():
    return f"""
        SELECT d.doc_id, t.token FROM documents d JOIN (SELECT DISTINCT substr(text, 1, {OPENING}) AS token FROM benchmark WHERE text <> '') t
        ON contains(d.text, t.token)"""


def o_gazetteer_pii():
    # every word-wrapped occurrence of the name that is the name alone
    names = ", ".join(f"({S.q(n)})" for n in FX.PERSON_NAMES)
    whole = "regexp_extract_all(text, '[\\p{L}\\p{N}_]*' || name || '[\\p{L}\\p{N}_]*')"
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, 'PERSON' AS entity_type, name, cast(n AS BIGINT) AS n
        FROM (SELECT doc_id, name, len(list_filter({whole}, lambda x: x = name)) AS n
              FROM docs_raw JOIN (VALUES {names}) g(name) ON contains(text, name))
        WHERE n > 0""")


def o_flatten_schema():
    from docshield.plans.pipeline_queries import decide_scores_sql
    return with_ctes(["scores"], f"""
        SELECT query_id, r.action AS "route.action", r.category AS "route.category", round(r.confidence, 4) AS "route.confidence",
               r.is_safe AS "route.is_safe"
        FROM (SELECT q.query_id, {decide_scores_sql('q.query', 's.top_label', 's.top_score', 's.query_id IS NOT NULL')} AS r
              FROM queries q LEFT JOIN scores s USING (query_id))""")


def o_chunk_table():
    from docshield.plans.analytics_queries import STEP, fixed_n
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id || '_chunk_' || cast(i AS VARCHAR) AS chunk_id, doc_id, tenant_id, sensitivity_class,
               cast(length(substr(scrubbed_text, i * {STEP} + 1, {C.CHUNK_SIZE})) AS BIGINT) AS n_chars
        FROM (SELECT *, unnest(range(0, {fixed_n('scrubbed_text')})) AS i FROM ingx WHERE status = 'ingested')""",
                     extra=IQ._ingest_ctes())


ORACLE = {
    "chunk_table": o_chunk_table,
    "query_validate": o_query_validate,
    "claim_check": o_claim_check,
    "canary_join": o_canary_join,
    "events_export": o_events_export,
    "canary_seed": o_canary_seed,
    "canary_index": o_canary_index,
    "gazetteer_pii": o_gazetteer_pii,
    "flatten_schema": o_flatten_schema,
}

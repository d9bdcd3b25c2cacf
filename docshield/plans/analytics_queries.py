"""Registered analytics, chunking and log-table queries (U1, E1–E4, A1–A12,
W2, W5, W7, X1, X4, X5, S4, S5, L1, L2) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docshield import constants as C
from docshield.operators import analytics as AN
from docshield.operators import chunking as CH
from docshield.operators import ingest as I
from docshield.operators import tamper as TA
from docshield.oracle import sql as S
from docshield.oracle.fixtures import with_ctes
from docshield.plans import ingest_queries as IQ
from docshield.plans import pipeline as P
from docshield.plans import pipeline_queries as PQ
from docshield.sources import fixtures as FX
from docshield.sources.files import cut
from docshield.sources.tables import read

EVENT_BUDGET = 5            # events hold at most 10 per user-day (FIXTURES §1)
RETENTION_AS_OF = "2025-01-10 00:00:00"
FEED_LIMIT = 50
SEARCH = ("query", None, "tenant_1")


def _events(spark, sf):
    return read(spark, sf, "events")


def _ingest_log(spark, sf, method="fixed"):
    s = IQ._scan(spark, sf)
    return I.ingest_log(s, CH.chunk_count(method))


def _logs(spark, sf):
    pq, cands = P.for_tables(spark, sf)
    audit = P.audit_log(pq, person_names=FX.PERSON_NAMES)
    inj = P.injection_log(pq, cands, FX.chunks(spark, sf))
    return pq, audit, inj


def _feed_cols(df):
    return df.select("id", "time", "type", "tenant", "user", "status", "risk", "details", "traceOrDocId")


def q_events_audit(spark, sf):
    _, audit, _ = _logs(spark, sf)
    return _feed_cols(AN.audit_events(audit))


def q_events_injection(spark, sf):
    _, _, inj = _logs(spark, sf)
    return _feed_cols(AN.injection_events(inj))


def q_events_ingestion(spark, sf):
    return _feed_cols(AN.ingestion_events(_ingest_log(spark, sf)))


def _newest_documents(docs, n: int):
    key = F.sha2(F.concat_ws("|", F.lit("ingest"), "doc_id", F.sha2("text", 256)), 256)
    return docs.withColumn("_id", key).orderBy(F.col("ingested_at").desc(), F.col("_id").desc()).limit(n).drop("_id")


def _ingest_log_newest(spark, sf, n: int):
    """The ingestion log restricted to its ``n`` newest rows.

    A log row's feed order (ingested_at, then its id = hash of doc id and
    raw-text hash) does not depend on the scan, so the top-n is taken on
    the raw rows and only those n documents are scanned.  They are written first: Catalyst pushes the scan's
    projections below the limit, and the top-n would become a sort of all texts."""
    top = cut(_newest_documents(FX.docs_raw(spark, sf), n))
    s = I.scan_documents(top, person_names=FX.PERSON_NAMES)
    return I.ingest_log(s, CH.chunk_count("fixed"))


def _feed(spark, sf):
    _, audit, inj = _logs(spark, sf)
    return AN.events_feed(audit, inj, _ingest_log_newest(spark, sf, FEED_LIMIT), FEED_LIMIT)


def q_events_feed(spark, sf):
    return _feed_cols(_feed(spark, sf))


def q_events_search(spark, sf):
    t, r, x = SEARCH
    return _feed_cols(AN.events_search(_feed(spark, sf), t, r, x))


def q_events_summary(spark, sf):
    f = _feed(spark, sf)
    total = f.agg(F.count(F.lit(1)).alias("n_events"),
                  F.count_if(F.col("status").isin("blocked", "quarantined")).alias("n_blocked"))
    return total.select(F.col("n_events").cast("bigint").alias("n_events"), F.col("n_blocked").cast("bigint").alias("n_blocked"))


def q_events_recent(spark, sf):
    """L2: the five newest feed events."""
    f = _feed(spark, sf)
    return _feed_cols(f.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(5))


def q_metric_canary(spark, sf):
    """A10: canary alerts per day."""
    pq, _, _ = _logs(spark, sf)
    a = P.canary_alerts(pq)
    return a.groupBy(F.date_format("detected_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("canary_alerts"))


def q_ingest_log(spark, sf):
    il = _ingest_log(spark, sf, "recursive")
    return il.select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), "chunks_stored",
                     "sensitivity_class", F.array_join("pii_entities_found", ",").alias("pii_entities_found"),
                     "text_modified")


def q_chunk_fixed(spark, sf):
    s = IQ._scan(spark, sf)
    c = CH.chunk_table(s, "fixed")
    return c.select("chunk_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                    F.sha2("text", 256).alias("text_sha"), "tenant_id", "sensitivity_class",
                    F.array_join("acl_roles", ",").alias("acl_roles"), "pii_redacted")


def q_chunk_recursive(spark, sf):
    s = IQ._scan(spark, sf)
    c = CH.chunk_table(s, "recursive")
    return c.select("chunk_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                    F.length("text").cast("bigint").alias("n_chars"), "tenant_id")


def q_chunk_count(spark, sf):
    s = IQ._scan(spark, sf)
    c = CH.chunk_table(s, "fixed")
    return c.groupBy("tenant_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"),
                                      F.countDistinct("doc_id").cast("bigint").alias("n_docs"))


def q_pii_counts(spark, sf):
    s = IQ._scan(spark, sf)
    e = s.select(F.explode("pii").alias("p"))
    return e.groupBy(F.col("p.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_metric_queries(spark, sf):
    pq, _, _ = _logs(spark, sf)
    return pq.groupBy(F.col("route.action").alias("action"), "tenant_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_metric_pii(spark, sf):
    s = IQ._scan(spark, sf).select(F.explode("pii").alias("p")).select(F.col("p.entity_type").alias("entity_type"),
                                                                      F.lit("ingest").alias("layer"))
    a = FX.answers(spark, sf)
    from docshield.functions import text as T
    o = a.select(F.explode(T.pii_spans("response", gazetteer=IQ.GAZ)).alias("p")).select(
        F.col("p.entity_type").alias("entity_type"), F.lit("output").alias("layer"))
    return s.unionByName(o).groupBy("entity_type", "layer").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_metric_rbac(spark, sf):
    from docshield.plans.access_queries import _global_pairs
    from docshield.operators.access import rbac_decide
    d = rbac_decide(_global_pairs(spark, sf)).where(~F.col("allowed"))
    reason = F.regexp_replace("reason", ":.*$", "")
    return d.groupBy(reason.alias("reason"), "tenant_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_metric_latency(spark, sf):
    h = AN.latency_histogram(FX.answers(spark, sf))
    cols = [F.col(c).cast("bigint").alias(c) for c in h.columns if c.startswith("le_") or c == "count"]
    return h.select(*cols, F.col("sum_ms").cast("bigint").alias("sum_ms"), F.round("p95_ms", 6).alias("p95_ms"))


def _breaker(spark, sf):
    e = _events(spark, sf)
    return AN.circuit_state(e, F.col("event_type") == "error")


def q_circuit_open(spark, sf):
    return _breaker(spark, sf).select("event_id", F.col("recent_failures").cast("bigint").alias("recent_failures"),
                                      "breaker_open")


def q_metric_totals(spark, sf):
    b = _breaker(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if("breaker_open").alias("circuit_open"))
    bud = AN.daily_budget(_events(spark, sf), EVENT_BUDGET).groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(~F.col("allowed")).alias("budget_exceeded"))
    j = b.join(bud, "day", "full")
    return j.select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                    F.coalesce("circuit_open", F.lit(0)).cast("bigint").alias("circuit_open"),
                    F.coalesce("budget_exceeded", F.lit(0)).cast("bigint").alias("budget_exceeded"))


def q_dp_budget(spark, sf):
    d = AN.daily_budget(_events(spark, sf), EVENT_BUDGET)
    return d.select("event_id", F.col("day_n").cast("bigint").alias("day_n"), "allowed")


def q_dp_budget_daily(spark, sf):
    d = AN.budget_daily_counts(_events(spark, sf), EVENT_BUDGET)
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
                    F.col("n_requests").cast("bigint").alias("n_requests"), F.col("n_blocked").cast("bigint").alias("n_blocked"))


def q_rate_limit(spark, sf):
    e = _events(spark, sf)
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    ref = AN.rate_limit(e, C.RATE_LIMITS["query"][0], "1 minute", key).select("event_id", F.col("over_limit").alias("over_60_per_min"))
    tight = AN.rate_limit(e, 2, "1 hour", key).select("event_id", F.col("over_limit").alias("over_2_per_hour"))
    return ref.join(tight, "event_id")


#: Seconds of the log that a second of the replay holds: the log's requests, brought together until limits are reached.
REPLAY_SPEED = 3600


def q_rate_limit_endpoints(spark, sf):
    """W7 for every endpoint, on the log replayed at REPLAY_SPEED: the three kinds of callers, each endpoint at its own limit."""
    e = _events(spark, sf)
    us = F.floor(F.unix_micros("ts") / REPLAY_SPEED)
    e = e.select("event_id", F.timestamp_micros(us).alias("ts"), F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("principal"),
                 F.when(F.col("user_id") % 3 <= 1, F.concat(F.lit("token"), (F.col("user_id") % 7).cast("string"))).alias("token"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")).alias("ip"))
    key = AN.rate_limit_key(F.col("principal"), F.col("token"), F.col("ip"))
    out = None
    for endpoint in C.RATE_LIMITS:
        r = AN.endpoint_limit(e, endpoint, key).select("event_id", F.lit(endpoint).alias("endpoint"), F.substring_index("rl_key", ":", 1).alias("kind"), F.col("rl_n").cast("bigint").alias("n"), "over_limit")
        out = r if out is None else out.unionByName(r)
    return out


def _sealed_log(spark, sf):
    """The events as an audit log, and the same log after some rows were changed, moved, removed and added."""
    e = _events(spark, sf)
    log = e.select(F.col("event_id").alias("id"), F.sha2(F.concat(F.lit("trace|"), F.col("event_id").cast("string")), 256).alias("trace_id"), "user_id",
                   F.concat(F.lit("tenant_"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), F.col("event_type").alias("query"), F.col("ts").alias("timestamp"))
    k = F.col("id")
    kept = log.where(k % 1009 != 7).withColumns({
        "user_id": F.when(k % 997 == 5, F.col("user_id") + 1).otherwise(F.col("user_id")),
        "timestamp": F.when(k % 1511 == 3, F.col("timestamp") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("timestamp"))})
    return log, kept.unionByName(log.where(k % 2003 == 11).withColumn("id", -k - 1))


def q_audit_tamper(spark, sf):
    log, later = _sealed_log(spark, sf)
    sealed = cut(TA.checksums(log))
    return TA.tampered(sealed, cut(TA.tree(sealed, cut)), later, cut).select("id", "kind")


def q_audit_proof(spark, sf):
    log, later = _sealed_log(spark, sf)
    sealed = cut(TA.checksums(log))
    nodes = cut(TA.tree(sealed, cut))
    return TA.verified(later, TA.proofs(sealed, nodes), nodes.where("level = 0")).select("id", "included")


def q_audit_retention(spark, sf):
    e = AN.retention(_events(spark, sf), "ts", RETENTION_AS_OF)
    return e.select("event_id", "retained")


def q_reingest_dups(spark, sf):
    d = AN.reingest_duplicates(FX.docs_raw(spark, sf))
    return d.select("document_hash", "doc_id", F.col("n_copies").cast("bigint").alias("n_copies"), "first_doc_id")


QUERIES = {
    "events_audit": q_events_audit,
    "events_injection": q_events_injection,
    "events_ingestion": q_events_ingestion,
    "events_feed": q_events_feed,
    "events_search": q_events_search,
    "events_summary": q_events_summary,
    "events_recent": q_events_recent,
    "metric_canary": q_metric_canary,
    "ingest_log": q_ingest_log,
    "chunk_fixed": q_chunk_fixed,
    "chunk_recursive": q_chunk_recursive,
    "chunk_count": q_chunk_count,
    "pii_counts": q_pii_counts,
    "metric_queries": q_metric_queries,
    "metric_pii": q_metric_pii,
    "metric_rbac": q_metric_rbac,
    "metric_latency": q_metric_latency,
    "circuit_open": q_circuit_open,
    "metric_totals": q_metric_totals,
    "dp_budget": q_dp_budget,
    "dp_budget_daily": q_dp_budget_daily,
    "rate_limit": q_rate_limit,
    "rate_limit_endpoints": q_rate_limit_endpoints,
    "audit_retention": q_audit_retention,
    "audit_tamper": q_audit_tamper,
    "audit_proof": q_audit_proof,
    "reingest_dups": q_reingest_dups,
}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

def iso_z(ts):
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 <> 0 "
            f"THEN '.' || lpad(cast(microsecond({ts}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z')")


STEP = C.CHUNK_SIZE - C.CHUNK_OVERLAP


def fixed_n(t):
    return f"(CASE WHEN regexp_matches({t}, '\\S') THEN greatest(cast(ceil((length({t}) - {C.CHUNK_OVERLAP}) / {STEP}.0) AS BIGINT), 1) ELSE 0 END)"


def _ingest_log_ctes():
    return IQ._ingest_ctes() + f""",
ilog AS (
  SELECT sha256('ingest|' || doc_id || '|' || document_hash) AS id, doc_id, document_hash, tenant_id,
         coalesce(source, 'unknown') AS source, status, reason,
         CASE WHEN status = 'ingested' THEN {fixed_n('scrubbed_text')} ELSE 0 END AS chunks_stored,
         sensitivity_class, text_modified, ingested_at
  FROM ingx)"""


AUDIT_EV = f"""
  SELECT id, "timestamp" AS ts, {iso_z('"timestamp"')} AS time, 'query' AS type, tenant_id AS tenant, user_id AS "user",
         CASE WHEN route_action = 'block' OR rbac_blocked > 0 THEN 'blocked' ELSE 'success' END AS status,
         CASE WHEN canary_leaked THEN 'critical' WHEN route_action = 'block' OR rbac_blocked > 0 THEN 'high'
              WHEN pii_redacted > 0 THEN 'medium' ELSE 'low' END AS risk,
         'Query: ' || substr(query, 1, 120) || '... | Chunks: ' || cast(chunks_used AS VARCHAR) || ' (Blocked: '
           || cast(rbac_blocked AS VARCHAR) || ') | PII Redacted: ' || cast(pii_redacted AS VARCHAR)
           || CASE WHEN canary_leaked THEN ' [CANARY LEAK DETECTED]' ELSE '' END AS details,
         id AS "traceOrDocId"
  FROM audit"""


INJ_EV = f"""
  SELECT id, detected_at AS ts, {iso_z('detected_at')} AS time, 'query' AS type, coalesce(tenant_id, 'default') AS tenant,
         coalesce(user_id, 'unknown') AS "user", 'blocked' AS status, 'high' AS risk,
         'Blocked prompt injection/jailbreak attempt (Category: ' || coalesce(category, 'None') || ', Confidence: '
           || printf('%.2f', confidence) || ') Query: ' || substr(raw_query, 1, 100) || '...' AS details,
         id AS "traceOrDocId"
  FROM injl"""

ING_EV = f"""
  SELECT id, ingested_at AS ts, {iso_z('ingested_at')} AS time,
         CASE WHEN source = 'manual_input' THEN 'text_ingest' ELSE 'file_ingest' END AS type, tenant_id AS tenant,
         'system' AS "user",
         CASE WHEN status = 'quarantined' THEN 'blocked' WHEN status = 'skipped' THEN 'warning' ELSE 'success' END AS status,
         CASE WHEN status = 'quarantined' THEN 'critical' WHEN status = 'skipped' THEN 'medium'
              WHEN text_modified THEN 'medium' ELSE 'low' END AS risk,
         'Source: ' || source || ' | Chunks: ' || cast(chunks_stored AS VARCHAR) || ' | Sensitivity: ' || sensitivity_class
           || ' | Status: ' || status || CASE WHEN reason IS NOT NULL AND reason <> '' THEN ' (Reason: ' || reason || ')' ELSE '' END AS details,
         doc_id AS "traceOrDocId"
  FROM ilog"""

FEED_SEL = 'SELECT id, time, type, tenant, "user", status, risk, details, "traceOrDocId"'


def _injl_cte():
    return """,
injl AS (
  SELECT sha256('inj|' || cast(query_id AS VARCHAR) || '|' || cast(k AS VARCHAR)) AS id,
         cast(user_id AS VARCHAR) AS user_id, tenant_id, raw_query, action, category, cast(confidence AS DOUBLE) AS confidence,
         ts AS detected_at
  FROM (
    SELECT query_id, 0 AS k, user_id, tenant_id, query AS raw_query, route.action AS action, route.category AS category,
           route.confidence AS confidence, ts FROM pfinal WHERE blocked_at = 'raw'
    UNION ALL
    SELECT query_id, 1, user_id, tenant_id, standalone_query, route.action, route.category, route.confidence, ts
    FROM pfinal WHERE blocked_at = 'rephrased'
    UNION ALL
    SELECT g.query_id, 100 + g.rank, p.user_id, p.tenant_id, 'Retrieved chunk injection: ' || substr(g.text, 1, 200),
           'flag', 'indirect_prompt_injection', round(1.0 - g.trust / 10.0, 4), p.ts
    FROM grx g JOIN pfinal p USING (query_id) WHERE g.action IN ('drop', 'wrap')))"""


ALL = PQ.PIPE + ["docs_raw"]


def _all_ctes():
    return PQ._audit_ctes() + _injl_cte() + ",\n" + _ingest_log_ctes().lstrip("\n") + f""",
ev_a AS ({AUDIT_EV}),
ev_i AS ({INJ_EV}),
ev_g AS ({ING_EV}),
feed AS (
  SELECT * FROM (
    (SELECT * FROM ev_a ORDER BY ts DESC, id DESC LIMIT {FEED_LIMIT})
    UNION ALL (SELECT * FROM ev_i ORDER BY ts DESC, id DESC LIMIT {FEED_LIMIT})
    UNION ALL (SELECT * FROM ev_g ORDER BY ts DESC, id DESC LIMIT {FEED_LIMIT}))
  ORDER BY ts DESC, id DESC LIMIT {FEED_LIMIT})"""


def o_events_audit():
    return with_ctes(ALL, f"{FEED_SEL} FROM ev_a", extra=_all_ctes())


def o_events_injection():
    return with_ctes(ALL, f"{FEED_SEL} FROM ev_i", extra=_all_ctes())


def o_events_ingestion():
    return with_ctes(["docs_raw"], f"{FEED_SEL} FROM ({ING_EV})", extra=_ingest_log_ctes())


def o_events_feed():
    return with_ctes(ALL, f"{FEED_SEL} FROM feed", extra=_all_ctes())


def o_events_search():
    t, r, x = SEARCH
    cond = [f"type = {S.q(t)}"] if t else []
    if r:
        cond.append(f"risk = {S.q(r)}")
    if x:
        lx = S.q(x.lower())
        cond.append(f"(contains(lower(\"user\"), {lx}) OR contains(lower(tenant), {lx}) OR contains(lower(\"traceOrDocId\"), {lx}) "
                    f"OR contains(lower(details), {lx}))")
    return with_ctes(ALL, f"{FEED_SEL} FROM feed WHERE {' AND '.join(cond)}", extra=_all_ctes())


def o_events_summary():
    return with_ctes(ALL, """SELECT cast(count(*) AS BIGINT) AS n_events,
        cast(count(*) FILTER (WHERE status IN ('blocked', 'quarantined')) AS BIGINT) AS n_blocked FROM feed""",
                     extra=_all_ctes())


def o_events_recent():
    return with_ctes(ALL, f"{FEED_SEL} FROM feed ORDER BY ts DESC, id DESC LIMIT 5", extra=_all_ctes())


def o_metric_canary():
    return with_ctes(PQ.PIPE, """
        SELECT strftime(ts, '%Y-%m-%d') AS day, cast(sum(len(canary_tokens)) AS BIGINT) AS canary_alerts
        FROM pfinal WHERE canary_leaked GROUP BY 1""", extra=PQ._pipeline_ctes())


def o_chunk_fixed():
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id || '_chunk_' || cast(i AS VARCHAR) AS chunk_id, doc_id, cast(i AS BIGINT) AS chunk_index,
               sha256(substr(scrubbed_text, i * {STEP} + 1, {C.CHUNK_SIZE})) AS text_sha, tenant_id, sensitivity_class,
               array_to_string(acl_roles, ',') AS acl_roles, was_modified AS pii_redacted
        FROM (SELECT *, unnest(range(0, {fixed_n('scrubbed_text')})) AS i FROM ingx WHERE status = 'ingested')""",
                     extra=IQ._ingest_ctes())


def o_chunk_count():
    return with_ctes(["docs_raw"], f"""
        SELECT tenant_id, cast(sum({fixed_n('scrubbed_text')}) AS BIGINT) AS n_chunks, cast(count(*) AS BIGINT) AS n_docs
        FROM ingx WHERE status = 'ingested' AND {fixed_n('scrubbed_text')} > 0 GROUP BY tenant_id""", extra=IQ._ingest_ctes())


def o_pii_counts():
    return with_ctes(["docs_raw"], "SELECT entity_type, cast(count(*) AS BIGINT) AS n FROM ing_pii GROUP BY entity_type",
                     extra=IQ._ingest_ctes())


def o_metric_queries():
    return with_ctes(PQ.PIPE, "SELECT route.action AS action, tenant_id, cast(count(*) AS BIGINT) AS n FROM pfinal GROUP BY 1, 2",
                     extra=PQ._pipeline_ctes())


def o_metric_pii():
    return with_ctes(["docs_raw", "answers"], f"""
        SELECT entity_type, layer, cast(count(*) AS BIGINT) AS n FROM (
          SELECT entity_type, 'ingest' AS layer FROM ing_pii
          UNION ALL SELECT entity_type, 'output' FROM ({S.pii_span_rows('answers', key='query_id', t='response', gazetteer=IQ.GAZ)}))
        GROUP BY 1, 2""", extra=IQ._ingest_ctes())


def o_metric_rbac():
    from docshield.plans.access_queries import _global_ctes, _freason
    return with_ctes(["queries", "chunks"], f"""
        SELECT regexp_replace(reason, ':.*$', '') AS reason, tenant_id, cast(count(*) AS BIGINT) AS n
        FROM (SELECT tenant_id, {_freason()} AS reason FROM gp) WHERE reason <> 'ok' GROUP BY 1, 2""", extra=_global_ctes())


def o_metric_latency():
    cols = ", ".join(f"cast(count(*) FILTER (WHERE latency_ms <= {b * 1000}) AS BIGINT) AS le_{str(b).replace('.', '_')}"
                     for b in AN.LATENCY_BUCKETS_SEC)
    return with_ctes(["answers"], f"""
        SELECT {cols}, cast(count(*) AS BIGINT) AS count, cast(sum(latency_ms) AS BIGINT) AS sum_ms,
               round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM answers""")


BREAKER = f"""
brk AS (
  SELECT event_id, ts, coalesce((SELECT count(*) FROM events f WHERE f.event_type = 'error' AND f.ts < e.ts
                                 AND f.ts > e.ts - INTERVAL {C.BREAKER_WINDOW_SEC} SECOND), 0) AS recent_failures
  FROM events e)"""


def o_circuit_open():
    return with_ctes([], f"SELECT event_id, cast(recent_failures AS BIGINT) AS recent_failures, recent_failures >= {C.BREAKER_FAILURES} AS breaker_open FROM brk",
                     extra=BREAKER)


def _budget_cte():
    return f"""
bud AS (SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id, cast(ts AS DATE) ORDER BY ts, event_id) AS day_n
        FROM events)"""


def _sealed_ctes():
    return """
        WITH log AS (SELECT event_id AS id, user_id, event_type AS query, ts FROM events),
        later AS (SELECT id, user_id + CASE WHEN id % 997 = 5 THEN 1 ELSE 0 END AS user_id, query,
                         ts + CASE WHEN id % 1511 = 3 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ts FROM log WHERE id % 1009 <> 7
                  UNION ALL SELECT -id - 1, user_id, query, ts FROM log WHERE id % 2003 = 11)"""


def o_audit_tamper():
    return _sealed_ctes() + """
        SELECT coalesce(l.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'removed' WHEN l.id IS NULL THEN 'added' ELSE 'changed' END AS kind
        FROM log l FULL JOIN later n ON l.id = n.id
        WHERE n.id IS NULL OR l.id IS NULL OR l.user_id <> n.user_id OR l.query <> n.query OR l.ts <> n.ts"""


def o_audit_proof():
    return _sealed_ctes() + """
        SELECT n.id, l.id IS NOT NULL AND l.user_id = n.user_id AND l.query = n.query AND l.ts = n.ts AS included
        FROM later n LEFT JOIN log l ON l.id = n.id"""


def o_metric_totals():
    return with_ctes([], f"""
        SELECT strftime(day, '%Y-%m-%d') AS day, cast(coalesce(b.circuit_open, 0) AS BIGINT) AS circuit_open,
               cast(coalesce(u.budget_exceeded, 0) AS BIGINT) AS budget_exceeded
        FROM (SELECT cast(ts AS DATE) AS day, count(*) FILTER (WHERE recent_failures >= {C.BREAKER_FAILURES}) AS circuit_open
              FROM brk GROUP BY 1) b
        FULL JOIN (SELECT cast(ts AS DATE) AS day, count(*) FILTER (WHERE day_n > {EVENT_BUDGET}) AS budget_exceeded
                   FROM bud GROUP BY 1) u USING (day)""", extra=BREAKER + "," + _budget_cte())


def o_dp_budget():
    return with_ctes([], f"SELECT event_id, cast(day_n AS BIGINT) AS day_n, day_n <= {EVENT_BUDGET} AS allowed FROM bud",
                     extra=_budget_cte())


def o_dp_budget_daily():
    return with_ctes([], f"""
        SELECT user_id, strftime(cast(ts AS DATE), '%Y-%m-%d') AS day, cast(count(*) AS BIGINT) AS n_requests,
               cast(greatest(count(*) - {EVENT_BUDGET}, 0) AS BIGINT) AS n_blocked
        FROM events GROUP BY user_id, cast(ts AS DATE)""")


def o_rate_limit():
    return with_ctes([], f"""
        SELECT event_id,
               row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) > {C.RATE_LIMITS['query'][0]} AS over_60_per_min,
               row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 2 AS over_2_per_hour
        FROM events""")


def o_rate_limit_endpoints():
    each = " UNION ALL ".join(f"""
        SELECT event_id, '{name}' AS endpoint, split_part(key, ':', 1) AS kind,
               cast(row_number() OVER (PARTITION BY key, us // {sec * 1_000_000} ORDER BY us, event_id) AS BIGINT) AS n,
               row_number() OVER (PARTITION BY key, us // {sec * 1_000_000} ORDER BY us, event_id) > {n} AS over_limit FROM k""" for name, (n, sec) in C.RATE_LIMITS.items())
    return f"""
        WITH k AS (SELECT event_id, epoch_us(ts) // {REPLAY_SPEED} AS us,
                          CASE WHEN user_id % 3 = 0 THEN 'user:' || user_id WHEN user_id % 3 = 1 THEN 'session:' || sha256('token' || user_id % 7)
                               ELSE 'ip:10.0.0.' || user_id % 5 END AS key FROM events)
        {each}"""


def o_audit_retention():
    return with_ctes([], f"""
        SELECT event_id, ts >= TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL {C.RETENTION_DAYS} DAY AS retained FROM events""")


def o_reingest_dups():
    return with_ctes(["docs_raw"], """
        SELECT document_hash, doc_id, n_copies, first_doc_id FROM (
          SELECT sha256(text) AS document_hash, doc_id,
                 cast(count(*) OVER (PARTITION BY sha256(text)) AS BIGINT) AS n_copies,
                 min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc_id
          FROM docs_raw) WHERE n_copies > 1""")


ORACLE = {
    "events_audit": o_events_audit,
    "events_injection": o_events_injection,
    "events_ingestion": o_events_ingestion,
    "events_feed": o_events_feed,
    "events_search": o_events_search,
    "events_summary": o_events_summary,
    "events_recent": o_events_recent,
    "metric_canary": o_metric_canary,
    "chunk_fixed": o_chunk_fixed,
    "chunk_count": o_chunk_count,
    "pii_counts": o_pii_counts,
    "metric_queries": o_metric_queries,
    "metric_pii": o_metric_pii,
    "metric_rbac": o_metric_rbac,
    "metric_latency": o_metric_latency,
    "circuit_open": o_circuit_open,
    "metric_totals": o_metric_totals,
    "dp_budget": o_dp_budget,
    "dp_budget_daily": o_dp_budget_daily,
    "rate_limit": o_rate_limit,
    "rate_limit_endpoints": o_rate_limit_endpoints,
    "audit_retention": o_audit_retention,
    "audit_tamper": o_audit_tamper,
    "audit_proof": o_audit_proof,
    "reingest_dups": o_reingest_dups,
}

"""Registered routing, conversation, answer and audit queries (T13–T20,
O1–O3, H1–H4, S8–S10, W3, W4) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.operators import answers as AN
from docshield.operators import route as RT
from docshield.oracle import sql as S
from docshield.oracle.fixtures import with_ctes
from docshield.plans import pipeline as P
from docshield.plans.access_queries import guarded_ctes
from docshield.sources import fixtures as FX
from docshield.sources.tables import read

GAZ = {"PERSON": FX.PERSON_NAMES}


def _route_cols(c):
    return [F.col(f"{c}.action").alias("action"), F.col(f"{c}.category").alias("category"),
            F.round(F.col(f"{c}.confidence"), 4).alias("confidence"), F.col(f"{c}.is_safe").alias("is_safe")]


def q_route_fast(spark, sf):
    q = FX.queries(spark, sf)
    return q.select("query_id", RT.fast_block("query").alias("fast_block"))


def q_route_scores(spark, sf):
    r = RT.route_with_scores(FX.queries(spark, sf), FX.scores(spark, sf))
    return r.select("query_id", *_route_cols("route"))


def q_route_guard(spark, sf):
    r = RT.route_with_guard(FX.queries(spark, sf), FX.guard_scores(spark, sf))
    return r.select("query_id", *_route_cols("route"))


def q_route_failclosed(spark, sf):
    q, s = FX.queries(spark, sf), FX.scores(spark, sf)
    closed = RT.route_with_scores(q, s, out="closed", fail_closed=True)
    both = RT.route_with_scores(closed, s, out="open", fail_closed=False)
    return both.select("query_id", F.col("closed.action").alias("closed_action"),
                       F.col("closed.category").alias("closed_category"), F.col("open.action").alias("open_action"))


def q_route_two_pass(spark, sf):
    r = RT.two_pass(FX.queries(spark, sf), FX.scores(spark, sf), FX.rewrites(spark, sf))
    return r.select("query_id", F.col("route.action").alias("action"), F.col("route.category").alias("category"),
                    F.coalesce("blocked_at", F.lit("")).alias("blocked_at"),
                    F.sha2(F.col("safe_query"), 256).alias("safe_query_sha"))


def _history(spark, sf):
    cv = read(spark, sf, "conversations")
    return cv.select("conv_id", "turn", "role", "text")


def q_rephrase_prompt(spark, sf):
    """T19 + W4: prompt from the previous six messages, for user turns with history."""
    h = previous_messages(_history(spark, sf))
    u = h.where((F.col("role") == "user") & (F.size("prev") > 0))
    prompt = F.concat(F.lit(C.REPHRASE_HEAD + "History:\n"), F.array_join("prev", "\n"),
                      F.lit("\n\nFollow-up: "), F.col("text"), F.lit("\n\nStandalone Question:"))
    return u.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
                    F.size("prev").cast("bigint").alias("n_history"), F.sha2(prompt, 256).alias("prompt_sha"))


def q_history_last(spark, sf):
    """Messages retained per conversation (last 10, and last 4).

    The kept set is a top-N per conversation (planned with a partial
    WindowGroupLimit, so at most N rows per task leave for the shuffle) and
    is joined back to every message."""
    h = _history(spark, sf)
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    top = h.select("conv_id", "turn").withColumn("from_end", F.row_number().over(w)) \
        .where(F.col("from_end") <= C.HISTORY_KEEP)
    r = h.select("conv_id", "turn").join(top, ["conv_id", "turn"], "left")
    return r.select("conv_id", "turn", F.coalesce(F.col("from_end") <= C.HISTORY_KEEP, F.lit(False)).alias("kept_10"),
                    F.coalesce(F.col("from_end") <= 4, F.lit(False)).alias("kept_4"))


def previous_messages(h, n: int = C.REPHRASE_CONTEXT, bucket_rows: int = 1024):
    """For every message, its previous ``n`` messages (role: text).

    Rows are split into buckets of ``bucket_rows`` consecutive turn numbers per
    conversation, so the sliding frame never needs a whole conversation in one
    task.  A bucket's last rows are copied into each later bucket that still
    reaches back to them: with fewer than ``n`` rows between, whatever the gap
    in the turn numbers.  Rows without a conversation are one group; those
    without a turn come first in theirs."""
    d = h.withColumn("_b", F.floor(F.col("turn") / bucket_rows))
    follow = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(1, n)
    later = d.groupBy("conv_id", "_b").agg(F.count("*").alias("_c")) \
        .withColumn("_later", F.collect_list(F.struct(F.col("_b").alias("b"), F.col("_c").alias("c"))).over(follow)) \
        .where(F.size("_later") > 0).select(F.col("conv_id").alias("_conv"), F.col("_b").alias("_from"), "_later")
    wend = Window.partitionBy("conv_id", "_b").orderBy(F.col("turn").desc())
    tail = d.withColumn("_k", F.row_number().over(wend)).where(F.col("_k") <= n)
    tail = tail.join(later, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_b").eqNullSafe(F.col("_from"))) \
        .select("conv_id", "turn", "role", "text", "_k", "_later", F.posexplode("_later").alias("_at", "_to"))
    between = F.aggregate(F.slice("_later", F.lit(1), F.col("_at")), F.lit(0).cast("long"), lambda acc, x: acc + x["c"])
    tail = tail.where(F.col("_k") - 1 + between < n) \
        .select("conv_id", "turn", "role", "text", F.col("_to.b").alias("_b"), F.lit(True).alias("_carry"))
    u = d.withColumn("_carry", F.lit(False)).unionByName(tail, allowMissingColumns=True)
    w = Window.partitionBy("conv_id", "_b").orderBy("turn").rowsBetween(-n, -1)
    p = u.withColumn("prev", F.collect_list(F.concat("role", F.lit(": "), "text")).over(w))
    return p.where(~F.col("_carry")).drop("_b", "_carry")


def q_history_prev6(spark, sf):
    """The previous six messages of every message in its conversation."""
    p = previous_messages(_history(spark, sf))
    return p.select("conv_id", "turn", F.size("prev").cast("bigint").alias("n_prev"),
                    F.sha2(F.array_join("prev", "\n"), 256).alias("prev_sha"))


def q_canary_scan(spark, sf):
    a = FX.answers(spark, sf)
    f = AN.canary_found("response")
    return a.select("query_id", F.array_join(f, ",").alias("tokens"), (F.size(f) > 0).alias("leaked"),
                    F.sha2(AN.canary_redact("response", f), 256).alias("redacted_sha"))


def q_output_sanitize(spark, sf):
    a = AN.sanitize(FX.answers(spark, sf), "response", "o", person_names=FX.PERSON_NAMES)
    return a.select("query_id", F.col("o_safe").alias("safe_response"), F.col("o_pii_count").cast("bigint").alias("pii_count"),
                    F.col("o_violations").alias("violations"))


def _pipeline(spark, sf):
    return P.for_tables(spark, sf)


def q_guarded_answers(spark, sf):
    pq, _ = _pipeline(spark, sf)
    return pq.select("query_id", "status", "safe_response", "chunks_used", "rbac_blocked", "pii_redacted",
                     "canary_leaked", "hallucination_risk", "violations")


def q_grounding_risk(spark, sf):
    pq, _ = _pipeline(spark, sf)
    return pq.where(F.col("status") == "answered").select("query_id", "hallucination_risk")


def q_audit_log(spark, sf):
    pq, _ = _pipeline(spark, sf)
    a = P.audit_log(pq, person_names=FX.PERSON_NAMES)
    return a.select("trace_id", "user_id", "tenant_id", "query", "response", "chunks_used", "rbac_blocked",
                    "pii_redacted", "canary_leaked", "violations", "latency_ms", "route_action",
                    F.coalesce("route_category", F.lit("")).alias("route_category"),
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "checksum")


def q_audit_checksum(spark, sf):
    pq, _ = _pipeline(spark, sf)
    a = P.audit_log(pq, person_names=FX.PERSON_NAMES)
    bad = AN.verify_checksums(a).select("id", F.lit(True).alias("tampered"))
    return a.select("id", "checksum").join(bad, "id", "left").select(
        "id", "checksum", F.coalesce("tampered", F.lit(False)).alias("tampered"))


def q_audit_chain(spark, sf):
    pq, _ = _pipeline(spark, sf)
    a = P.audit_log(pq, person_names=FX.PERSON_NAMES).withColumn("day", F.to_date("timestamp"))
    r = AN.merkle_roots(a)
    return r.select("tenant_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "root")


def q_canary_alerts(spark, sf):
    pq, _ = _pipeline(spark, sf)
    return P.canary_alerts(pq).select("trace_id", "user_id", "tenant_id", "canary_token", "query",
                                      F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected_at"))


def q_injection_log(spark, sf):
    pq, cands = _pipeline(spark, sf)
    return P.injection_log(pq, cands, FX.chunks(spark, sf)).select("id", "trace_id", "user_id", "tenant_id", "raw_query", "action", "category",
                                             "confidence", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss").alias("detected_at"))


QUERIES = {
    "route_fast": q_route_fast,
    "route_scores": q_route_scores,
    "route_guard": q_route_guard,
    "route_failclosed": q_route_failclosed,
    "route_two_pass": q_route_two_pass,
    "rephrase_prompt": q_rephrase_prompt,
    "history_last10": q_history_last,
    "history_prev6": q_history_prev6,
    "canary_scan": q_canary_scan,
    "output_sanitize": q_output_sanitize,
    "guarded_answers": q_guarded_answers,
    "grounding_risk": q_grounding_risk,
    "audit_log": q_audit_log,
    "audit_checksum": q_audit_checksum,
    "audit_chain": q_audit_chain,
    "canary_alerts": q_canary_alerts,
    "injection_log": q_injection_log,
}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

FAST = S.q(RT.FAST_PATTERN)
BLOCKS = S.qlist(C.ROUTER_BLOCK_CATEGORIES)


def cat_sql(label):
    arms = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in C.ROUTER_CATEGORY.items())
    return f"(CASE {label} {arms} END)"


def _struct(action, category, confidence, is_safe):
    return (f"{{'action': {action}, 'category': {category}, 'confidence': cast({confidence} AS DOUBLE), "
            f"'is_safe': {is_safe}}}")


def decide_scores_sql(text, label, score, has, fail_closed=True):
    safe = f"({label} = 'safe question')"
    cat = f"(CASE WHEN NOT {safe} THEN {cat_sql(label)} END)"
    blk = f"(NOT {safe} AND {score} >= {C.ROUTER_THRESHOLD} AND coalesce(list_contains({BLOCKS}, {cat}), false))"
    action = f"(CASE WHEN {blk} THEN 'block' WHEN NOT {safe} THEN 'flag' ELSE 'allow' END)"
    failed = (_struct("'block'", "'security_classifier_unavailable'", "0.0", "false") if fail_closed
              else _struct("'allow'", "NULL::VARCHAR", "0.0", "true"))
    return (f"(CASE WHEN coalesce(regexp_matches({text}, {FAST}), false) THEN {_struct(chr(39) + 'block' + chr(39), chr(39) + 'prompt_injection' + chr(39), '1.0', 'false')} "
            f"WHEN NOT {has} THEN {failed} "
            f"ELSE {_struct(action, cat, f'round({score}, 4)', f'({safe} OR NOT {blk})')} END)")


def decide_guard_sql(text, is_safe, category, confidence, has):
    safe = f"coalesce({is_safe}, true)"
    cat = f"(CASE WHEN NOT {safe} THEN {category} END)"
    blk = f"(NOT {safe} AND coalesce(list_contains({BLOCKS}, {cat}), false))"
    action = f"(CASE WHEN {blk} THEN 'block' WHEN NOT {safe} THEN 'flag' ELSE 'allow' END)"
    return (f"(CASE WHEN coalesce(regexp_matches({text}, {FAST}), false) THEN {_struct(chr(39) + 'block' + chr(39), chr(39) + 'prompt_injection' + chr(39), '1.0', 'false')} "
            f"WHEN NOT {has} THEN {_struct(chr(39) + 'block' + chr(39), chr(39) + 'security_classifier_unavailable' + chr(39), '0.0', 'false')} "
            f"ELSE {_struct(action, cat, f'coalesce({confidence}, 1.0)', f'({safe} OR NOT {blk})')} END)")


def _rcols(c):
    return f"{c}.action AS action, {c}.category AS category, round({c}.confidence, 4) AS confidence, {c}.is_safe AS is_safe"


def o_route_fast():
    return with_ctes(["queries"], f"SELECT query_id, coalesce(regexp_matches(query, {FAST}), false) AS fast_block FROM queries")


def o_route_scores():
    return with_ctes(["scores"], f"""
        SELECT query_id, {_rcols('r')} FROM (
          SELECT q.query_id, {decide_scores_sql('q.query', 's.top_label', 's.top_score', 's.query_id IS NOT NULL')} AS r
          FROM queries q LEFT JOIN scores s USING (query_id))""")


def o_route_guard():
    return with_ctes(["guard_scores"], f"""
        SELECT query_id, {_rcols('r')} FROM (
          SELECT q.query_id, {decide_guard_sql('q.query', 'g.is_safe', 'g.category', 'g.confidence', 'g.query_id IS NOT NULL')} AS r
          FROM queries q LEFT JOIN guard_scores g USING (query_id))""")


def o_route_failclosed():
    return with_ctes(["scores"], f"""
        SELECT query_id, c.action AS closed_action, c.category AS closed_category, o.action AS open_action FROM (
          SELECT q.query_id, {decide_scores_sql('q.query', 's.top_label', 's.top_score', 's.query_id IS NOT NULL')} AS c,
                 {decide_scores_sql('q.query', 's.top_label', 's.top_score', 's.query_id IS NOT NULL', False)} AS o
          FROM queries q LEFT JOIN scores s USING (query_id))""")


def _pipeline_route_ctes():
    return f"""
pq0 AS (SELECT q.*, row_number() OVER (PARTITION BY user_id, cast(ts AS DATE) ORDER BY ts, query_id) AS day_n FROM queries q),
pq1 AS (SELECT p.*, coalesce(r.standalone_query, p.query) AS standalone_query, s.top_label, s.top_score,
               s.query_id IS NOT NULL AS has_score,
               CASE WHEN r.standalone_query IS NULL THEN s.top_label ELSE r.top_label END AS label2,
               CASE WHEN r.standalone_query IS NULL THEN s.top_score ELSE r.top_score END AS score2,
               CASE WHEN r.standalone_query IS NULL THEN s.query_id IS NOT NULL ELSE r.top_label IS NOT NULL AND r.top_score IS NOT NULL END AS has2
        FROM pq0 p LEFT JOIN rewrites r USING (query_id) LEFT JOIN scores s USING (query_id)),
pq2 AS (SELECT *, {decide_scores_sql('query', 'top_label', 'top_score', 'has_score')} AS raw_route,
               {decide_scores_sql('standalone_query', 'label2', 'score2', 'has2')} AS second_route FROM pq1),
pq3 AS (SELECT *, CASE WHEN raw_route.action = 'block' THEN raw_route ELSE second_route END AS route,
               CASE WHEN raw_route.action = 'block' THEN 'raw' WHEN second_route.action = 'block' THEN 'rephrased' END AS blocked_at
        FROM pq2),
pq AS (SELECT *, CASE WHEN route.action <> 'block' THEN standalone_query END AS safe_query,
              CASE WHEN day_n > {C.DAILY_QUERY_BUDGET} THEN 'dp_budget_exceeded'
                   WHEN route.action = 'block' THEN route.category END AS stage_block
       FROM pq3),
pqa AS (SELECT * FROM pq WHERE stage_block IS NULL)"""


def o_route_two_pass():
    return with_ctes(["queries", "scores", "rewrites"], """
        SELECT query_id, route.action AS action, route.category AS category, coalesce(blocked_at, '') AS blocked_at,
               sha256(safe_query) AS safe_query_sha FROM pq""", extra=_pipeline_route_ctes())


def o_rephrase_prompt():
    head = S.q(C.REPHRASE_HEAD + "History:\n")
    return with_ctes([], f"""
        SELECT conv_id * 100 + turn AS query_id, cast(len(prev) AS BIGINT) AS n_history,
               sha256({head} || array_to_string(prev, chr(10)) || chr(10) || chr(10) || 'Follow-up: ' || text
                      || chr(10) || chr(10) || 'Standalone Question:') AS prompt_sha
        FROM (SELECT *, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
                         ROWS BETWEEN {C.REPHRASE_CONTEXT} PRECEDING AND 1 PRECEDING) AS prev
              FROM conversations)
        WHERE role = 'user' AND len(prev) > 0""")


def o_history_last():
    return with_ctes([], f"""
        SELECT conv_id, turn, from_end <= {C.HISTORY_KEEP} AS kept_10, from_end <= 4 AS kept_4
        FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations)""")


def o_history_prev6():
    return with_ctes([], f"""
        SELECT conv_id, turn, cast(len(prev) AS BIGINT) AS n_prev, sha256(array_to_string(prev, chr(10))) AS prev_sha
        FROM (SELECT *, coalesce(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
                         ROWS BETWEEN {C.REPHRASE_CONTEXT} PRECEDING AND 1 PRECEDING), []::VARCHAR[]) AS prev
              FROM conversations)""")


TOKENS = S.qlist(C.CANARY_TOKENS)


def canary_found_sql(t):
    return f"list_filter({TOKENS}, lambda k: contains({t}, k))"


def canary_redact_sql(t, found):
    return f"list_reduce({found}, lambda acc, k: replace(acc, k, {S.q(C.CANARY_REDACTED)}), {t})"


def o_canary_scan():
    f = canary_found_sql("response")
    return with_ctes(["answers"], f"""
        SELECT query_id, array_to_string({f}, ',') AS tokens, len({f}) > 0 AS leaked,
               sha256({canary_redact_sql('response', f)}) AS redacted_sha FROM answers""")


def sanitize_ctes(src: str, key: str, text: str, p: str) -> str:
    """CTEs ending in {p}_out(key, canaries, safe, pii_count, violations)."""
    f = canary_found_sql(text)
    return f""",
{p}_c AS (SELECT {key}, {f} AS canaries, {canary_redact_sql(text, f)} AS c_text FROM {src} WHERE {text} IS NOT NULL),
{p}_sp AS ({S.pii_span_rows(f'{p}_c', key=key, t='c_text', gazetteer=GAZ)}),
{S.redaction_ctes(f'{p}_sp', f'{p}_c', key=key, t='c_text', prefix=p)},
{p}_cnt AS (SELECT {key}, count(*) AS n FROM {p}_sp GROUP BY {key}),
{p}_out AS (
  SELECT c.{key}, c.canaries, coalesce(r.redacted, c.c_text) AS safe, coalesce(n.n, 0) AS pii_count,
         '[' || concat_ws(', ',
            CASE WHEN len(c.canaries) > 0 THEN '{{"type": "canary_leak", "tokens": [' ||
                 array_to_string(list_transform(c.canaries, lambda k: '"' || k || '"'), ', ') || ']}}' END,
            CASE WHEN coalesce(n.n, 0) > 0 THEN '{{"type": "output_pii", "count": ' || cast(n.n AS VARCHAR) || '}}' END) || ']' AS violations
  FROM {p}_c c LEFT JOIN {p}_red r USING ({key}) LEFT JOIN {p}_cnt n USING ({key}))"""


def o_output_sanitize():
    return with_ctes(["answers"], """
        SELECT query_id, safe AS safe_response, cast(pii_count AS BIGINT) AS pii_count, violations FROM so_out""",
                     extra=sanitize_ctes("answers", "query_id", "response", "so").lstrip(",\n"))


def _pipeline_ctes():
    return (_pipeline_route_ctes() + ",\n" + guarded_ctes("pqa") + f""",
psum AS (SELECT query_id, sum(CASE WHEN used THEN 1 ELSE 0 END) AS chunks_used,
                sum(CASE WHEN counted_blocked THEN 1 ELSE 0 END) AS rbac_blocked FROM grx GROUP BY query_id),
pctx AS (SELECT query_id, string_agg(out_text, {S.q(C.CONTEXT_SEPARATOR)} ORDER BY rank) AS context
         FROM grx WHERE used GROUP BY query_id),
pj AS (
  SELECT p.*, coalesce(s.chunks_used, 0) AS chunks_used0, coalesce(s.rbac_blocked, 0) AS rbac_blocked0, x.context,
         a.response, a.latency_ms,
         CASE WHEN p.stage_block IS NOT NULL THEN 'blocked' WHEN coalesce(s.chunks_used, 0) = 0 THEN 'no_context'
              ELSE 'answered' END AS status
  FROM pq p LEFT JOIN psum s USING (query_id) LEFT JOIN pctx x USING (query_id) LEFT JOIN answers a USING (query_id)),
pj2 AS (SELECT *, CASE WHEN status = 'answered' THEN coalesce(response, {S.q(C.BREAKER_RESPONSE)}) END AS llm_response FROM pj)"""
            + sanitize_ctes("pj2", "query_id", "llm_response", "po") + f""",
pfinal AS (
  SELECT j.query_id, j.user_id, j.tenant_id, j.ts, j.query, j.standalone_query, j.safe_query, j.route, j.blocked_at,
         j.status,
         CASE WHEN j.status = 'blocked' THEN 'Your request was blocked: ' || j.stage_block || '.'
              WHEN j.status = 'no_context' THEN {S.q(C.NO_CONTEXT_RESPONSE)} ELSE o.safe END AS safe_response,
         cast(CASE WHEN j.status = 'answered' THEN j.chunks_used0 ELSE 0 END AS BIGINT) AS chunks_used,
         cast(CASE WHEN j.status = 'answered' THEN j.rbac_blocked0 ELSE 0 END AS BIGINT) AS rbac_blocked,
         cast(CASE WHEN j.status = 'answered' THEN o.pii_count ELSE 0 END AS BIGINT) AS pii_redacted,
         (j.status = 'answered' AND len(o.canaries) > 0) AS canary_leaked,
         CASE WHEN j.status = 'answered' THEN o.canaries ELSE []::VARCHAR[] END AS canary_tokens,
         CASE WHEN j.status = 'answered' THEN o.violations ELSE '[]' END AS violations,
         CASE WHEN j.status = 'answered' THEN {S.grounding_risk('o.safe', 'j.context')} ELSE 'none' END AS hallucination_risk,
         cast(coalesce(j.latency_ms, 0) AS BIGINT) AS latency_ms
  FROM pj2 j LEFT JOIN po_out o USING (query_id))""")


PIPE = ["queries", "chunks", "scores", "rewrites", "answers"]


def o_guarded_answers():
    return with_ctes(PIPE, """
        SELECT query_id, status, safe_response, chunks_used, rbac_blocked, pii_redacted, canary_leaked,
               hallucination_risk, violations FROM pfinal""", extra=_pipeline_ctes())


def o_grounding_risk():
    return with_ctes(PIPE, "SELECT query_id, hallucination_risk FROM pfinal WHERE status = 'answered'",
                     extra=_pipeline_ctes())


def _audit_ctes():
    return _pipeline_ctes() + """,
pa AS (SELECT *, sha256('trace|' || cast(query_id AS VARCHAR)) AS trace_id, coalesce(safe_query, query) AS logged_query
       FROM pfinal)""" + sanitize_ctes("pa", "query_id", "logged_query", "aq") + sanitize_ctes(
        "pa", "query_id", "safe_response", "ar") + """,
audit AS (
  SELECT p.trace_id AS id, p.trace_id, cast(p.user_id AS VARCHAR) AS user_id, p.tenant_id, q.safe AS query, r.safe AS response,
         p.chunks_used, p.rbac_blocked, p.pii_redacted, p.canary_leaked, p.violations, p.latency_ms,
         p.route.action AS route_action, p.route.category AS route_category, p.ts AS "timestamp",
         sha256(p.trace_id || cast(p.user_id AS VARCHAR) || sha256(q.safe) || strftime(p.ts, '%Y-%m-%dT%H:%M:%S')
                || CASE WHEN microsecond(p.ts) % 1000000 <> 0 THEN '.' || lpad(cast(microsecond(p.ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END
                || '+00:00') AS checksum
  FROM pa p JOIN aq_out q USING (query_id) JOIN ar_out r USING (query_id))"""


def o_audit_log():
    return with_ctes(PIPE, """
        SELECT trace_id, user_id, tenant_id, query, response, chunks_used, rbac_blocked, pii_redacted, canary_leaked,
               violations, latency_ms, route_action, coalesce(route_category, '') AS route_category,
               strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", checksum FROM audit""", extra=_audit_ctes())


def o_audit_checksum():
    return with_ctes(PIPE, "SELECT id, checksum, false AS tampered FROM audit", extra=_audit_ctes())


def o_audit_chain(depth: int = 8):
    parts = [f"""m{depth} AS (SELECT tenant_id, cast("timestamp" AS DATE) AS day, substr(checksum, 1, {depth}) AS p,
       sha256(string_agg(checksum, '' ORDER BY checksum)) AS h FROM audit GROUP BY 1, 2, 3)"""]
    for d in range(depth - 1, 0, -1):
        parts.append(f"""m{d} AS (SELECT tenant_id, day, substr(p, 1, {d}) AS p,
       sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM m{d + 1} GROUP BY 1, 2, 3)""")
    parts.append("""m0 AS (SELECT tenant_id, day, sha256(string_agg(p || h, '' ORDER BY p)) AS root FROM m1 GROUP BY 1, 2)""")
    extra = _audit_ctes() + ",\n" + ",\n".join(parts)
    return with_ctes(PIPE, "SELECT tenant_id, strftime(day, '%Y-%m-%d') AS day, root FROM m0", extra=extra)


def o_canary_alerts():
    return with_ctes(PIPE, """
        SELECT sha256('trace|' || cast(query_id AS VARCHAR)) AS trace_id, cast(user_id AS VARCHAR) AS user_id, tenant_id,
               unnest(canary_tokens) AS canary_token, safe_query AS query, strftime(ts, '%Y-%m-%d %H:%M:%S') AS detected_at
        FROM pfinal WHERE canary_leaked""", extra=_pipeline_ctes())


def o_injection_log():
    return with_ctes(PIPE, """
        SELECT sha256('inj|' || cast(query_id AS VARCHAR) || '|' || cast(k AS VARCHAR)) AS id,
               sha256('trace|' || cast(query_id AS VARCHAR)) AS trace_id, cast(user_id AS VARCHAR) AS user_id, tenant_id,
               raw_query, action, category, cast(confidence AS DOUBLE) AS confidence,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS detected_at
        FROM (
          SELECT query_id, 0 AS k, user_id, tenant_id, query AS raw_query, route.action AS action, route.category AS category,
                 route.confidence AS confidence, ts FROM pfinal WHERE blocked_at = 'raw'
          UNION ALL
          SELECT query_id, 1, user_id, tenant_id, standalone_query, route.action, route.category, route.confidence, ts
          FROM pfinal WHERE blocked_at = 'rephrased'
          UNION ALL
          SELECT g.query_id, 100 + g.rank, p.user_id, p.tenant_id, 'Retrieved chunk injection: ' || substr(g.text, 1, 200),
                 'flag', 'indirect_prompt_injection', round(1.0 - g.trust / 10.0, 4), p.ts
          FROM grx g JOIN pfinal p USING (query_id) WHERE g.action IN ('drop', 'wrap'))""", extra=_pipeline_ctes())


ORACLE = {
    "route_fast": o_route_fast,
    "route_scores": o_route_scores,
    "route_guard": o_route_guard,
    "route_failclosed": o_route_failclosed,
    "route_two_pass": o_route_two_pass,
    "rephrase_prompt": o_rephrase_prompt,
    "history_last10": o_history_last,
    "history_prev6": o_history_prev6,
    "canary_scan": o_canary_scan,
    "output_sanitize": o_output_sanitize,
    "guarded_answers": o_guarded_answers,
    "grounding_risk": o_grounding_risk,
    "audit_log": o_audit_log,
    "audit_checksum": o_audit_checksum,
    "audit_chain": o_audit_chain,
    "canary_alerts": o_canary_alerts,
    "injection_log": o_injection_log,
}

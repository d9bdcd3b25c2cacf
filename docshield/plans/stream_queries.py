"""Registered streaming queries (ST1–ST5).  Each runs its stream to
completion (availableNow) over files staged from the given tables and
returns the sink contents; where the result is order-independent the batch
SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from docshield import constants as C
from docshield.operators import breaker
from docshield.plans import analytics_queries as AQ
from docshield.plans import ingest_queries as IQ
from docshield.sources import fixtures as FX
from docshield.sources.files import cut
from docshield.sources.tables import read
from docshield.streaming import jobs as J


def q_stream_ingest(spark, sf):
    out = J.stream_ingest(spark, FX.docs_raw(spark, sf), person_names=FX.PERSON_NAMES)
    il = out["ingest_log"]
    return il.select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), "chunks_stored",
                     "sensitivity_class", F.array_join("pii_entities_found", ",").alias("pii_entities_found"),
                     "text_modified")


def q_stream_budget(spark, sf):
    r = J.stream_budget(spark, read(spark, sf, "events"), AQ.EVENT_BUDGET)
    return r.select("event_id", "day_n", "allowed")


def q_stream_budget_windows(spark, sf):
    r = J.stream_budget_windows(spark, read(spark, sf, "events"), AQ.EVENT_BUDGET)
    return r.select("user_id", "day", F.col("n_requests").cast("bigint").alias("n_requests"),
                    F.col("n_blocked").cast("bigint").alias("n_blocked"))


def q_stream_rate(spark, sf):
    r = J.stream_rate(spark, read(spark, sf, "events"), 1)
    return r.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.col("n").cast("bigint").alias("n"), F.col("n_over").cast("bigint").alias("n_over"))


def q_stream_circuit(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", F.lit("global").alias("scope"),
                                         (F.col("event_type") == "error").alias("failed"))
    r = J.stream_circuit(spark, e)
    return r.select("event_id", "called", "failed", "breaker_open")


#: A window that this log's failures fill: the reference's minute never holds five of them.
EXACT_WINDOW_SEC = 2 * 3600


def _breaker_calls(spark, sf):
    return read(spark, sf, "events").select("event_id", "ts", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("scope"),
                                            (F.col("event_type") == "error").alias("failed"))


def q_circuit_exact(spark, sf):
    r, _ = breaker.replay(_breaker_calls(spark, sf), cut, window_sec=EXACT_WINDOW_SEC)
    return r.select("event_id", "scope", "called", "failed", "breaker_open")


def q_stream_late(spark, sf):
    """Every 50th event reaches the feed ten days late; which rows miss their window."""
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("ts")).alias("arrived"))
    counts, late = J.stream_late(spark, e, "arrived")
    told = lambda name, ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(name)
    return counts.select(F.lit("counted").alias("kind"), "user_id", told("at", "window_start"), F.col("n").cast("bigint").alias("n")) \
        .unionByName(late.groupBy("user_id", F.date_trunc("minute", "ts").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("late").alias("kind"), "user_id", told("at", "w"), F.col("n").cast("bigint").alias("n")))


def q_stream_history(spark, sf):
    r = J.stream_history(spark, read(spark, sf, "conversations"), 4)
    return r.select("conv_id", "turn", "history_size", "oldest_turn")


def q_stream_sessions(spark, sf):
    return J.stream_sessions(spark, FX.auth_sessions(spark, sf), FX.session_requests(spark, sf), FX.users(spark, sf))


QUERIES = {
    "circuit_exact": q_circuit_exact,
    "stream_sessions": q_stream_sessions,
    "stream_ingest": q_stream_ingest,
    "stream_budget": q_stream_budget,
    "stream_budget_windows": q_stream_budget_windows,
    "stream_rate": q_stream_rate,
    "stream_circuit": q_stream_circuit,
    "stream_history": q_stream_history,
    "stream_late": q_stream_late,
}


def o_stream_budget():
    return AQ.o_dp_budget()


def o_stream_budget_windows():
    return AQ.o_dp_budget_daily()


def o_stream_rate():
    return """
        SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
               cast(count(*) AS BIGINT) AS n, cast(greatest(count(*) - 1, 0) AS BIGINT) AS n_over
        FROM events GROUP BY user_id, date_trunc('minute', ts)"""


def _breaker_sql(scope, window_sec):
    """The breaker call by call: a recursion over the failures that could count, then the calls they close."""
    w = window_sec * 1_000_000
    kept = f"list_filter(r.kept, lambda x: f.us - x < {w})"
    return f"""
        WITH RECURSIVE calls AS (SELECT event_id, epoch_us(ts) AS us, {scope} AS scope, event_type = 'error' AS failed FROM events),
        f AS (SELECT scope, us, event_id, row_number() OVER (PARTITION BY scope ORDER BY us, event_id) AS k FROM calls WHERE failed),
        r(scope, k, kept, us, event_id, counts) AS (
          SELECT DISTINCT scope, cast(0 AS BIGINT), cast([] AS BIGINT[]), cast(NULL AS BIGINT), cast(NULL AS BIGINT), false FROM f
          UNION ALL
          SELECT r.scope, f.k, CASE WHEN len({kept}) < {C.BREAKER_FAILURES} THEN list_append({kept}, f.us) ELSE {kept} END,
                 f.us, f.event_id, len({kept}) < {C.BREAKER_FAILURES}
          FROM r JOIN f ON f.scope = r.scope AND f.k = r.k + 1),
        o AS (SELECT c.event_id, c.scope, c.failed, count(a.us) >= {C.BREAKER_FAILURES} AS breaker_open
              FROM calls c LEFT JOIN (SELECT * FROM r WHERE counts) a
                ON a.scope = c.scope AND a.us > c.us - {w} AND (a.us < c.us OR (a.us = c.us AND a.event_id < c.event_id))
              GROUP BY c.event_id, c.scope, c.failed)"""


def o_circuit_exact():
    scope = "CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END"
    return _breaker_sql(scope, EXACT_WINDOW_SEC) + " SELECT event_id, scope, NOT breaker_open AS called, failed AND NOT breaker_open AS failed, breaker_open FROM o"


def o_stream_circuit():
    return _breaker_sql("'global'", C.BREAKER_WINDOW_SEC) + " SELECT event_id, NOT breaker_open AS called, failed AND NOT breaker_open AS failed, breaker_open FROM o"


def o_stream_late():
    # the feed is staged as four parts of equal time by arrival, one for each micro-batch
    return """
        WITH e AS (SELECT user_id, ts, epoch_us(ts) AS us, epoch_us(ts) + CASE WHEN event_id % 50 = 0 THEN 864000000000 ELSE 0 END AS a FROM events),
        b AS (SELECT min(a) AS lo, (max(a) - min(a)) / 4.0 AS span FROM e),
        p AS (SELECT e.*, greatest(cast(ceil((a - lo) / span) AS BIGINT) - 1, 0) AS part FROM e, b),
        m AS (SELECT q.part, max(e.us) - 120000000 AS mark FROM (SELECT DISTINCT part FROM p) q JOIN p e ON e.part < q.part GROUP BY q.part)
        SELECT CASE WHEN p.us - p.us % 60000000 + 60000000 <= m.mark THEN 'late' ELSE 'counted' END AS kind, p.user_id,
               strftime(date_trunc('minute', p.ts), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n
        FROM p LEFT JOIN m USING (part) GROUP BY 1, 2, 3"""


def o_stream_history():
    return """
        SELECT conv_id, turn, cast(least(row_number() OVER w, 4) AS BIGINT) AS history_size,
               cast(min(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS oldest_turn
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def o_stream_sessions():
    from docshield.plans.access_queries import o_active_sessions
    return o_active_sessions()


ORACLE = {
    "stream_sessions": o_stream_sessions,
    "stream_budget": o_stream_budget,
    "stream_budget_windows": o_stream_budget_windows,
    "stream_rate": o_stream_rate,
    "stream_history": o_stream_history,
    "stream_late": o_stream_late,
    "stream_circuit": o_stream_circuit,
    "circuit_exact": o_circuit_exact,
}

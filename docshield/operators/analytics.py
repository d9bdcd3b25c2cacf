"""Security analytics over the log tables (U1, E1–E4, A1–A12, W2, W5, W7,
X4, X5, L1, L2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docshield import constants as C


def _iso_z(ts) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(t) % 1000000
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")),
                    F.lit("Z"))


FEED_COLS = ["id", "ts", "time", "type", "tenant", "user", "status", "risk", "details", "traceOrDocId"]


def _top(df: DataFrame, limit: int) -> DataFrame:
    # sort + limit per branch plans as TakeOrderedAndProject (a per-task
    # top-N then one merge), so only `limit` rows per branch move
    return df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def audit_events(audit: DataFrame) -> DataFrame:
    """risk/status of audit rows."""
    blocked = (F.col("route_action") == "block") | (F.col("rbac_blocked") > 0)
    risk = (F.when(F.col("canary_leaked"), "critical").when(blocked, "high")
            .when(F.col("pii_redacted") > 0, "medium").otherwise("low"))
    details = F.concat(F.lit("Query: "), F.substring("query", 1, 120), F.lit("... | Chunks: "),
                       F.col("chunks_used").cast("string"), F.lit(" (Blocked: "), F.col("rbac_blocked").cast("string"),
                       F.lit(") | PII Redacted: "), F.col("pii_redacted").cast("string"),
                       F.when(F.col("canary_leaked"), F.lit(" [CANARY LEAK DETECTED]")).otherwise(F.lit("")))
    return audit.select(F.col("id"), F.col("timestamp").alias("ts"), _iso_z("timestamp").alias("time"),
                        F.lit("query").alias("type"), F.col("tenant_id").alias("tenant"),
                        F.col("user_id").cast("string").alias("user"),
                        F.when(blocked, "blocked").otherwise("success").alias("status"), risk.alias("risk"),
                        details.alias("details"), F.col("id").alias("traceOrDocId"))


def injection_events(inj: DataFrame) -> DataFrame:
    """Always blocked / high; tenant and user defaults."""
    details = F.concat(F.lit("Blocked prompt injection/jailbreak attempt (Category: "), F.coalesce("category", F.lit("None")),
                       F.lit(", Confidence: "), F.format_string("%.2f", F.col("confidence")), F.lit(") Query: "),
                       F.substring("raw_query", 1, 100), F.lit("..."))
    return inj.select(F.col("id"), F.col("detected_at").alias("ts"), _iso_z("detected_at").alias("time"),
                      F.lit("query").alias("type"), F.coalesce("tenant_id", F.lit("default")).alias("tenant"),
                      F.coalesce(F.col("user_id").cast("string"), F.lit("unknown")).alias("user"),
                      F.lit("blocked").alias("status"), F.lit("high").alias("risk"), details.alias("details"),
                      F.col("id").alias("traceOrDocId"))


def ingestion_events(ing: DataFrame) -> DataFrame:
    """Quarantined → critical/blocked, skipped → medium/warning, modified → medium."""
    risk = (F.when(F.col("status") == "quarantined", "critical").when(F.col("status") == "skipped", "medium")
            .when(F.col("text_modified"), "medium").otherwise("low"))
    status = (F.when(F.col("status") == "quarantined", "blocked").when(F.col("status") == "skipped", "warning")
              .otherwise("success"))
    details = F.concat(F.lit("Source: "), F.col("source"), F.lit(" | Chunks: "), F.col("chunks_stored").cast("string"),
                       F.lit(" | Sensitivity: "), F.col("sensitivity_class"), F.lit(" | Status: "), F.col("status"),
                       F.when(F.col("reason").isNotNull() & (F.col("reason") != ""),
                              F.concat(F.lit(" (Reason: "), F.col("reason"), F.lit(")"))).otherwise(F.lit("")))
    return ing.select(F.col("id"), F.col("ingested_at").alias("ts"), _iso_z("ingested_at").alias("time"),
                      F.when(F.col("source") == "manual_input", "text_ingest").otherwise("file_ingest").alias("type"),
                      F.col("tenant_id").alias("tenant"), F.lit("system").alias("user"), status.alias("status"),
                      risk.alias("risk"), details.alias("details"), F.col("doc_id").alias("traceOrDocId"))


def events_feed(audit: DataFrame, inj: DataFrame, ing: DataFrame, limit: int = C.EVENTS_FEED_DEFAULT,
                tenant_id: str | None = None) -> DataFrame:
    """U1 + L1: newest-first union, each branch pre-limited (sorted by time,
    ties by id; an optional tenant filter is pushed into every branch)."""
    if not 1 <= limit <= C.EVENTS_FEED_MAX:
        raise ValueError(f"limit must be in 1..{C.EVENTS_FEED_MAX}")
    parts = [audit_events(audit), injection_events(inj), ingestion_events(ing)]
    if tenant_id is not None:
        parts = [p.where(F.col("tenant") == tenant_id) for p in parts]
    u = _top(parts[0], limit).unionByName(_top(parts[1], limit)).unionByName(_top(parts[2], limit))
    return _top(u, limit)


def events_search(feed: DataFrame, type_: str | None = None, risk: str | None = None, text: str | None = None):
    """Type ∧ risk ∧ case-insensitive substring over user/tenant/trace/details."""
    d = feed
    if type_:
        d = d.where(F.col("type") == type_)
    if risk:
        d = d.where(F.col("risk") == risk)
    if text:
        t = text.lower()
        d = d.where(F.contains(F.lower("user"), F.lit(t)) | F.contains(F.lower("tenant"), F.lit(t))
                    | F.contains(F.lower("traceOrDocId"), F.lit(t)) | F.contains(F.lower("details"), F.lit(t)))
    return d


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null: rows without a key are one group, not lost."""
    right = right.withColumnsRenamed({k: f"_j{n}" for n, k in enumerate(keys)})
    on = [left[k].eqNullSafe(right[f"_j{n}"]) for n, k in enumerate(keys)]
    return left.join(right, on).drop(*(f"_j{n}" for n in range(len(keys))))


def daily_budget(events: DataFrame, max_per_day: int = C.DAILY_QUERY_BUDGET, key: str = "user_id",
                 order=("ts", "event_id"), bucket: str = "minute") -> DataFrame:
    """Request number within the (key, UTC day) and the budget decision.

    The rank is computed in two phases so a hot key-day is not ranked in
    one task: counts per (key, day, minute) get a running sum over the (at
    most 1440) minutes of the day, and each row adds its row number inside
    its own minute.  Equal to ``row_number`` over (key, day) ordered by
    ``order`` whose first column is the timestamp.
    """
    d = events.withColumn("_day", F.to_date("ts")).withColumn("_m", F.date_trunc(bucket, "ts"))
    counts = d.groupBy(key, "_day", "_m").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(key, "_day").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    wr = Window.partitionBy(key, "_day", "_m").orderBy(*order)
    ranked = _join_null_safe(d.withColumn("_r", F.row_number().over(wr)), counts.drop("_n"), [key, "_day", "_m"])
    return ranked.withColumn("day_n", (F.col("_before") + F.col("_r")).cast("int")) \
        .withColumn("allowed", F.col("day_n") <= max_per_day).drop("_day", "_m", "_r", "_before")


def budget_daily_counts(events: DataFrame, max_per_day: int = C.DAILY_QUERY_BUDGET, key: str = "user_id"):
    """A4: per (key, day) request count and how many were over budget."""
    g = events.groupBy(key, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_requests"))
    return g.withColumn("n_blocked", F.greatest(F.col("n_requests") - max_per_day, F.lit(0)))


def rate_limit_key(user_id: Column, session_token: Column, client_ip: Column) -> Column:
    """The identity that a limit counts: the authenticated user, else the hash of the session's token, else the client's address.

    An empty token is no session; without any of the three all requests share one key."""
    token = F.when(session_token != "", F.concat(F.lit("session:"), F.sha2(session_token, 256)))
    return F.coalesce(F.concat(F.lit("user:"), user_id.cast("string")), token, F.concat(F.lit("ip:"), F.coalesce(client_ip, F.lit("None"))))


def endpoint_limit(events: DataFrame, endpoint: str, key: Column, order=("ts", "event_id")) -> DataFrame:
    """W7 at an endpoint's own limit and window (query, ingest or auth)."""
    n, seconds = C.RATE_LIMITS[endpoint]
    return rate_limit(events, n, f"{seconds} seconds", key, order)


def rate_limit(events: DataFrame, limit: int, window: str, key: Column, order=("ts", "event_id"),
               bucket: str = "second") -> DataFrame:
    """Fixed-window limiter; requests beyond ``limit`` in a window are over.

    The position inside a (key, window) is ranked in two phases, as in
    ``daily_budget``: running counts of per-second buckets plus the row
    number inside the bucket, so a flooding key is spread over many tasks.
    """
    d = events.withColumn("rl_key", key).withColumn("rl_window", F.window("ts", window).start) \
        .withColumn("_s", F.date_trunc(bucket, "ts"))
    counts = d.groupBy("rl_key", "rl_window", "_s").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("rl_key", "rl_window").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    wr = Window.partitionBy("rl_key", "rl_window", "_s").orderBy(*order)
    r = _join_null_safe(d.withColumn("_r", F.row_number().over(wr)), counts, ["rl_key", "rl_window", "_s"])
    return r.withColumn("rl_n", F.col("_before") + F.col("_r")).withColumn("over_limit", F.col("rl_n") > limit) \
        .drop("_s", "_r", "_before")


def circuit_state(calls: DataFrame, failed: Column, scope: Column | None = None,
                  threshold: int = C.BREAKER_FAILURES, window_sec: int = C.BREAKER_WINDOW_SEC) -> DataFrame:
    """Breaker open at a call when >= threshold failures happened in the
    trailing window (strictly less than ``window_sec`` before it).

    Windows are partitioned by (scope, bucket) with buckets one window long;
    each bucket's failures are also copied into the next bucket, so every
    trailing window lies inside one partition and a busy scope is spread
    over many small partitions instead of one per day.
    """
    sc = scope if scope is not None else F.lit("global")
    w_us = window_sec * 1000000
    d = calls.withColumn("_scope", sc).withColumn("_fail", F.when(failed, 1).otherwise(0)) \
        .withColumn("_us", F.unix_micros("ts")).withColumn("_b", F.floor(F.col("_us") / w_us))
    carry = (d.where(F.col("_fail") == 1)
             .select("_scope", "_us", (F.col("_b") + 1).alias("_b"), F.lit(1).alias("_fail"), F.lit(True).alias("_carry")))
    base = d.select("*", F.lit(False).alias("_carry"))
    u = base.unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy("_scope", "_b").orderBy("_us").rangeBetween(-(w_us - 1), -1)
    u = u.withColumn("recent_failures", F.sum("_fail").over(w))
    out = u.where(~F.col("_carry")).withColumn("recent_failures", F.coalesce("recent_failures", F.lit(0)))
    return out.withColumn("breaker_open", F.col("recent_failures") >= threshold) \
        .drop("_fail", "_us", "_b", "_carry", "_scope")


def retention(df: DataFrame, ts_col: str, as_of: str, days: int = C.RETENTION_DAYS) -> DataFrame:
    """Rows still inside the retention window as of ``as_of``."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    return df.withColumn("retained", F.col(ts_col) >= cutoff)


def reingest_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document whose raw-text hash was seen more than once,
    with the copy count and the first (smallest) doc id of its hash.

    Both come from a partial (map-side) aggregate joined back by hash, so a
    hash copied millions of times is never collected or ranked in one task.
    """
    h = docs.select("doc_id", F.sha2("text", 256).alias("document_hash"))
    counts = h.groupBy("document_hash").agg(F.count(F.lit(1)).alias("n_copies"),
                                            F.min("doc_id").alias("first_doc_id")).where(F.col("n_copies") > 1)
    return h.join(counts, "document_hash")


LATENCY_BUCKETS_SEC = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def latency_histogram(df: DataFrame, latency_ms: str = "latency_ms", by=()) -> DataFrame:
    """Cumulative bucket counts (le), count, sum, exact p95.

    ``percentile`` keeps a count per distinct value, and latency in whole
    milliseconds has few distinct values, so its state stays bounded."""
    aggs = [F.count_if(F.col(latency_ms) <= b * 1000).alias(f"le_{str(b).replace('.', '_')}") for b in LATENCY_BUCKETS_SEC]
    aggs += [F.count(F.lit(1)).alias("count"), F.sum(latency_ms).alias("sum_ms"),
             F.percentile(F.col(latency_ms), 0.95).alias("p95_ms")]
    return df.groupBy(*by).agg(*aggs)

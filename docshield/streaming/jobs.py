"""Structured Streaming counterparts of the batch operators (ST1–ST6).

All jobs read a file source, keep state in the checkpoint under the shared
folder named by ``spark.checkpoint.dir`` and stop with
``trigger(availableNow=True)``, so a restarted or retried job resumes from
its checkpoint.  Late rows are handled with watermarks (aggregates drop
them) or sent to a side output by the stateful operators.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docshield import constants as C
from docshield.operators import breaker
from docshield.operators import chunking as CH
from docshield.operators import ingest as I
from docshield.sources.files import cut, scratch_path


def stage_in_order(df: DataFrame, path: str, order_col: str, n_files: int = 4) -> None:
    """Write ``df`` as ``n_files`` parquet files in ``order_col`` order, one
    write per range, so the file source's arrival order follows event time."""
    b = df.select(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    if b["lo"] is None:
        df.limit(0).write.mode("overwrite").parquet(f"{path}/part_0")
        return
    lo, hi = b["lo"], b["hi"]
    span = (hi - lo) / n_files
    for i in range(n_files):
        a = lo + span * i
        cond = (F.col(order_col) >= a) if i == 0 else (F.col(order_col) > a)
        if i < n_files - 1:
            cond = cond & (F.col(order_col) <= lo + span * (i + 1))
        # one file, but its rows are made by all tasks
        df.where(cond).repartition(1).write.mode("overwrite").parquet(f"{path}/part_{i}")


def _stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(path))


def _run_update(agg: DataFrame, out: str, keys) -> DataFrame:
    """Run a windowed aggregate in update mode; each micro-batch writes its
    changed rows to its own folder and the latest version per key wins.

    Append mode would hold back the windows still open when an
    availableNow run ends; update mode emits them, and the per-key latest
    row is the final count.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    d = agg.sparkSession.read.parquet(f"{out}/data")
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_batch", "batch")


# ---------------------------------------------------------------------------
# ST1 streaming ingest
# ---------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, docs: DataFrame, *, chunker: str = "recursive", **scan_kw):
    """Documents arriving as files → the same scan as batch → log, quarantine
    log and chunk table written per micro-batch.  Each batch overwrites its
    own ``batch=<id>`` folder, so a replayed batch cannot duplicate rows."""
    src = scratch_path(spark, "ingest-src")
    out = scratch_path(spark, "ingest-out")
    stage_in_order(docs.withColumn("_seq", F.unix_micros("ingested_at")), src, "_seq")
    stream = _stream(spark, src, docs.schema.add("_seq", "long")).drop("_seq")

    def sink(batch: DataFrame, batch_id: int) -> None:
        scanned = I.scan_documents(batch, **scan_kw).persist()
        counts = CH.chunk_count(chunker)
        I.ingest_log(scanned, counts).write.mode("overwrite").parquet(f"{out}/ingest_log/batch={batch_id}")
        I.quarantine_log(scanned).write.mode("overwrite").parquet(f"{out}/quarantine_log/batch={batch_id}")
        CH.chunk_table(scanned, chunker).write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        scanned.unpersist()

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("ingest_log", "quarantine_log", "chunks")}


# ---------------------------------------------------------------------------
# ST2 streaming daily budget (stateful)
# ---------------------------------------------------------------------------

BUDGET_OUT = "event_id long, user_id long, day string, day_n long, allowed boolean, late boolean"


def _budget_fn(max_per_day: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        day, count = (state.get if state.exists else ("", 0))
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            d = r.ts.strftime("%Y-%m-%d")
            if d < day:                      # a previous day is closed: late row
                out.append((r.event_id, key[0], d, None, None, True))
                continue
            if d != day:
                day, count = d, 0
            count += 1
            out.append((r.event_id, key[0], d, count, count <= max_per_day, False))
        state.update((day, count))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "day", "day_n", "allowed", "late"])
    return fn


def stream_budget(spark: SparkSession, events: DataFrame, max_per_day: int = C.DAILY_QUERY_BUDGET) -> DataFrame:
    """Per-user daily counter in keyed state (one value per user: the
    current day and its count), rolled over at the UTC day boundary."""
    src = scratch_path(spark, "budget-src")
    out = scratch_path(spark, "budget-out")
    ev = events.select("event_id", "user_id", "ts")
    stage_in_order(ev, src, "ts")
    s = _stream(spark, src, ev.schema)
    res = s.groupBy("user_id").applyInPandasWithState(
        _budget_fn(max_per_day), BUDGET_OUT, "day string, count long", "append", GroupStateTimeout.NoTimeout)
    q = (res.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(BUDGET_OUT).parquet(f"{out}/data")


def stream_budget_windows(spark: SparkSession, events: DataFrame, max_per_day: int = C.DAILY_QUERY_BUDGET,
                          watermark: str = "1 hour") -> DataFrame:
    """Aggregate-only variant: 1-day tumbling windows with a watermark."""
    src = scratch_path(spark, "budgetw-src")
    out = scratch_path(spark, "budgetw-out")
    ev = events.select("event_id", "user_id", "ts")
    stage_in_order(ev, src, "ts")
    s = _stream(spark, src, ev.schema).withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n_requests"))
    agg = agg.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "user_id", "n_requests",
                     F.greatest(F.col("n_requests") - max_per_day, F.lit(0)).alias("n_blocked"))
    return _run_update(agg, out, ["day", "user_id"])


# ---------------------------------------------------------------------------
# ST3 streaming rate limit
# ---------------------------------------------------------------------------

def stream_rate(spark: SparkSession, events: DataFrame, limit: int, window: str = "1 minute",
                watermark: str = "2 minutes") -> DataFrame:
    """Tumbling-window request counts per key; windows over the limit."""
    src = scratch_path(spark, "rate-src")
    out = scratch_path(spark, "rate-out")
    ev = events.select("event_id", "user_id", "ts")
    stage_in_order(ev, src, "ts")
    s = _stream(spark, src, ev.schema).withWatermark("ts", watermark)
    agg = s.groupBy(F.window("ts", window), "user_id").agg(F.count(F.lit(1)).alias("n"))
    agg = agg.select(F.col("window.start").alias("window_start"), "user_id", "n",
                     F.greatest(F.col("n") - limit, F.lit(0)).alias("n_over"))
    return _run_update(agg, out, ["window_start", "user_id"])


# ---------------------------------------------------------------------------
# ST6 late rows
# ---------------------------------------------------------------------------

def stream_late(spark: SparkSession, events: DataFrame, arrival: str, window_sec: int = 60, delay_sec: int = 120,
                key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """ST6: (window_start, key, n) of the rows that came in time, and a side table of the rows that came late.

    ``events`` (event_id, key, ts, and the column ``arrival`` that orders the feed) are read
    in order of arrival.  The watermark before a micro-batch is the greatest ts of all batches before
    it, less the delay; a row whose window has ended by then is late.  Both outputs of a
    batch follow from the rows and the watermark that the batch before wrote, so a repeated batch
    overwrites them with the same rows.  A row without a ts belongs to no window and is late; it
    does not move the watermark."""
    src, out = scratch_path(spark, "late-src"), scratch_path(spark, "late-out")
    ev = events.select("event_id", key, "ts", F.col(arrival).alias("_arrival"))
    stage_in_order(ev, src, "_arrival")
    s = _stream(spark, src, ev.schema)
    us, size = F.unix_micros("ts"), window_sec * 1_000_000

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(f"{out}/seen/batch={batch_id - 1}").first()["seen"] if batch_id else None  # one row
        mark = F.lit(None if before is None else before - delay_sec * 1_000_000).cast("long")
        start = us - F.pmod(us, F.lit(size))
        rows = batch.withColumn("window_start", F.timestamp_micros(start)).withColumn("late", us.isNull() | F.coalesce(start + size <= mark, F.lit(False)))
        rows.where("late").select("event_id", key, "ts", F.timestamp_micros(mark).alias("watermark")).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        rows.where("NOT late").groupBy("window_start", key).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        batch.agg(F.greatest(F.max(us), F.lit(before).cast("long")).alias("seen")).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    kind = dict(ev.dtypes)[key]
    counts = spark.read.schema(f"window_start timestamp, {key} {kind}, n long, batch int").parquet(f"{out}/counts")
    late = spark.read.schema(f"event_id long, {key} {kind}, ts timestamp, watermark timestamp, batch int").parquet(f"{out}/late")
    return counts.groupBy("window_start", key).agg(F.sum("n").alias("n")), late.drop("batch")


# ---------------------------------------------------------------------------
# ST4 streaming circuit breaker (exact replay)
# ---------------------------------------------------------------------------

BREAKER_OUT = "event_id long, scope string, called boolean, failed boolean, breaker_open boolean"


def stream_circuit(spark: SparkSession, calls: DataFrame, threshold: int = C.BREAKER_FAILURES,
                   window_sec: int = C.BREAKER_WINDOW_SEC) -> DataFrame:
    """ST4: a call made while the breaker is open is not attempted and so cannot fail.

    Each micro-batch is replayed by ``operators.breaker`` from what the batch before
    remembers: at most ``threshold`` failures for each scope, written beside its result.
    A repeated batch overwrites both with the same rows."""
    src = scratch_path(spark, "breaker-src")
    out = scratch_path(spark, "breaker-out")
    c = calls.select("event_id", "scope", "ts", "failed")
    stage_in_order(c, src, "ts")
    s = _stream(spark, src, c.schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        entry = batch.sparkSession.read.parquet(f"{out}/state/batch={batch_id - 1}") if batch_id else None
        result, ended = breaker.replay(batch, cut, entry, threshold, window_sec)
        result.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
        ended.withColumnRenamed("exit", "entry").write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")

    q = (s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(BREAKER_OUT + ", batch int").parquet(f"{out}/data").drop("batch")


# ---------------------------------------------------------------------------
# ST5 conversation memory
# ---------------------------------------------------------------------------

HISTORY_OUT = "conv_id long, turn long, history_size long, oldest_turn long"


def _history_fn(keep: int):
    def fn(key, pdfs, state: GroupState):
        turns = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values("turn")
        out = []
        for r in rows.itertuples(index=False):
            turns.append(int(r.turn))
            turns = turns[-keep:]
            out.append((key[0], int(r.turn), len(turns), turns[0]))
        state.update((turns,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history_size", "oldest_turn"])
    return fn


def stream_history(spark: SparkSession, messages: DataFrame, keep: int = C.HISTORY_KEEP) -> DataFrame:
    """ST5: the last ``keep`` messages per conversation in keyed list state."""
    src = scratch_path(spark, "history-src")
    out = scratch_path(spark, "history-out")
    m = messages.select("conv_id", "turn")
    stage_in_order(m, src, "turn")
    s = _stream(spark, src, m.schema)
    res = s.groupBy("conv_id").applyInPandasWithState(
        _history_fn(keep), HISTORY_OUT, "turns array<long>", "append", GroupStateTimeout.NoTimeout)
    q = (res.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(HISTORY_OUT).parquet(f"{out}/data")


# ---------------------------------------------------------------------------
# ST7 session expiry (fixed TTL from issue, not a gap-based session window)
# ---------------------------------------------------------------------------

SESSION_OUT = "request_id long, token_hash string, user_id long, status string"
SESSION_STATE = "token_hash string, user long, expires long, revoked long"


def session_batch(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of a micro-batch and of the state before it, each with the token's user, expiry and revocation as of it.

    One running window over a token's rows in the order ts, kind, request_id, the state first; ``last_row`` marks the
    row whose values are the token's state after the batch.  No Python group for each token."""
    own = F.col("kind")
    rows = batch.withColumns({"at": F.unix_micros("ts"), "held": F.when(own == 0, F.struct(F.col("user_id").alias("user"), F.col("expires_us").alias("expires"))),
                              "out": F.when(own == 1, F.unix_micros("ts"))}).select("token_hash", "kind", "at", "request_id", "held", "out")
    before = state.select("token_hash", F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("request_id"),
                          F.struct("user", "expires").alias("held"), F.col("revoked").alias("out"))
    order = Window.partitionBy("token_hash").orderBy(F.col("kind") >= 0, "at", "kind", F.col("request_id").asc_nulls_last(), "held")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(before).select("token_hash", "kind", "at", "request_id", F.last("held", ignorenulls=True).over(upto).alias("held"),
                                           F.last("out", ignorenulls=True).over(upto).alias("revoked"), F.lead(F.lit(1)).over(order).isNull().alias("last_row"))


def stream_sessions(spark: SparkSession, sessions: DataFrame, requests: DataFrame, users: DataFrame,
                    grace_sec: int = 86400, watermark: str = "1 hour") -> DataFrame:
    """ST7: token state (user, expiry, revocation) keyed by token hash;
    requests are answered as of their own time, and a token's state is
    dropped ``grace_sec`` after it expires, by the watermark (the greatest ts of
    the batches before, less the delay; rows not after it are dropped).  Each micro-batch
    runs on the state that the batch before wrote; a repeated batch overwrites its folders."""
    src = scratch_path(spark, "sessions-src")
    out = scratch_path(spark, "sessions-out")
    issue = sessions.select("token_hash", F.col("created_at").alias("ts"), F.lit(0).alias("kind"), "user_id",
                            F.unix_micros("expires_at").alias("expires_us"), F.lit(None).cast("long").alias("request_id"))
    revoke = sessions.where(F.col("revoked_at").isNotNull()).select(
        "token_hash", F.col("revoked_at").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("user_id"),
        F.lit(None).cast("long").alias("expires_us"), F.lit(None).cast("long").alias("request_id"))
    req = requests.select("token_hash", F.col("at").alias("ts"), F.lit(2).alias("kind"),
                          F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("expires_us"),
                          "request_id")
    ev = issue.unionByName(revoke).unionByName(req)
    stage_in_order(ev, src, "ts")
    s = _stream(spark, src, ev.schema)
    grace, delay = grace_sec * 1_000_000, F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval '{watermark}'"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession
        seen = run.read.parquet(f"{out}/seen/batch={batch_id - 1}").first()["seen"] if batch_id else None  # one row
        mark = F.lit(seen).cast("long") - delay
        state = run.read.schema(SESSION_STATE).parquet(f"{out}/state/batch={batch_id - 1}") if batch_id else run.createDataFrame([], SESSION_STATE)
        at = F.unix_micros("ts")
        rows = cut(session_batch(batch.where(~F.coalesce(at <= mark, F.lit(False))), state))
        expires = F.col("held.expires")
        status = (F.when(F.col("held.user").isNull() | expires.isNull() | (F.col("revoked") <= F.col("at")), "invalid")
                  .when(expires <= F.col("at"), "expired").otherwise("valid"))
        rows.where("kind = 2").select("request_id", "token_hash", F.when(status == "valid", F.col("held.user")).alias("user_id"), status.alias("status")) \
            .write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
        # a token's state goes once the watermark is past its expiry and grace, unless this batch had rows of it
        kept = F.col("last_row") & F.col("held.user").isNotNull() & ((F.col("kind") >= 0) | expires.isNull() | ~F.coalesce(expires + grace <= mark, F.lit(False)))
        rows.where(kept).select("token_hash", "held.user", "held.expires", "revoked").write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
        batch.agg(F.greatest(F.max(at), F.lit(seen).cast("long")).alias("seen")).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    q = (s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.schema(SESSION_OUT + ", batch int").parquet(f"{out}/data").drop("batch")
    u = users.select("user_id", "username", "role", "tenant_id")
    j = r.join(u, "user_id", "left")
    status = F.when((F.col("status") == "valid") & F.col("username").isNull(), "invalid").otherwise(F.col("status"))
    ok = status == "valid"
    return j.select("request_id", status.alias("status"), F.when(ok, F.col("user_id")).alias("user_id"),
                    F.when(ok, F.col("role")).alias("role"), F.when(ok, F.col("tenant_id")).alias("tenant_id"))

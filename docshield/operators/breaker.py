"""Exact replay of the circuit breaker (ST4): a call made while it is open is not attempted and so cannot fail.

The breaker is open at a call when ``threshold`` attempted calls failed less than ``window``
before it.  What the breaker remembers is therefore at most ``threshold`` failures, and
nothing at all after a quiet gap: a time of ``window`` without any failure that could count.

Failures are sorted by range of (scope, time), so a scope with very many of them lies over many
tasks.  A task's rows of one scope are a run.  Every stretch that follows a quiet gap
inside the run is replayed at once.  What stands before the run's first gap depends on the run
before: runs are replayed in rounds, each round all runs whose entry is known, which they
are as soon as the run before has ended or holds a gap.  A round beyond the first is needed only
while one outage without a quiet gap goes on through whole tasks.  A replay streams its rows and
keeps ``threshold`` times.  Nothing of a scope is grouped in one task.

The accepted failures give the intervals in which the breaker is open; calls meet them by
scope and time bucket.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield import constants as C

ENTRY = "array<struct<us:bigint,event_id:bigint>>"


def _runs(window_us: int):
    """Adds the run's number and whether a quiet gap (or the run's start) stands before the row, for ordered rows of a task."""
    def fn(batches):
        task, nth, scope, last, began = TaskContext.get().partitionId(), -1, None, None, False
        for b in batches:
            runs, fresh = [], []
            for own, us in zip(b.column("scope").to_pylist(), b.column("us").to_pylist(), strict=True):
                if not began or own != scope:
                    nth, scope, last, began = nth + 1, own, None, True
                runs.append((task << 33) + nth)
                fresh.append(last is not None and us - last >= window_us)
                last = us
            yield b.append_column("run", pa.array(runs, pa.int64())).append_column("fresh", pa.array(fresh, pa.bool_()))
    return fn


def _replay(threshold: int, window_us: int):
    """Accepted failures of runs whose entry is known: rows come in order, a run's entry with its first row.

    Also gives each run's exit: the failures that the breaker remembers at its end."""
    def fn(batches):
        run, scope, kept = None, None, []

        def ends(out):
            out.append((scope, None, None, run, [{"us": u, "event_id": i} for u, i in kept]))

        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["run"] != run:
                    if run is not None:
                        ends(out)
                    run, scope, kept = r["run"], r["scope"], [(x["us"], x["event_id"]) for x in r["entry"]]
                kept = [x for x in kept if r["us"] - x[0] < window_us]
                if len(kept) < threshold:
                    kept.append((r["us"], r["event_id"]))
                    out.append((scope, r["us"], r["event_id"], run, None))
            yield _batch(out)
        if run is not None:
            out = []
            ends(out)
            yield _batch(out)

    def _batch(out):
        kind = pa.list_(pa.struct([("us", pa.int64()), ("event_id", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), kind))],
                                          ["scope", "us", "event_id", "run", "exit"])
    return fn


def accepted_failures(calls: DataFrame, entry: DataFrame | None, cut, threshold: int = C.BREAKER_FAILURES, window_sec: int = C.BREAKER_WINDOW_SEC) -> tuple[DataFrame, DataFrame]:
    """(scope, us, event_id) of the attempted calls that failed, and (scope, exit): what each scope's breaker remembers at the end.

    ``calls`` has scope, us, event_id, failed; ``entry`` (scope, entry) is what is remembered at the start, ordered by time;
    ``cut`` writes a DataFrame to shared storage and reads it again."""
    spark, window_us = calls.sparkSession, window_sec * 1_000_000
    order = ["scope", "us", "event_id"]
    rows = calls.where("failed").select(*order)
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs(window_us), "scope string, us long, event_id long, run long, fresh boolean"))
    # the stretches of a run: 0 depends on what was before the run, the others begin after a quiet gap
    each = cut(rows.groupBy("scope", "run").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("fresh").alias("gap"), F.min(F.when(F.col("fresh"), F.col("us"))).alias("free")))
    rows = rows.join(each.select("run", "free"), "run")
    before = F.lag("run").over(Window.partitionBy("scope").orderBy("run"))  # a row for each task and scope
    end_before = F.lag("last").over(Window.partitionBy("scope").orderBy("run"))
    known = entry if entry is not None else spark.createDataFrame([], f"scope string, entry {ENTRY}")
    none = F.array().cast(ENTRY)
    each = cut(each.withColumn("before", before).withColumn("quiet", F.coalesce(F.col("first") - end_before >= window_us, F.lit(False)))
               .join(known, "scope", "left").withColumn("entry", F.when(F.col("quiet"), none).when(F.col("before").isNull(), F.coalesce("entry", none))))
    schema = f"scope string, us long, event_id long, run long, exit {ENTRY}"

    def replayed(which: DataFrame) -> DataFrame:
        """Replays rows of ``which`` (run, us, event_id, scope, entry), each run's in order."""
        return cut(which.repartition("run").sortWithinPartitions("run", "us", "event_id").mapInArrow(_replay(threshold, window_us), schema))

    # after the first gap nothing of what was before counts
    free = replayed(rows.where("us >= free").select("scope", "us", "event_id", "run", none.alias("entry")))
    done = free.where("us IS NOT NULL").select(*order)
    exits = free.where("us IS NULL").select("scope", "run", "exit")
    todo, entries = each, each.where("entry IS NOT NULL").select("run", "entry")
    while True:
        # heads whose entry is known; a run without a gap hands its exit on
        head = rows.where("free IS NULL OR us < free").join(entries, "run").select("scope", "us", "event_id", "run", "entry")
        now = replayed(head)
        done = done.unionByName(now.where("us IS NOT NULL").select(*order))
        whole = now.where("us IS NULL").join(each.where("NOT gap").select("run"), "run", "left_semi").select("scope", "run", "exit")
        exits = exits.unionByName(whole)
        todo = cut(todo.join(entries.select("run"), "run", "left_anti"))
        if todo.isEmpty():
            break
        ready = exits.select(F.col("run").alias("before"), F.col("exit").alias("known"))
        entries = cut(todo.drop("entry").join(ready, "before").select("run", F.col("known").alias("entry")))
    last = each.groupBy("scope").agg(F.max("run").alias("run"))
    ended = last.join(exits.drop("scope"), "run").select("scope", "exit")
    if entry is not None:  # a scope without failures in this log keeps what it had
        ended = ended.unionByName(known.join(last, "scope", "left_anti").select("scope", F.col("entry").alias("exit")))
    return done, ended


def replay(calls: DataFrame, cut, entry: DataFrame | None = None, threshold: int = C.BREAKER_FAILURES,
           window_sec: int = C.BREAKER_WINDOW_SEC) -> tuple[DataFrame, DataFrame]:
    """event_id, scope, called, failed, breaker_open of every call, and what each scope remembers at the end.

    ``calls`` has event_id, scope, ts, failed.  Calls are ordered by (ts, event_id); a null ``failed`` is no failure; rows without
    a ts or event_id can't be ordered: they are called, and their failures count for nobody; a null scope is a scope."""
    window_us = window_sec * 1_000_000
    held = cut(calls.select(F.col("event_id").cast("long").alias("event_id"), "scope", F.unix_micros("ts").alias("us"), F.coalesce("failed", F.lit(False)).alias("failed")))
    named = F.coalesce(F.concat(F.lit("="), "scope"), F.lit(""))
    timed = held.where("us IS NOT NULL AND event_id IS NOT NULL").select("event_id", named.alias("scope"), "us", "failed")
    done, ended = accepted_failures(timed, entry, cut, threshold, window_sec)
    remembered = [done] + ([entry.select("scope", F.inline("entry")).select("scope", "us", "event_id")] if entry is not None else [])
    fails = remembered[0] if len(remembered) == 1 else remembered[0].unionByName(remembered[1])
    # open from behind the last of `threshold` failures until the first of them is `window` old.  Failures of
    # a time bucket are copied to the next, so that those less than a window apart meet
    bucket = F.floor(F.col("us") / window_us)
    near = fails.withColumn("b", F.explode(F.array(bucket, bucket + 1))).withColumn("own", F.col("b") == bucket)
    w = Window.partitionBy("scope", "b").orderBy("us", "event_id")  # at most `threshold` accepted failures lie in any window
    opened = near.withColumn("oldest", F.lag("us", threshold - 1).over(w)).where(F.col("own") & (F.col("us") - F.col("oldest") < window_us))
    until = F.col("oldest") + window_us
    opened = opened.select("scope", F.explode(F.array_distinct(F.array(bucket, F.floor((until - 1) / window_us)))).alias("b"), F.col("us").alias("open_us"), F.col("event_id").alias("open_id"), until.alias("until"))
    at = held.withColumn("_scope", named).withColumn("b", bucket)
    inside = ((F.col("us") > F.col("open_us")) | ((F.col("us") == F.col("open_us")) & (F.col("event_id") > F.col("open_id")))) & (F.col("us") < F.col("until"))
    join = at.join(opened.withColumnsRenamed({"scope": "_open_scope", "b": "_open_b"}), (F.col("_scope") == F.col("_open_scope")) & (F.col("b") == F.col("_open_b")) & inside, "left")
    is_open = F.col("open_us").isNotNull()
    return join.select("event_id", "scope", (~is_open).alias("called"), (F.col("failed") & ~is_open).alias("failed"), is_open.alias("breaker_open")), ended

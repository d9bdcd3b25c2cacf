"""End-to-end: entry contract, chunker properties, batch = stream, search tie rules."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_entry_and_catalog(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert all(isinstance(v, str) and v.strip() for v in orc.values())


def test_recursive_chunker_properties():
    from docshield.operators.chunking import split_text
    text = ("Paragraph one. " * 60 + "\n\n" + "Line two words " * 80 + "\n" + "x" * 1300)
    chunks = split_text(text, 512, 64)
    assert all(0 < len(c) <= 512 for c in chunks)
    assert "".join(c.replace(" ", "") for c in chunks).count("x") >= 1300
    assert split_text("   \n\n  ", 512, 64) == []


def test_fixed_vs_udtf(spark):
    from docshield.operators.chunking import register_chunk_udtf, split_text
    register_chunk_udtf(spark)
    spark.createDataFrame([("d", "word " * 400)], "doc_id string, text string").createOrReplaceTempView("t_udtf")
    got = [r.chunk for r in spark.sql("SELECT c.* FROM t_udtf, LATERAL chunk_text(t_udtf.text, 512, 64) c ORDER BY chunk_index").collect()]
    assert got == split_text("word " * 400, 512, 64)


def test_stream_budget_equals_batch(spark):
    from docshield.operators.analytics import daily_budget
    from docshield.sources.tables import read
    from docshield.streaming.jobs import stream_budget
    ev = read(spark, SF_SMALL, "events")
    s = {(r.event_id, r.day_n, r.allowed) for r in stream_budget(spark, ev, 5).collect()}
    b = {(r.event_id, r.day_n, r.allowed) for r in daily_budget(ev, 5).collect()}
    assert s == b


def test_stream_ingest_equals_batch(spark):
    from docshield.operators.chunking import chunk_count
    from docshield.operators.ingest import ingest_log, scan_documents
    from docshield.sources import fixtures as FX
    from docshield.streaming.jobs import stream_ingest
    docs = FX.docs_raw(spark, SF_SMALL)
    cols = ["doc_id", "status", "reason", "chunks_stored", "sensitivity_class"]
    s = {tuple(r) for r in stream_ingest(spark, docs, chunker="fixed")["ingest_log"].select(*cols).collect()}
    sc = scan_documents(docs)
    b = {tuple(r) for r in ingest_log(sc, chunk_count("fixed")).select(*cols).collect()}
    assert s == b


def _breaker_by_hand(rows, threshold=5, window=60):
    """(event_id, called, failed, open), call by call."""
    out, kept = [], {}
    for i, ts, scope, failed in sorted(rows, key=lambda r: (r[1], r[0])):
        own = kept[scope] = [t for t in kept.get(scope, []) if (ts - t).total_seconds() < window]
        is_open = len(own) >= threshold
        if failed and not is_open:
            own.append(ts)
        out.append((i, not is_open, bool(failed and not is_open), is_open))
    return sorted(out)


BREAKER_SCHEMA = "event_id long, ts timestamp, scope string, failed boolean"


def test_stream_breaker_matches_replay(spark):
    from datetime import datetime, timedelta
    from docshield.streaming.jobs import stream_circuit
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=7 * i), "g", i % 3 != 0) for i in range(60)]
    got = stream_circuit(spark, spark.createDataFrame(rows, BREAKER_SCHEMA)).select("event_id", "called", "failed", "breaker_open").collect()
    assert sorted(tuple(r) for r in got) == _breaker_by_hand(rows)


def test_breaker_replay_over_many_tasks(spark):
    """One outage without a quiet gap over several tasks, quiet logs, ties in time, other scopes, null scopes and flags."""
    import random
    from datetime import datetime, timedelta
    from docshield.operators import breaker
    from docshield.sources.files import cut
    r, t0 = random.Random(5), datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=r.randrange(4000)), "hot", r.random() < 0.9) for i in range(1500)]
    rows += [(5000 + i, t0 + timedelta(seconds=200 * i + r.randrange(30)), "quiet", True) for i in range(60)]
    rows += [(6000 + i, t0 + timedelta(seconds=r.randrange(9000)), r.choice(["a", "b", None]), r.choice([True, True, False, None])) for i in range(900)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out, _ = breaker.replay(spark.createDataFrame(rows, BREAKER_SCHEMA), cut)
        got = sorted(tuple(x) for x in out.select("event_id", "called", "failed", "breaker_open").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = _breaker_by_hand([(i, t, s, bool(f)) for i, t, s, f in rows])
    assert got == want and sum(x[3] for x in want) > 500


def test_breaker_without_failures_and_without_calls(spark):
    from datetime import datetime
    from docshield.operators import breaker
    from docshield.sources.files import cut
    out, ended = breaker.replay(spark.createDataFrame([(1, datetime(2024, 1, 1), "g", False), (2, None, "g", True)], BREAKER_SCHEMA), cut)
    assert sorted(tuple(x) for x in out.collect()) == [(1, "g", True, False, False), (2, "g", True, True, False)] and ended.count() == 0
    assert breaker.replay(spark.createDataFrame([], BREAKER_SCHEMA), cut)[0].count() == 0


def test_late_rows_go_to_the_side_table_only(spark):
    """Planted late rows: in the side table and in no window's count; rows in time are counted, each once."""
    from datetime import datetime, timedelta
    from docshield.streaming.jobs import stream_late
    t0 = datetime(2024, 1, 1, 10, 0)
    feed = [(k, k % 3, t0 + timedelta(seconds=20 * k), t0 + timedelta(seconds=20 * k)) for k in range(200)]  # 66 minutes, four batches
    late = [(1000 + k, 1, t0 + timedelta(minutes=k), t0 + timedelta(minutes=55, seconds=k)) for k in range(4)]  # their windows ended long before
    near = [(2000, 1, t0 + timedelta(minutes=49, seconds=55), t0 + timedelta(minutes=50))]  # five seconds, which the delay allows
    none = [(3000, 1, None, t0 + timedelta(minutes=51))]
    ev = spark.createDataFrame(feed + late + near + none, "event_id long, user_id long, ts timestamp, arrived timestamp")
    counts, side = stream_late(spark, ev, "arrived")
    assert {r.event_id for r in side.collect()} == {r[0] for r in late + none}
    assert all(r.ts is None or r.ts < r.watermark for r in side.collect())
    want = {}
    for _, user, ts, _ in feed + near:
        at = (ts.replace(second=0), user)
        want[at] = want.get(at, 0) + 1
    assert {(r.window_start, r.user_id): r.n for r in counts.collect()} == want


def test_search_ties_break_by_chunk_id(spark):
    from docshield.operators.search import vector_search
    q = spark.createDataFrame([(1, "t", [1.0, 0.0])], "query_id long, tenant_id string, qvec array<double>")
    c = spark.createDataFrame([(f"c{i}", "t", [1.0, 0.0]) for i in range(9, -1, -1)] + [("z", "u", [1.0, 0.0])],
                              "chunk_id string, tenant_id string, embedding array<double>")
    got = [r.chunk_id for r in vector_search(q, c, 3).orderBy("rank").collect()]
    assert got == ["c0", "c1", "c2"]
    sql = [r.chunk_id for r in vector_search(q, c, 3, method="sql").orderBy("rank").collect()]
    assert sql == got


def test_search_takes_any_number_of_roles(spark):
    from docshield.operators.search import vector_search
    q = spark.createDataFrame([(k, "t", [1.0, 0.0], [f"r{k}"], 3) for k in range(200)],
                              "query_id long, tenant_id string, qvec array<double>, roles array<string>, clearance_level int")
    c = spark.createDataFrame([(f"c{k:03}", "t", [1.0, 0.0], [f"r{k}", "other"], 1) for k in range(200)],
                              "chunk_id string, tenant_id string, embedding array<double>, acl_roles array<string>, level int")
    got = {(r.query_id, r.chunk_id) for r in vector_search(q, c, 3, authorize=True).collect()}
    assert got == {(k, f"c{k:03}") for k in range(200)}


def test_bucketed_previous_messages_equal_plain_window(spark):
    from pyspark.sql import Window
    from docshield.plans.pipeline_queries import previous_messages
    from docshield.sources.tables import read
    h = read(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text")
    got = {(r.conv_id, r.turn, tuple(r.prev)) for r in previous_messages(h, 6, bucket_rows=6).collect()}
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    want = {(r.conv_id, r.turn, tuple(r.prev)) for r in
            h.withColumn("prev", F.collect_list(F.concat("role", F.lit(": "), "text")).over(w)).collect()}
    assert got == want


@pytest.mark.parametrize("bucket_rows", [1, 4, 1024])
def test_previous_messages_reach_over_gaps(spark, bucket_rows):
    from pyspark.sql import Window
    from docshield.plans.pipeline_queries import previous_messages
    turns = [(1, t) for t in (0, 1, 2, 3, 1500, 2100, 9000)] + [(2, t) for t in (5, 7000)] + [(None, 3), (None, 9000), (1, None)]
    h = spark.createDataFrame([(c, t, "user", f"m{t}") for c, t in turns], "conv_id long, turn long, role string, text string")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    want = {(r.conv_id, r.turn, tuple(r.prev)) for r in
            h.withColumn("prev", F.collect_list(F.concat("role", F.lit(": "), "text")).over(w)).collect()}
    assert {(r.conv_id, r.turn, tuple(r.prev)) for r in previous_messages(h, 6, bucket_rows=bucket_rows).collect()} == want


def test_stream_sessions_equal_batch(spark):
    from docshield.operators.access import resolve_sessions
    from docshield.sources import fixtures as FX
    from docshield.streaming.jobs import stream_sessions
    s, r, u = FX.auth_sessions(spark, SF_SMALL), FX.session_requests(spark, SF_SMALL), FX.users(spark, SF_SMALL)
    cols = ["request_id", "status", "user_id", "role", "tenant_id"]
    got = {tuple(x) for x in stream_sessions(spark, s, r, u).select(*cols).collect()}
    want = {tuple(x) for x in resolve_sessions(r, s, u).select(*cols).collect()}
    assert got == want and len(got) > 0


def test_session_batches_run_without_a_python_group_for_each_token(spark):
    import datetime as dt
    from docshield.streaming.jobs import SESSION_STATE, session_batch
    at = lambda sec: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=sec)
    us = lambda sec: int(at(sec).timestamp()) * 1_000_000
    rows = [("a", at(5), 2, None, None, 1), ("a", at(9), 1, None, None, None), ("a", at(9), 2, None, None, 2),
            ("b", at(3), 0, 7, us(60), None), ("b", at(3), 2, None, None, 3), ("b", at(70), 2, None, None, 4), ("c", at(1), 2, None, None, 5)]
    batch = spark.createDataFrame(rows, "token_hash string, ts timestamp, kind int, user_id long, expires_us long, request_id long")
    state = spark.createDataFrame([("a", 4, us(600), None), ("d", 5, us(9), us(2))], SESSION_STATE)
    got = session_batch(batch, state)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    told = {r.request_id: (r.held and r.held.user, r.held and r.held.expires, r.revoked) for r in got.where("kind = 2").collect()}
    assert told == {1: (4, us(600), None), 2: (4, us(600), us(9)), 3: (7, us(60), None), 4: (7, us(60), None), 5: (None, None, None)}
    ends = {r.token_hash: (r.kind, r.held and r.held.user, r.revoked) for r in got.where("last_row").collect()}
    assert ends == {"a": (2, 4, us(9)), "b": (2, 7, None), "c": (2, None, None), "d": (-1, 5, us(2))}

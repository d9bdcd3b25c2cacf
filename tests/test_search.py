"""Exact top-k search: the broadcast path and the block-by-block path against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docshield.operators import cells
from docshield.operators.search import vector_search

ROLES = ["a", "b", "c"]


def _tables(spark, seed=3, n=400, m=60, clusters=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, 16))
    def vec():
        v = centre[rng.integers(clusters)] + 0.1 * rng.normal(size=16)
        return [float(x) for x in v]
    chunks = [(f"c{i:04d}", f"t{0 if i % 3 else i % 4}", vec(), [ROLES[i % 3]], i % 5) for i in range(n)]
    chunks += [(f"d{i}", "t0", chunks[1][2], ["a"], 0) for i in range(7)]          # ties
    chunks += [("z0", "t0", [0.0] * 16, ["a"], 0), ("z1", "t0", None, ["a"], 0), ("z2", None, vec(), ["a"], 0)]
    queries = [(i, f"t{i % 5}", vec(), [ROLES[i % 3], "b"], i % 5) for i in range(m)]
    queries += [(m, "t0", chunks[1][2], ["a"], 4), (m + 1, "t0", [0.0] * 16, ["a"], 4), (m + 2, None, vec(), ["a"], 4)]
    c = spark.createDataFrame(chunks, "chunk_id string, tenant_id string, embedding array<double>, acl_roles array<string>, level int")
    q = spark.createDataFrame(queries, "query_id long, tenant_id string, qvec array<double>, roles array<string>, clearance_level int")
    return q, c, queries, chunks


def _brute(queries, chunks, k, metric, scoped, authorize):
    out = set()
    for qid, qt, qv, roles, clearance in queries:
        found = []
        for cid, ct, cv, acl, level in chunks:
            if cv is None or (scoped and (qt is None or ct is None or qt != ct)):
                continue
            if authorize and not (set(acl) & set(roles) and level <= clearance):
                continue
            a, b = np.array(qv), np.array(cv)
            if metric == "cosine":
                if not a.any() or not b.any():
                    continue
                s = a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
            else:
                s = 1 - np.linalg.norm(a - b) / np.sqrt(2)
            found.append((-round(float(s), 9), cid))
        out |= {(qid, cid, r + 1) for r, (_, cid) in enumerate(sorted(found)[:k])}
    return out


def _rows(df):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric,scoped,authorize", [("cosine", True, True), ("cosine", False, False), ("l2_relevance", True, False)])
def test_all_methods_equal_all_pairs(spark, metric, scoped, authorize):
    q, c, queries, chunks = _tables(spark)
    want = _brute(queries, chunks, 5, metric, scoped, authorize)
    for method in ["arrow", "cells"] + (["sql"] if scoped else []):
        got = _rows(vector_search(q, c, 5, metric=metric, tenant_scoped=scoped, authorize=authorize, method=method))
        assert got == want, method


def test_small_blocks_and_parts_change_nothing(spark):
    q, c, queries, chunks = _tables(spark)
    qs, cs = q.where("tenant_id IS NOT NULL"), c.where("tenant_id IS NOT NULL AND embedding IS NOT NULL")
    got = _rows(cells.search_cells(qs, cs, 5, "cosine", True, True, block_chunks=16, block_queries=4))
    assert got == _brute(queries, chunks, 5, "cosine", True, True)


def test_large_batches_stay_on_the_executors(spark):
    q, c, queries, chunks = _tables(spark)
    got = vector_search(q, c, 3, tenant_scoped=False, broadcast_max=10)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert _rows(got) == _brute(queries, chunks, 3, "cosine", False, False)


def test_bounds_hold_and_rule_out_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 32))
    data = np.vstack([x + 0.05 * rng.normal(size=(50, 32)) for x in centre])
    for metric in ("cosine", "l2_relevance"):
        away = cells.distances(data, centre, metric)
        own = away.argmin(1)
        rows = []
        for q in data[::25]:
            dots = data @ q
            s = dots / (np.linalg.norm(data, axis=1) * np.linalg.norm(q)) if metric == "cosine" else 1 - np.linalg.norm(data - q, axis=1) / np.sqrt(2)
            kth = float(np.sort(s)[-5])
            dq = cells.distances(q[None], centre, metric)[0]
            for p in range(6):
                d = away[own == p, p]
                rows.append((float(dq[p]), float(d.min()), float(d.max()), float(s[own == p].max()), kth))
        t = spark.createDataFrame(rows, "q double, low double, high double, top double, kth double")
        t = t.withColumn("bound", cells.best_score(F.col("q"), F.col("low"), F.col("high"), metric))
        broken, pruned = t.agg(F.count_if(F.expr("bound < top")), F.count_if(F.expr("bound < kth"))).first()
        assert broken == 0
        assert pruned >= 48      # of 12 queries x 5 foreign cells


def test_empty_tables(spark):
    q, c, _, _ = _tables(spark)
    for method in ("arrow", "cells"):
        assert vector_search(q.limit(0), c, 3, method=method).count() == 0
        assert vector_search(q, c.limit(0), 3, method=method).count() == 0
        assert vector_search(q, c.where("chunk_id = 'z0'"), 3, method=method).count() == 0


def test_chunks_of_equal_vectors_are_one_row_with_the_least_ids(spark):
    rows = [(f"c{i:03d}", "t0", [1.0, 2.0 + (i >= 200)], ["a"], 0) for i in range(300)]
    c = spark.createDataFrame(rows, "chunk_id string, tenant_id string, embedding array<double>, acl_roles array<string>, level int")
    got = {tuple(r["embedding"]): r["ids"] for r in cells.distinct_vectors(c, 4, True, True).collect()}
    assert got == {(1.0, 2.0): [f"c{i:03d}" for i in range(4)], (1.0, 3.0): [f"c{i:03d}" for i in range(200, 204)]}


@pytest.mark.parametrize("metric,scoped,authorize", [("cosine", False, True), ("l2_relevance", False, False), ("l2_relevance", True, True)])
def test_a_task_returns_only_the_best_of_all_blocks(spark, metric, scoped, authorize):
    """No block's own best rows are shuffled: the join of blocks is the last step, and both sides reach it once."""
    q, c, queries, chunks = _tables(spark, seed=8, n=700, m=90, clusters=40)
    queries, chunks = [x for x in queries if x[1]], [x for x in chunks if x[1]]
    found = cells.search_cells(q.where("tenant_id IS NOT NULL"), c.where("tenant_id IS NOT NULL AND embedding IS NOT NULL"), 6, metric, scoped, authorize, block_chunks=8, block_queries=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.index("MapInArrow") < plan.index("CartesianProduct") < plan.index("Exchange")
    assert _rows(found) == _brute(queries, chunks, 6, metric, scoped, authorize)


def test_search_shuffles_no_text_of_the_chunks(spark):
    from docshield.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        todo, shuffled = [FX.chunks(spark, SF_SMALL).select("chunk_id", "tenant_id", "embedding")._jdf.queryExecution().executedPlan().initialPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                shuffled.append({node.output().apply(i).name() for i in range(node.output().size())})
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert shuffled and not any("text" in names for names in shuffled)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_block_below_the_floors_is_left_without_a_search_of_its_whole_matrix(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    block = cells.Asked(pa.table({"query_id": list(range(40)), "qvec": vectors[:40].tolist(), "floor": [0.999] * 40}), 3, "cosine", False)
    part = cells.Found(pa.table({"embedding": vectors[30:].tolist(), "ids": [[f"c{i:03d}"] for i in range(30, 300)]}), "cosine", False)
    searched = []

    def note(find):
        def run(a):
            searched.append(a.size)
            return find(a)
        return run
    for name in ("nonzero", "flatnonzero"):
        monkeypatch.setattr(cells.np, name, note(getattr(np, name)))
    block.meet(part)
    found = pd.concat(list(block.best()))
    assert list(zip(found["query_id"], found["chunk_id"])) == [(i, f"c{i:03d}") for i in range(30, 40)]
    assert max(searched) <= 10 * 270


def test_only_texts_with_an_embedding_are_shuffled(spark):
    from docshield.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FX.chunks(spark, SF_SMALL, planted=False).select("chunk_id", "text")._jdf.queryExecution().executedPlan().toString()
        docs = plan[plan.index("text#"):]
        assert "LeftSemi" in docs and docs.index("Exchange hashpartitioning(doc_id") < docs.index("LeftSemi")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_candidates_are_decided_without_texts(spark):
    from docshield.operators import retrieval as R
    from docshield.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    q, c = FX.queries(spark, SF_SMALL), FX.chunks(spark, SF_SMALL)
    decided = R.retrieve_candidates(q, c, texts=False)
    assert not {"text", "chunk_text"} & set(decided.columns)
    whole = {(r.query_id, r.rank): r for r in R.retrieve_candidates(q, c).collect()}
    rows = decided.collect()
    assert len(rows) == len(whole) and all(r.action == whole[r.query_id, r.rank].action for r in rows)
    for r in whole.values():
        assert r.text.startswith("[FLAGGED UNTRUSTED CHUNK") == (r.action == "wrap") and r.chunk_text in r.text
    assert {"wrap", "pass"} <= {r.action for r in whole.values()}


def test_only_texts_of_wanted_chunks_are_shuffled(spark, monkeypatch):
    from docshield.operators import retrieval as R
    from docshield.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    chunks = FX.chunks(spark, SF_SMALL)
    rows = [(1, "0_chunk_0", 10, "pass"), (2, "0_chunk_0", 10, "pass"), (3, "pc6", 3, "wrap"), (4, "no_chunk", 10, "pass")]
    cands = spark.createDataFrame(rows, "query_id long, chunk_id string, trust int, action string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        found = R.with_texts(cands, chunks)
        got = sorted((r.query_id, r.chunk_id, r.chunk_text, r.text) for r in found.collect())
        todo, shuffled = [found._jdf.queryExecution().executedPlan().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName().endswith("QueryStage"):
                node = node.plan()
            if node.nodeName() == "Exchange" and "chunk_text" in {node.output().apply(i).name() for i in range(node.output().size())}:
                shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert shuffled == [2]
        monkeypatch.setattr(R, "WANTED_BROADCAST", 1)  # more than may be broadcast: the same rows
        assert got == sorted((r.query_id, r.chunk_id, r.chunk_text, r.text) for r in R.with_texts(cands, chunks).collect())
        assert [x[0] for x in got] == [1, 2, 3] and got[2][3].startswith("[FLAGGED UNTRUSTED CHUNK")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_logs_read_routed_queries_and_answers_that_are_written_once(spark):
    from docshield.plans import pipeline as P
    from docshield.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    per_query, cands = P.for_tables(spark, SF_SMALL)
    log = P.injection_log(per_query, cands, FX.chunks(spark, SF_SMALL))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "conv_id" not in plan


def test_the_newest_documents_are_a_top_n_and_no_sort_of_all_texts(spark):
    from docshield.plans import analytics_queries as A
    from docshield.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    log = A._ingest_log_newest(spark, SF_SMALL, 20)
    for df, top in ((A._newest_documents(FX.docs_raw(spark, SF_SMALL), 20), True), (log, False)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and ("TakeOrderedAndProject" in plan) == top
    every = A._ingest_log(spark, SF_SMALL)
    newest = every.orderBy(F.col("ingested_at").desc(), F.col("id").desc()).limit(20)
    assert {(r.id, r.status) for r in log.collect()} == {(r.id, r.status) for r in newest.select("id", "status", "ingested_at").collect()}

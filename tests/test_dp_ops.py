"""DP goldens (dp embedder tests) and operational rules (budget, breaker, rate limit)."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docshield.functions import vectors as V
from docshield.operators import analytics as AN


def test_prf_value(spark):
    got = spark.range(1).select(V.prf_uniform("k", F.lit(0), F.lit(0))).first()[0]
    assert got == pytest.approx(0.5602949282675339, abs=1e-15)


def test_documents_noised_query_not(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    out = df.select("v", V.dp_noisy("v", F.col("id"), "test-key", epsilon=0.5).alias("n")).collect()
    for r in out:
        assert r.n != r.v
        assert math.isclose(math.sqrt(sum(x * x for x in r.n)), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("mech", ["gaussian", "laplace"])
def test_unit_norm_after_clip(spark, mech):
    df = spark.createDataFrame([(1, [10.0, 0.0])], "id long, v array<double>")
    n = df.select(V.dp_noisy("v", F.col("id"), "k", epsilon=0.5, mechanism=mech, delta=1e-5, clip=2.0)).first()[0]
    assert math.isclose(math.hypot(*n), 1.0, rel_tol=1e-9) and n != [1.0, 0.0]


@pytest.mark.parametrize("kw", [dict(epsilon=-1), dict(mechanism="invalid"), dict(mechanism="gaussian", delta=0),
                                dict(clip=-1)])
def test_invalid_parameters(kw):
    args = dict(epsilon=0.5, mechanism="laplace", delta=1e-5, clip=1.0)
    args.update(kw)
    with pytest.raises(ValueError):
        V.validate_dp(args["epsilon"], args["mechanism"], args["delta"], args["clip"])


def test_same_key_same_noise_new_key_new(spark):
    df = spark.createDataFrame([(7, [0.6, 0.8])], "id long, v array<double>")
    a = df.select(V.dp_noisy("v", F.col("id"), "k1", epsilon=0.5)).first()[0]
    b = df.select(V.dp_noisy("v", F.col("id"), "k1", epsilon=0.5)).first()[0]
    c = df.select(V.dp_noisy("v", F.col("id"), "k2", epsilon=0.5)).first()[0]
    assert a == b and a != c


def test_empirical_sigma(spark):
    sigma = V.gaussian_sigma(1.0, 1e-5, 1.0)
    d = spark.range(40000).select(V.noise("k", F.col("id"), F.lit(0), "gaussian", sigma).alias("x"))
    r = d.select(F.stddev_pop("x"), F.avg("x")).first()
    assert abs(r[0] / sigma - 1) < 0.03 and abs(r[1]) < 0.1


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")


def test_budget_101st_blocked(spark):
    t0 = datetime(2024, 1, 1, 8)
    ev = _events(spark, [(i, 1, t0 + timedelta(seconds=i), "view") for i in range(101)])
    got = AN.daily_budget(ev, 100).where(~F.col("allowed")).select("event_id").collect()
    assert [r[0] for r in got] == [100]


def test_breaker_window_is_strict(spark):
    t0 = datetime(2024, 1, 1, 8)
    rows = [(i, 1, t0 + timedelta(seconds=i), "error") for i in range(5)]
    rows += [(10, 1, t0 + timedelta(seconds=30), "view"), (11, 1, t0 + timedelta(seconds=60), "view")]
    got = {r.event_id: (r.recent_failures, r.breaker_open)
           for r in AN.circuit_state(_events(spark, rows), F.col("event_type") == "error").collect()}
    assert got[10] == (5, True)
    assert got[11] == (4, False)     # the failure exactly 60 s old no longer counts


def test_breaker_across_midnight(spark):
    t0 = datetime(2024, 1, 1, 23, 59, 30)
    rows = [(i, 1, t0 + timedelta(seconds=i), "error") for i in range(5)] + [(9, 1, datetime(2024, 1, 2, 0, 0, 10), "view")]
    got = {r.event_id: r.breaker_open for r in AN.circuit_state(_events(spark, rows), F.col("event_type") == "error").collect()}
    assert got[9] is True


def test_rate_limit_61(spark):
    t0 = datetime(2024, 1, 1, 8)
    ev = _events(spark, [(i, 1, t0 + timedelta(milliseconds=500 * i), "view") for i in range(61)])
    r = AN.rate_limit(ev, 60, "1 minute", F.col("user_id").cast("string"))
    assert r.where("over_limit").count() >= 1


@pytest.mark.parametrize("mech", ["gaussian", "laplace"])
def test_noised_search_equals_a_search_over_noised_vectors(spark, mech):
    """Each scale's hits against ``vector_search`` over chunks noised by ``dp_noisy``; zero vectors, nulls, a tenant with fewer chunks than k."""
    from docshield.operators import dp as DP
    from docshield.operators.search import vector_search
    epsilons, keyed = [0.1, 2.0, 1000.0], "k1"
    vec = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.sin(F.col("id") * 7 + d * d + 1).cast("float"))
    c = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.when(F.col("id") < 3, "few").when(F.col("id") % 9 > 0, "big").when(F.col("id") % 2 == 0, "b").alias("tenant_id"),
                                 F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, F.transform(vec, lambda x: x * 0)).otherwise(vec).alias("embedding"))
    q = spark.range(300).select((F.col("id") - 5).alias("query_id"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 10 == 1, "few").when(F.col("id") % 10 == 2, "none").when(F.col("id") < 290, "big").alias("tenant_id"),
                                F.when(F.col("id") % 40 == 7, None).when(F.col("id") == 30, F.transform(vec, lambda x: x * 0)).otherwise(vec).alias("qvec"))
    scales = [V.gaussian_sigma(e, DP.C.DP_DELTA, DP.C.DP_CLIP) if mech == "gaussian" else DP.C.DP_CLIP / e for e in epsilons]
    got = DP.noised_search(q, c, 5, key=keyed, scales=scales, mechanism=mech)
    found = sorted((r.ei, r.query_id, r.chunk_id) for r in got.collect())
    want = []
    for ei, e in enumerate(epsilons):
        noisy = c.withColumn("embedding", V.dp_noisy(V.as_double("embedding"), F.col("chunk_id"), keyed, e, mech))
        want += [(ei, r.query_id, r.chunk_id) for r in vector_search(q, noisy, 5).collect()]
    assert found == sorted(want) and len(found) > 3000
    swept = {r.epsilon: (r.recall_at_k, r.n_queries) for r in DP.privacy_utility_sweep(q, c, key=keyed, epsilons=epsilons, mechanism=mech).collect()}
    clean = {(r.query_id, r.chunk_id) for r in vector_search(q, c, 5).collect()}
    for ei, e in enumerate(epsilons):
        asked = {x[1] for x in found if x[0] == ei}
        assert swept[e] == (pytest.approx(sum(x[1:] in clean for x in found if x[0] == ei) / 5 / len(asked), abs=1e-6), len(asked))

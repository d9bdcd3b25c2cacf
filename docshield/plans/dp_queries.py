"""Registered vector / differential-privacy queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import vectors as V
from docshield.operators import dp as DP
from docshield.oracle.fixtures import with_ctes
from docshield.sources import fixtures as FX
from docshield.sources.tables import read

KEY = C.TEST_PRF_KEY
SIGMA = V.gaussian_sigma(C.DP_EPSILON, C.DP_DELTA, C.DP_CLIP)
LAPLACE_B = C.DP_CLIP / C.DP_EPSILON


def _emb(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", V.as_double("embedding").alias("v"), "label")


def q_l2_clip(spark, sf):
    e = _emb(spark, sf).select("vec_id", F.transform("v", lambda x: x * (F.col("label") + 1)).alias("v"))
    c = V.l2_clip("v", C.DP_CLIP)
    return e.select("vec_id", F.round(V.l2_norm("v"), 6).alias("norm_before"), F.round(V.l2_norm(c), 6).alias("norm_after"),
                    F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_after"))


def q_l2_normalize(spark, sf):
    e = _emb(spark, sf).select("vec_id", F.transform("v", lambda x: x * (F.col("label") - 4)).alias("v"))
    n = V.l2_normalize("v")
    return e.select("vec_id", F.round(V.l2_norm(n), 6).alias("norm_after"),
                    F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_after"))


def _noise_rows(spark, sf, mechanism, scale):
    e = _emb(spark, sf).select("vec_id", F.posexplode("v").alias("dim", "x"))
    return e.select("vec_id", F.col("dim").cast("bigint").alias("dim"),
                    F.round(V.noise(KEY, F.col("vec_id"), F.col("dim"), mechanism, scale), 6).alias("noise"))


def q_dp_gaussian(spark, sf):
    return _noise_rows(spark, sf, "gaussian", SIGMA)


def q_dp_laplace(spark, sf):
    return _noise_rows(spark, sf, "laplace", LAPLACE_B)


def q_dp_embed(spark, sf):
    e = _emb(spark, sf)
    n = e.select("vec_id", V.dp_noisy("v", F.col("vec_id"), KEY).alias("n"))
    x = n.select("vec_id", F.posexplode("n").alias("dim", "value"))
    return x.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def q_dp_noise_stats(spark, sf):
    e = _emb(spark, sf)
    n = e.select("vec_id", "v", V.dp_noisy("v", F.col("vec_id"), KEY, mechanism="laplace", epsilon=5.0).alias("n"))
    s = n.select("vec_id", V.noise_stats("v", "n").alias("s"))
    return s.select("vec_id", "s.noise_l2_norm", "s.noise_mean", "s.noise_std", "s.cosine_sim")


def q_dp_audit(spark, sf):
    c = FX.chunks(spark, sf).select("chunk_id", "doc_id", V.as_double("embedding").alias("v"))
    a = DP.dp_audit(c, key=KEY, id_col="chunk_id", mechanism="laplace", epsilon=5.0)
    return a.select("doc_id", F.round("epsilon", 6).alias("epsilon"), F.round("sensitivity", 6).alias("sensitivity"),
                    F.round("noise_l2_mean", 6).alias("noise_l2_mean"), F.round("cosine_sim_mean", 6).alias("cosine_sim_mean"),
                    F.col("chunks_processed").cast("bigint").alias("chunks_processed"))


def q_dp_sweep(spark, sf):
    return DP.privacy_utility_sweep(FX.queries(spark, sf), FX.chunks(spark, sf), key=KEY)


QUERIES = {
    "l2_clip": q_l2_clip,
    "l2_normalize": q_l2_normalize,
    "dp_gaussian": q_dp_gaussian,
    "dp_laplace": q_dp_laplace,
    "dp_embed": q_dp_embed,
    "dp_noise_stats": q_dp_noise_stats,
    "dp_audit": q_dp_audit,
    "dp_sweep": q_dp_sweep,
}

# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

TWO_PI = repr(2.0 * math.pi)


def prf_sql(row_id: str, dim: str, salt: str = "") -> str:
    s = f"'{KEY}|' || cast({row_id} AS VARCHAR) || '|' || cast({dim} AS VARCHAR)"
    if salt:
        s += f" || '|{salt}'"
    return f"((('0x' || substr(sha256({s}), 1, 13))::BIGINT + 0.5) / pow(2, 52))"


def noise_sql(row_id, dim, mechanism, scale):
    if mechanism == "gaussian":
        return (f"({repr(scale)} * sqrt(-2.0 * ln({prf_sql(row_id, dim, 'a')})) * "
                f"cos({TWO_PI} * {prf_sql(row_id, dim, 'b')}))")
    u = f"({prf_sql(row_id, dim)} - 0.5)"
    return f"(-{repr(scale)} * sign({u}) * ln(1.0 - 2.0 * abs({u})))"


def norm_sql(v):
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def sum_sql(v):
    return f"list_sum({v})"


_LET = [0]


def let_sql(value, body):
    """evaluate ``value`` once: [value] transformed, first element."""
    _LET[0] += 1
    name = f"l{_LET[0]}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def clip_sql(v, c=C.DP_CLIP):
    return let_sql(v, lambda a: let_sql(norm_sql(a), lambda n: f"(CASE WHEN {n} > {c} THEN list_transform({a}, lambda x: x * ({c} / {n})) ELSE {a} END)"))


def normalize_sql(v):
    return let_sql(v, lambda a: let_sql(norm_sql(a), lambda n: f"(CASE WHEN {n} > 0 THEN list_transform({a}, lambda x: x / {n}) ELSE {a} END)"))


def noisy_sql(v, row_id, mechanism=C.DP_MECHANISM, epsilon=C.DP_EPSILON):
    scale = V.gaussian_sigma(epsilon, C.DP_DELTA, C.DP_CLIP) if mechanism == "gaussian" else C.DP_CLIP / epsilon
    added = f"list_transform({clip_sql(v)}, lambda x, i: x + {noise_sql(row_id, 'i - 1', mechanism, scale)})"
    return normalize_sql(added)


EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def o_l2_clip():
    return with_ctes([], f"""
        SELECT vec_id, round({norm_sql('v')}, 6) AS norm_before, round({norm_sql(clip_sql('v'))}, 6) AS norm_after,
               round({sum_sql(clip_sql('v'))}, 6) AS sum_after
        FROM (SELECT vec_id, list_transform(v, lambda x: x * (label + 1)) AS v FROM e)""", extra=EMB)


def o_l2_normalize():
    return with_ctes([], f"""
        SELECT vec_id, round({norm_sql(normalize_sql('v'))}, 6) AS norm_after, round({sum_sql(normalize_sql('v'))}, 6) AS sum_after
        FROM (SELECT vec_id, list_transform(v, lambda x: x * (label - 4)) AS v FROM e)""", extra=EMB)


def _o_noise(mech, scale):
    return with_ctes([], f"""
        SELECT vec_id, cast(dim AS BIGINT) AS dim, round({noise_sql('vec_id', 'dim', mech, scale)}, 6) AS noise
        FROM (SELECT vec_id, generate_subscripts(v, 1) - 1 AS dim FROM e)""", extra=EMB)


def o_dp_gaussian():
    return _o_noise("gaussian", SIGMA)


def o_dp_laplace():
    return _o_noise("laplace", LAPLACE_B)


def o_dp_embed():
    return with_ctes([], f"""
        SELECT vec_id, cast(generate_subscripts(n, 1) - 1 AS BIGINT) AS dim, round(unnest(n), 6) AS value
        FROM (SELECT vec_id, {noisy_sql('v', 'vec_id')} AS n FROM e)""", extra=EMB)


def stats_sql(o, n):
    diff = f"list_transform(list_zip({n}, {o}), lambda p: p[1] - p[2])"
    mean = f"({sum_sql(diff)} / len({diff}))"
    var = f"(list_sum(list_transform({diff}, lambda x: (x - {mean}) * (x - {mean}))) / len({diff}))"
    dotp = f"list_sum(list_transform(list_zip({o}, {n}), lambda p: p[1] * p[2]))"
    return (f"round({norm_sql(diff)}, 6) AS noise_l2_norm, round({mean}, 6) AS noise_mean, round(sqrt({var}), 6) AS noise_std, "
            f"round({dotp} / ({norm_sql(o)} * {norm_sql(n)} + 1e-10), 6) AS cosine_sim")


def o_dp_noise_stats():
    return with_ctes([], f"""
        SELECT vec_id, {stats_sql('v', 'n')}
        FROM (SELECT vec_id, v, {noisy_sql('v', 'vec_id', 'laplace', 5.0)} AS n FROM e)""", extra=EMB)


def o_dp_audit():
    return with_ctes(["chunks"], f"""
        SELECT doc_id, 5.0::DOUBLE AS epsilon, {C.DP_SENSITIVITY}::DOUBLE AS sensitivity,
               round(floor((2 * sum(cast(round(noise_l2_norm * 1e6) AS BIGINT)) + count(*)) / (2 * count(*))) / 1e6, 6) AS noise_l2_mean,
               round(floor((2 * sum(cast(round(cosine_sim * 1e6) AS BIGINT)) + count(*)) / (2 * count(*))) / 1e6, 6) AS cosine_sim_mean,
               cast(count(*) AS BIGINT) AS chunks_processed
        FROM (SELECT doc_id, {stats_sql('v', 'n')}
              FROM (SELECT doc_id, v, {noisy_sql('v', 'chunk_id', 'laplace', 5.0)} AS n
                    FROM (SELECT chunk_id, doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM chunks)))
        GROUP BY doc_id""")


ORACLE = {
    "l2_clip": o_l2_clip,
    "l2_normalize": o_l2_normalize,
    "dp_gaussian": o_dp_gaussian,
    "dp_laplace": o_dp_laplace,
    "dp_embed": o_dp_embed,
    "dp_noise_stats": o_dp_noise_stats,
    "dp_audit": o_dp_audit,
}

"""Vector and differential-privacy expressions (V1–V7).

Vectors are ``array<double>`` columns; all maths is higher-order array
functions, evaluated per row with no shuffle.  Noise comes from a keyed PRF
over (key, row id, dimension), so a retried or recomputed task reproduces
exactly the same noisy vector instead of releasing a second sample.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from docshield import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    transform): higher-order bodies would otherwise re-evaluate it per
    element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_clip(v, threshold: float = C.DP_CLIP) -> Column:
    """V1: scale to ``threshold`` when the norm exceeds it."""
    def body(a):
        return let(l2_norm(a), lambda n: F.when(
            n > threshold, F.transform(a, lambda x: x * (F.lit(threshold) / n))).otherwise(a))
    return let(_col(v), body)


def l2_normalize(v) -> Column:
    """V2: unit projection; the zero vector is returned unchanged."""
    def body(a):
        return let(l2_norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))
    return let(_col(v), body)


def cosine(a, b, eps: float = 0.0) -> Column:
    """V3: cosine similarity, null for a zero vector; ``eps`` is added to the denominator (stats use 1e-10)."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b) + F.lit(eps))


def l2_relevance(a, b) -> Column:
    """V3, vector-store default: 1 - d/sqrt(2) over L2 distance of unit vectors."""
    d = F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                           lambda acc, x: acc + x))
    return F.lit(1.0) - d / F.lit(math.sqrt(2.0))


# ---------------------------------------------------------------------------
# keyed PRF and noise (V4, V5)
# ---------------------------------------------------------------------------

TWO52 = float(2 ** 52)


def prf_uniform(key: str, row_id, dim, salt: str = "") -> Column:
    """Uniform in (0, 1) from the first 52 bits of SHA-256(key|id|dim[|salt])."""
    parts = [F.lit(key), F.lit("|"), _col(row_id).cast("string"), F.lit("|"), _col(dim).cast("string")]
    if salt:
        parts += [F.lit("|"), F.lit(salt)]
    h = F.sha2(F.concat(*parts), 256)
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(TWO52)


def gaussian_sigma(epsilon: float, delta: float, clip: float) -> float:
    return clip * math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon


def validate_dp(epsilon: float, mechanism: str, delta: float, clip: float) -> None:
    """The DP parameter checks (raise ValueError)."""
    if epsilon <= 0:
        raise ValueError(f"epsilon must be > 0, got {epsilon}")
    if mechanism not in ("laplace", "gaussian"):
        raise ValueError(f"mechanism must be 'laplace' or 'gaussian', got {mechanism}")
    if mechanism == "gaussian" and delta <= 0:
        raise ValueError(f"delta must be > 0 for Gaussian mechanism, got {delta}")
    if clip <= 0:
        raise ValueError(f"clipping_threshold must be > 0, got {clip}")
    if mechanism == "gaussian" and epsilon >= 1:
        warnings.warn("the classical Gaussian-mechanism bound is only proven for epsilon < 1",
                      stacklevel=3)


def noise(key: str, row_id, i, mechanism: str, scale: float) -> Column:
    if mechanism == "gaussian":
        return noise_of(mechanism, scale, prf_uniform(key, row_id, i, "a"), prf_uniform(key, row_id, i, "b"))
    return noise_of(mechanism, scale, prf_uniform(key, row_id, i))


def noise_of(mechanism: str, scale: float, u1: Column, u2: Column | None = None) -> Column:
    """Noise from uniform numbers: two for ``gaussian``, one for ``laplace``."""
    if mechanism == "gaussian":
        return F.lit(scale) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    u = u1 - F.lit(0.5)
    return F.lit(-scale) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def dp_noisy(v, row_id, key: str, epsilon: float = C.DP_EPSILON, mechanism: str = C.DP_MECHANISM,
             delta: float = C.DP_DELTA, clip: float = C.DP_CLIP) -> Column:
    """V6: clip → add keyed noise → unit projection.  Stored vectors only."""
    if not key:
        raise ValueError("a PRF key is required for DP noise")
    validate_dp(epsilon, mechanism, delta, clip)
    scale = gaussian_sigma(epsilon, delta, clip) if mechanism == "gaussian" else clip / epsilon
    clipped = l2_clip(v, clip)
    noisy = F.transform(clipped, lambda x, i: x + noise(key, row_id, i, mechanism, scale))
    return l2_normalize(noisy)


def noise_stats(original, noisy) -> Column:
    """V7: l2/mean/std of (noisy - original) and cosine, rounded to 6."""
    def body(pair):
        o, n = pair["o"], pair["n"]
        diff = F.zip_with(n, o, lambda a, b: a - b)

        def with_diff(d):
            cnt = F.size(d)

            def with_mean(mean):
                var = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / cnt
                return F.struct(
                    F.round(l2_norm(d), 6).alias("noise_l2_norm"),
                    F.round(mean, 6).alias("noise_mean"),
                    F.round(F.sqrt(var), 6).alias("noise_std"),
                    F.round(cosine(o, n, 1e-10), 6).alias("cosine_sim"))
            return let(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x) / cnt, with_mean)
        return let(diff, with_diff)
    return let(F.struct(_col(original).alias("o"), _col(noisy).alias("n")), body)

"""Query routing (T13–T17): fast injection filter, classifier decision tables,
fail-closed handling, two-pass routing.  Classifier outputs are input
tables joined by query id (left joins: a missing score is a classifier
failure)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshield import constants as C

FAST_PATTERN = "(?i)(?:" + "|".join(C.FAST_INJECTION_PATTERNS) + ")"
DECISION = "struct<action:string,category:string,confidence:double,is_safe:boolean>"


def fast_block(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike(FAST_PATTERN), F.lit(False))


def _decision(action, category, confidence, is_safe) -> Column:
    return F.struct(action.alias("action"), category.alias("category"),
                    confidence.cast("double").alias("confidence"), is_safe.alias("is_safe"))


def _category_of(label: Column) -> Column:
    m = F.create_map(*[x for k, v in C.ROUTER_CATEGORY.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, label)


def decide_scores(text: Column, top_label: Column, top_score: Column, has_score: Column,
                  fail_closed: bool = True, threshold: float = C.ROUTER_THRESHOLD,
                  block_categories=C.ROUTER_BLOCK_CATEGORIES) -> Column:
    """T13 + T14 + T16 for zero-shot (label, score) outputs."""
    blocks = F.array(*[F.lit(c) for c in block_categories])
    safe = top_label == "safe question"
    cat = F.when(~safe, _category_of(top_label))
    should_block = ~safe & (top_score >= threshold) & F.coalesce(F.array_contains(blocks, cat), F.lit(False))
    action = F.when(should_block, "block").when(~safe, "flag").otherwise("allow")
    scored = _decision(action, cat, F.round(top_score, 4), safe | ~should_block)
    failed = (_decision(F.lit("block"), F.lit("security_classifier_unavailable"), F.lit(0.0), F.lit(False))
              if fail_closed else _decision(F.lit("allow"), F.lit(None).cast("string"), F.lit(0.0), F.lit(True)))
    fast = _decision(F.lit("block"), F.lit("prompt_injection"), F.lit(1.0), F.lit(False))
    return F.when(fast_block(text), fast).when(~has_score, failed).otherwise(scored)


def decide_guard(text: Column, is_safe: Column, category: Column, confidence: Column, has_row: Column,
                 fail_closed: bool = True, block_categories=C.ROUTER_BLOCK_CATEGORIES) -> Column:
    """T13 + T15 + T16 for guard-service responses (defaults: safe, 1.0)."""
    blocks = F.array(*[F.lit(c) for c in block_categories])
    safe = F.coalesce(is_safe, F.lit(True))
    cat = F.when(~safe, category)
    should_block = ~safe & F.coalesce(F.array_contains(blocks, cat), F.lit(False))
    action = F.when(should_block, "block").when(~safe, "flag").otherwise("allow")
    scored = _decision(action, cat, F.coalesce(confidence, F.lit(1.0)), safe | ~should_block)
    failed = (_decision(F.lit("block"), F.lit("security_classifier_unavailable"), F.lit(0.0), F.lit(False))
              if fail_closed else _decision(F.lit("allow"), F.lit(None).cast("string"), F.lit(0.0), F.lit(True)))
    fast = _decision(F.lit("block"), F.lit("prompt_injection"), F.lit(1.0), F.lit(False))
    return F.when(fast_block(text), fast).when(~has_row, failed).otherwise(scored)


def route_with_scores(queries: DataFrame, scores: DataFrame, text_col: str = "query",
                      out: str = "route", fail_closed: bool = True) -> DataFrame:
    s = scores.select("query_id", "top_label", "top_score", F.lit(True).alias("_has"))
    j = queries.join(s, "query_id", "left")
    d = decide_scores(F.col(text_col), F.col("top_label"), F.col("top_score"),
                      F.coalesce("_has", F.lit(False)), fail_closed)
    return j.withColumn(out, d).drop("top_label", "top_score", "_has")


def route_with_guard(queries: DataFrame, guard: DataFrame, text_col: str = "query",
                     out: str = "route", fail_closed: bool = True) -> DataFrame:
    g = guard.select("query_id", "is_safe", "category", "confidence", F.lit(True).alias("_has"))
    j = queries.join(g, "query_id", "left")
    d = decide_guard(F.col(text_col), F.col("is_safe"), F.col("category"), F.col("confidence"),
                     F.coalesce("_has", F.lit(False)), fail_closed)
    return j.withColumn(out, d).drop("is_safe", "category", "confidence", "_has")


def two_pass(queries: DataFrame, scores: DataFrame, rewrites: DataFrame | None = None,
             fail_closed: bool = True) -> DataFrame:
    """Route the raw query, then the standalone rewrite; the first block wins.

    ``rewrites(query_id, standalone_query, top_label, top_score)`` is the model's rewrite
    with the classifier's answer for that text: the second pass judges the rewrite by
    its own score, and a rewrite without one by the fail-closed rule.  A
    missing rewrite means the raw query, whose score then holds for both passes."""
    q, s = queries, scores.select("query_id", "top_label", "top_score", F.lit(True).alias("_has"))
    if rewrites is not None:
        scored = "top_label" in rewrites.columns
        own = [F.col(c) if scored else F.lit(None).cast(t) for c, t in (("top_label", "string"), ("top_score", "double"))]
        q = q.join(rewrites.select("query_id", "standalone_query", own[0].alias("_label"), own[1].alias("_score")), "query_id", "left")
    else:
        q = q.withColumns({"standalone_query": F.lit(None).cast("string"), "_label": F.lit(None).cast("string"), "_score": F.lit(None).cast("double")})
    j = q.join(s, "query_id", "left").withColumn("_own", F.col("standalone_query").isNotNull()).withColumn("standalone_query", F.coalesce("standalone_query", "query"))
    has = F.coalesce("_has", F.lit(False))
    raw = decide_scores(F.col("query"), F.col("top_label"), F.col("top_score"), has, fail_closed)
    of_rewrite = lambda mine, other: F.when(F.col("_own"), mine).otherwise(other)
    second = decide_scores(F.col("standalone_query"), of_rewrite(F.col("_label"), F.col("top_label")), of_rewrite(F.col("_score"), F.col("top_score")),
                           of_rewrite(F.col("_label").isNotNull() & F.col("_score").isNotNull(), has), fail_closed)
    j = j.withColumn("raw_route", raw).withColumn("second_route", second)
    blocked_raw = F.col("raw_route.action") == "block"
    final = F.when(blocked_raw, F.col("raw_route")).otherwise(F.col("second_route"))
    stage = F.when(blocked_raw, "raw").when(F.col("second_route.action") == "block", "rephrased")
    return j.withColumn("route", final).withColumn("blocked_at", stage) \
        .withColumn("safe_query", F.when(F.col("route.action") != "block", F.col("standalone_query"))) \
        .drop("top_label", "top_score", "_has", "_label", "_score", "_own")

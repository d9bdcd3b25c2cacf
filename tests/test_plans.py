"""Plan-shape checks for the scale properties the README claims."""

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_scan_has_no_shuffle(spark):
    from docshield.plans import catalog
    p = _plan(catalog.QUERIES["ingest_scan"](spark, SF_SMALL))
    assert "Exchange" not in p
    assert "Generate inline" in p


def test_topk_is_partial_limited_before_shuffle(spark):
    from docshield.plans import catalog
    p = _plan(catalog.QUERIES["vector_topk"](spark, SF_SMALL))
    assert "MapInPandas" in p
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_feed_branches_are_top_n(spark):
    from docshield.plans import catalog
    p = _plan(catalog.QUERIES["events_feed"](spark, SF_SMALL))
    assert p.count("TakeOrderedAndProject") >= 4


def test_no_cartesian_products_in_registered_plans(spark):
    from docshield.plans import catalog
    for k in ("guarded_answers", "acl_retrieve", "graph_authorized_docs", "dp_budget", "rate_limit",
              "circuit_open", "reingest_dups", "signup_dedup", "audit_chain"):
        p = _plan(catalog.QUERIES[k](spark, SF_SMALL))
        assert "CartesianProduct" not in p, k

"""Access control goldens (rbac self-check matrix, filter demos, ACL exact match)."""

import pytest
from pyspark.sql import functions as F

from docshield.functions import access as A
from docshield.operators import access as AO

MATRIX = [
    (["employee"], "PUBLIC", True), (["employee"], "INTERNAL", True),
    (["employee"], "CONFIDENTIAL", False), (["employee"], "RESTRICTED", False),
    (["manager"], "CONFIDENTIAL", True), (["manager"], "RESTRICTED", False),
    (["executive"], "RESTRICTED", True), (["executive"], "TOP_SECRET", False),
    (["admin"], "TOP_SECRET", True), (["anonymous"], "INTERNAL", False),
]


def test_clearance_matrix(spark):
    df = spark.createDataFrame([(r, c, e) for r, c, e in MATRIX], "roles array<string>, cls string, expected boolean")
    got = df.select("expected", (A.access_reason("roles", "cls", F.array().cast("array<string>")) == "ok").alias("ok")).collect()
    assert all(r.expected == r.ok for r in got)


def test_clearance_resolution(spark):
    df = spark.createDataFrame([(["employee"],), (["contractor"],), ([],), (["manager", "employee"],)], "roles array<string>")
    assert [r[0] for r in df.select(A.resolve_clearance("roles")).collect()] == \
        ["INTERNAL", "PUBLIC", "PUBLIC", "CONFIDENTIAL"]


def _pairs(spark, rows, roles, tenant):
    df = spark.createDataFrame(rows, "chunk_id string, sensitivity_class string, chunk_tenant string, acl_roles array<string>")
    return df.select("*", F.lit("u001").alias("user_id"), F.array(*[F.lit(r) for r in roles]).alias("roles"),
                     F.lit(tenant).alias("tenant_id"), F.array().cast("array<string>").alias("acl_users"),
                     F.lit("x").alias("text"))


def test_four_chunk_filter(spark):
    rows = [("c1", "PUBLIC", "org1", []), ("c2", "INTERNAL", "org1", []),
            ("c3", "CONFIDENTIAL", "org1", []), ("c4", "PUBLIC", "org2", [])]
    d = AO.rbac_decide(_pairs(spark, rows, ["employee"], "org1"))
    res = {r.chunk_id: r.reason for r in d.collect()}
    assert sum(v == "ok" for v in res.values()) == 2
    assert res["c4"] == "tenant_boundary"
    assert res["c3"] == "clearance_insufficient: INTERNAL < CONFIDENTIAL"


@pytest.mark.parametrize("role,allowed,blocked", [("employee", 2, 3), ("manager", 3, 2), ("executive", 4, 1)])
def test_five_chunk_retrieve(spark, role, allowed, blocked):
    rows = [("c1", "PUBLIC", "org1", []), ("c2", "INTERNAL", "org1", []), ("c3", "CONFIDENTIAL", "org1", []),
            ("c4", "RESTRICTED", "org1", []), ("c5", "PUBLIC", "org2", [])]
    d = AO.rbac_decide(_pairs(spark, rows, [role], "org1"))
    assert AO.rbac_apply(d, "drop").count() == allowed
    assert d.where(~F.col("allowed")).count() == blocked


def test_acl_exact_match_not_substring(spark):
    d = AO.rbac_decide(_pairs(spark, [("c1", "PUBLIC", "default", ["superadmin"])], ["admin"], "default"))
    r = d.collect()[0]
    assert (r.allowed, r.reason) == (False, "acl_role_mismatch")


def test_modes_never_return_cross_tenant(spark):
    rows = [("c1", "TOP_SECRET", "org1", []), ("c2", "PUBLIC", "org2", [])]
    d = AO.rbac_decide(_pairs(spark, rows, ["employee"], "org1"))
    red = {r.chunk_id: r.text for r in AO.rbac_apply(d, "redact").collect()}
    assert red == {"c1": "[REDACTED — INSUFFICIENT CLEARANCE]"}
    assert {r.chunk_id for r in AO.rbac_apply(d, "audit_only").collect()} == {"c1"}


def test_unknown_class_strict_denies(spark):
    df = spark.createDataFrame([("MYSTERY",)], "cls string")
    assert df.select(A.level_index("cls", strict=True)).first()[0] > 4
    assert df.select(A.level_index("cls", strict=False)).first()[0] == 0


def test_sessions(spark):
    from datetime import datetime
    sess = spark.createDataFrame([
        ("t_live", 1, datetime(2024, 1, 1, 1), None), ("t_rev", 1, datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 0, 10)),
        ("t_old", 1, datetime(2024, 1, 1, 0, 30), None)],
        "token_hash string, user_id long, expires_at timestamp, revoked_at timestamp")
    users = spark.createDataFrame([(1, "u", "admin", "t1")], "user_id long, username string, role string, tenant_id string")
    req = spark.createDataFrame([(1, "t_live", datetime(2024, 1, 1, 0, 45)), (2, "t_rev", datetime(2024, 1, 1, 0, 45)),
                                 (3, "t_old", datetime(2024, 1, 1, 0, 45)), (4, "nope", datetime(2024, 1, 1, 0, 45))],
                                "request_id long, token_hash string, at timestamp")
    got = {r.request_id: r.status for r in AO.resolve_sessions(req, sess, users).collect()}
    assert got == {1: "valid", 2: "invalid", 3: "expired", 4: "invalid"}


def test_signup_dedup(spark):
    existing = spark.createDataFrame([("alice",)], "username string")
    s = spark.createDataFrame([("r1", "alice", 1), ("r2", "bob", 2), ("r3", "bob", 3)],
                              "request_id string, username string, requested_at long")
    got = {r.request_id: r.accepted for r in AO.signup_dedup(s, existing).collect()}
    assert got == {"r1": False, "r2": True, "r3": False}


def test_validate_and_claims(spark):
    from docshield.operators import requests as RQ
    q = spark.createDataFrame([(1, 7, "tenant_3", "  ok query  ", 5), (2, 7, "bad tenant!", "hello", 5),
                               (3, 7, "t", "hi", 5), (4, 7, "t", "hello", 21)],
                              "query_id long, user_id long, tenant_id string, query string, top_k int")
    got = {r.query_id: r.reject_reason for r in RQ.validate_queries(q).collect()}
    assert got == {1: None, 2: "tenant_id", 3: "query_length", 4: "top_k"}
    p = spark.createDataFrame([(7, "tenant_3", ["employee"])], "user_id long, tenant_id string, roles array<string>")
    c = spark.createDataFrame([("a", 7, "tenant_3", ["employee"]), ("b", 7, "tenant_3", ["admin"]),
                               ("c", 7, "tenant_1", ["employee"]), ("d", 9, "tenant_3", [])],
                              "request_id string, user_id long, tenant_id string, roles array<string>")
    got = {r.request_id: r.reject_reason for r in RQ.check_claims(c, p).collect()}
    assert got == {"a": None, "b": "role_not_granted", "c": "tenant_mismatch", "d": "unknown_user"}


def test_gazetteer_join_and_flatten(spark):
    from docshield.functions.lists import flatten_schema
    from docshield.operators import requests as RQ
    d = spark.createDataFrame([("d1", "Met Alice Johnson and Bob Smith; Alice Johnson again.")], "doc_id string, text string")
    g = spark.createDataFrame([("Alice Johnson", "PERSON"), ("Bob Smith", "PERSON")], "name string, entity_type string")
    got = {(r.name, r.n) for r in RQ.gazetteer_join(d, g).collect()}
    assert got == {("Alice Johnson", 2), ("Bob Smith", 1)}
    text = "é Maria de la Cruz, Conor O'Brien, Ana. Li, Ana\nLi, xAna Li, Ana Li and Ana Li2"
    d = spark.createDataFrame([("d1", text), ("d2", None), ("d3", "")], "doc_id string, text string")
    g = spark.createDataFrame([(n, "PERSON") for n in ("Maria de la Cruz", "Conor O'Brien", "Ana Li", "...")], "name string, entity_type string")
    spans = RQ.gazetteer_spans(d, g).collect()
    assert sorted(r.name for r in spans) == ["Ana Li", "Conor O'Brien", "Maria de la Cruz"]
    assert all(text[r.start:r.end] == r.name for r in spans)
    assert RQ.gazetteer_join(d, g.where("false")).count() == 0
    df = spark.createDataFrame([(1, (2, (3,)))], "a int, b struct<c:int, d:struct<e:int>>")
    assert flatten_schema(df).columns == ["a", "b.c", "b.d.e"]


def test_merkle_root_detects_change(spark):
    from datetime import datetime, timedelta
    from docshield.operators.answers import merkle_roots
    rows = [("t", "2024-01-01", datetime(2024, 1, 1) + timedelta(minutes=i), f"id{i}", f"h{i}") for i in range(11)]
    schema = "tenant_id string, day string, timestamp timestamp, trace_id string, checksum string"
    a = merkle_roots(spark.createDataFrame(rows, schema)).first().root
    rows[5] = rows[5][:4] + ("tampered",)
    b = merkle_roots(spark.createDataFrame(rows, schema)).first().root
    assert a != b and len(a) == 64


def test_stale_hashes_tolerates_odd_values(spark):
    users = spark.createDataFrame([(1, "a", "pbkdf2_sha256$600000$s$h"), (2, "b", "plainhash"),
                                   (3, "c", "pbkdf2_sha256$1000$s$h"), (4, "d", "pbkdf2_sha256$x$s$h")],
                                  "user_id long, username string, password_hash string")
    assert sorted(r.user_id for r in AO.stale_hashes(users).collect()) == [2, 3, 4]


def test_list_metadata_recurses_into_json(spark):
    from docshield.functions import lists as L
    from docshield.plans.ingest_queries import LIST_ITEMS, LIST_SAMPLES
    df = spark.createDataFrame([(k, v) for k, v in enumerate(LIST_SAMPLES)], "k int, v string")
    assert [r.items for r in df.select("k", L.normalize_list("v").alias("items")).orderBy("k").collect()] == LIST_ITEMS


def test_rate_limit_key_precedence(spark):
    import hashlib
    from pyspark.sql import functions as F
    from docshield.operators import analytics as AN
    df = spark.createDataFrame([(1, "t", "ip"), (None, "t", "ip"), (None, "", "ip"), (None, None, "ip"), (None, None, None)], "u long, t string, ip string")
    got = [r[0] for r in df.coalesce(1).select(AN.rate_limit_key(F.col("u"), F.col("t"), F.col("ip"))).collect()]
    assert got == ["user:1", "session:" + hashlib.sha256(b"t").hexdigest(), "ip:ip", "ip:ip", "ip:None"]


def test_redaction_mode_hides_text_and_never_crosses_tenants(spark):
    from docshield import constants as C
    from docshield.operators import access as AO
    d = spark.createDataFrame([(1, "ok", True, "a"), (1, "clearance", False, "b"), (1, "tenant_boundary", False, "c")], "query_id long, reason string, allowed boolean, text string")
    texts = {m: sorted(r.text for r in AO.rbac_apply(d, m).collect()) for m in ("drop", "redact", "audit_only")}
    assert texts == {"drop": ["a"], "redact": sorted(["a", C.RBAC_REDACTED_TEXT]), "audit_only": ["a", "b"]}


def test_graph_keeps_edges_and_takes_the_latest_class(spark):
    """An edge outlives the chunk's ACL, a later registration raises the class, a moved document stays open to its old tenant."""
    from docshield.operators import access as AO
    from docshield.operators import retrieval as R
    reg = spark.createDataFrame([
        ("d1", "t", "PUBLIC", ["employee"], "s", 1), ("d1", "t", "PUBLIC", ["manager"], "s", 2),
        ("d2", "t", "PUBLIC", ["employee"], "s", 1), ("d2", "t", "TOP_SECRET", ["employee"], "s", 2),
        ("d3", "u", "PUBLIC", ["employee"], "s", 2), ("d3", "t", "PUBLIC", [None], "s", 1),
        ("d4", "u", "PUBLIC", ["employee"], "s", 1), ("d5", "t", "PUBLIC", [], "s", 1),
    ], "doc_id string, tenant_id string, sensitivity_class string, acl_roles array<string>, source string, registered_at int")
    g = {r["doc_id"]: r for r in AO.graph_profiles(reg).collect()}
    assert sorted(g) == ["d1", "d2", "d3", "d4"]
    assert g["d1"]["graph_roles"] == ["employee", "manager"] and g["d3"]["graph_tenants"] == ["t", "u"]
    assert g["d2"]["graph_level"] > g["d1"]["graph_level"]
    chunks = spark.createDataFrame([(f"{d}_0", d, "t", "a note", [1.0, 0.0], "PUBLIC", roles) for d, roles in [
        ("d1", ["manager"]), ("d2", ["employee"]), ("d3", ["employee"]), ("d4", ["employee"]), ("d6", ["employee"])]],
        "chunk_id string, doc_id string, tenant_id string, text string, embedding array<double>, sensitivity_class string, acl_roles array<string>")
    q = spark.createDataFrame([(1, "t", ["employee"], [1.0, 0.0])], "query_id long, tenant_id string, roles array<string>, qvec array<double>")
    by_graph = {r["doc_id"]: r["block_reason"] for r in R.retrieve_candidates(q, chunks, graph=AO.graph_profiles(reg)).collect()}
    assert by_graph == {"d1": "acl_role_mismatch", "d3": None}
    by_chunk = {r["doc_id"]: r["block_reason"] for r in R.retrieve_candidates(q, chunks).collect()}
    assert by_chunk == {"d2": None, "d3": None, "d4": None, "d6": None}

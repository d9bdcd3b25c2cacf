"""Registered ingest queries (S5, S6, P1–P6, P11, T3–T11) and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import lists as L
from docshield.functions import text as T
from docshield.operators import ingest as I
from docshield.oracle import sql as S
from docshield.oracle.fixtures import with_ctes
from docshield.sources import fixtures as FX

GAZ = {"PERSON": FX.PERSON_NAMES}
OVERSIZE_ROW = ("p10", C.MAX_INGEST_BYTES + 1)


def _docs(spark, sf):
    return FX.docs_raw(spark, sf)


def _scan(spark, sf, **kw):
    return I.scan_documents(_docs(spark, sf), person_names=FX.PERSON_NAMES, **kw)


def _clean(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.strip_zero_width("text").alias("clean_text"))


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def q_zero_width_clean(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    zw = T.zero_width_found("text")
    clean = T.strip_zero_width("text")
    return d.select("doc_id", F.size(zw).cast("bigint").alias("n_zero_width"),
                    F.array_join(F.transform(zw, lambda z: F.hex(F.encode(z, "UTF-16BE"))), ",").alias("zero_width_codes"),
                    F.length(clean).cast("bigint").alias("clean_length"),
                    F.sha2(clean, 256).alias("clean_sha"))


def q_hidden_instruction_scan(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.lower(T.strip_zero_width("text")).alias("low"))
    p = T.phrases_found("low", C.INGEST_PHRASES)
    return d.select("doc_id", F.array_join(p, "|").alias("phrases"),
                    F.arrays_overlap(p, F.array(*[F.lit(x) for x in C.MALICIOUS_PHRASES])).alias("malicious"))


def q_secret_scan(spark, sf):
    c = _clean(spark, sf).select("doc_id", T.secret_scan("clean_text", include_generic=True).alias("s"))
    e = c.select("doc_id", F.posexplode("s").alias("pos", "h"))
    return e.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("hit_no"), F.col("h.type").alias("type"),
                    F.col("h.preview").alias("preview"), F.col("h.start").cast("bigint").alias("start"),
                    F.col("h.end").cast("bigint").alias("end"))


def _span_rows(df, extra=()):
    e = df.select(*extra, "doc_id", F.explode("pii").alias("p"))
    return e.select(*extra, "doc_id", F.col("p.entity_type").alias("entity_type"),
                    F.col("p.start").cast("bigint").alias("start"), F.col("p.end").cast("bigint").alias("end"),
                    F.col("p.score").cast("double").alias("score"), F.col("p.severity").alias("severity"))


def q_pii_spans(spark, sf):
    c = _clean(spark, sf).select("doc_id", T.pii_spans("clean_text", gazetteer=GAZ).alias("pii"))
    return _span_rows(c)


def q_pii_compliance(spark, sf):
    c = _clean(spark, sf)
    parts = [c.select(F.lit(m).alias("mode"), "doc_id", T.pii_spans("clean_text", mode=m, gazetteer=GAZ).alias("pii"))
             for m in ("gdpr", "hipaa")]
    u = parts[0].unionByName(parts[1])
    return _span_rows(u, extra=("mode",)).drop("score")


def q_pii_severity(spark, sf):
    c = I.evaluate_once(_clean(spark, sf).select("doc_id", T.pii_spans("clean_text", gazetteer=GAZ).alias("pii")))
    c = c.where(F.size("pii") > 0)
    n = lambda s: F.size(F.filter("pii", lambda x: x["severity"] == s)).cast("bigint")
    return c.select("doc_id", F.size("pii").cast("bigint").alias("n_spans"),
                    F.exists("pii", lambda x: x["severity"] == "critical").alias("has_critical"),
                    n("critical").alias("n_critical"), n("high").alias("n_high"),
                    n("medium").alias("n_medium"), n("low").alias("n_low"))


def q_sensitivity_class(spark, sf):
    return _scan(spark, sf).select("doc_id", "sensitivity_class", "has_critical")


def q_quarantine_decision(spark, sf):
    s = _scan(spark, sf)
    return s.select("doc_id", (F.col("status") == "quarantined").alias("quarantined"),
                    F.coalesce("quarantine_reason", F.lit("")).alias("reason"))


def q_pii_redact(spark, sf):
    c = I.evaluate_once(_clean(spark, sf).select("doc_id", "clean_text",
                                                 T.pii_spans("clean_text", gazetteer=GAZ).alias("pii")))
    c = c.where(F.size("pii") > 0)
    return c.select("doc_id", F.size(T.merge_spans("pii")).cast("bigint").alias("n_components"),
                    T.redact("clean_text", "pii").alias("redacted"))


def q_ingest_scan(spark, sf):
    s = _scan(spark, sf)
    return s.select(
        "doc_id", "document_hash", "tenant_id", "source", "status", F.coalesce("reason", F.lit("")).alias("reason"),
        "sensitivity_class", F.array_join("pii_entities_found", ",").alias("pii_entities_found"),
        "text_modified", F.array_join("acl_roles", ",").alias("acl_roles"),
        F.col("length_bytes").cast("bigint").alias("length_bytes"),
        F.sha2("scrubbed_text", 256).alias("scrubbed_sha"))


def q_provenance(spark, sf):
    s = _scan(spark, sf)
    p = F.col("provenance")
    return s.select("doc_id", p["hash_sha256"].alias("hash_sha256"), p["length_bytes"].cast("bigint").alias("length_bytes"),
                    p["invisible_chars_detected"].alias("invisible_chars_detected"),
                    p["malicious_instructions_detected"].alias("malicious_instructions_detected"),
                    F.array_join(p["detected_issues"], "|").alias("detected_issues"))


def q_quarantine_log(spark, sf):
    ql = I.quarantine_log(_scan(spark, sf))
    return ql.select("doc_id", "tenant_id", "reason", F.array_join("pii_types", ",").alias("pii_types"),
                     "file_path", "source")


def q_size_gate(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    big = spark.range(1).select(F.lit(OVERSIZE_ROW[0]).alias("doc_id"),
                                F.repeat(F.lit("a"), OVERSIZE_ROW[1]).alias("text"))
    u = d.unionByName(big)
    n = F.octet_length("text")
    return u.select("doc_id", n.cast("bigint").alias("length_bytes"), (n <= C.MAX_INGEST_BYTES).alias("accepted"))


def q_acl_roles_norm(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.array_join(L.acl_roles_or_default("acl_roles"), ",").alias("acl_roles"))


LIST_SAMPLES = ['["employee", "manager"]', "employee, manager", None, "[bad", "  ", '[" a ", ""]', "x,,y",
                "null", '"a, b"', '"null"', '"[\\"q\\", \\"r\\"]"', "42", "true", "[1, true, null]", '" "', "nullable, 4x", '"open']
#: What these come to, item by item.
LIST_ITEMS = [["employee", "manager"], ["employee", "manager"], [], ["[bad"], [], ["a"], ["x", "y"],
              [], ["a", "b"], [], ["q", "r"], ["42"], ["True"], ["1", "True", "None"], [], ["nullable", "4x"], ['"open']]


def q_list_meta_norm(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("k"), F.col("acl_roles").alias("raw"))
    s = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(LIST_SAMPLES)], "k string, raw string")
    u = d.unionByName(s)
    n = L.normalize_list("raw")
    return u.select("k", F.array_join(n, "|").alias("items"), F.size(n).cast("bigint").alias("n_items"))


def q_doc_ids(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", L.short_doc_id("text").alias("content_id"))


def q_mask_secret(spark, sf):
    u = FX.users(spark, sf)
    return u.select("user_id", T.mask_secret("password_hash").alias("masked"),
                    T.mask_secret(F.substring("username", 1, 4)).alias("masked_short"))


QUERIES = {
    "zero_width_clean": q_zero_width_clean,
    "hidden_instruction_scan": q_hidden_instruction_scan,
    "secret_scan": q_secret_scan,
    "pii_spans": q_pii_spans,
    "pii_compliance": q_pii_compliance,
    "pii_severity": q_pii_severity,
    "sensitivity_class": q_sensitivity_class,
    "quarantine_decision": q_quarantine_decision,
    "pii_redact": q_pii_redact,
    "ingest_scan": q_ingest_scan,
    "provenance": q_provenance,
    "quarantine_log": q_quarantine_log,
    "size_gate": q_size_gate,
    "acl_roles_norm": q_acl_roles_norm,
    "list_meta_norm": q_list_meta_norm,
    "doc_ids": q_doc_ids,
    "mask_secret": q_mask_secret,
}


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

MAL = S.qlist(C.MALICIOUS_PHRASES)


def _clean_cte():
    return f"cl AS (SELECT doc_id, {S.strip_zw('text')} AS clean_text FROM docs_raw)"


def o_zero_width_clean():
    zw = S.zw_found("text")
    clean = S.strip_zw("text")
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, cast(len({zw}) AS BIGINT) AS n_zero_width,
               array_to_string(list_transform({zw}, lambda z: upper(printf('%04x', unicode(z)))), ',') AS zero_width_codes,
               cast(length({clean}) AS BIGINT) AS clean_length, sha256({clean}) AS clean_sha
        FROM docs_raw""")


def o_hidden_instruction_scan():
    p = S.phrases(f"lower({S.strip_zw('text')})", C.INGEST_PHRASES)
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, array_to_string({p}, '|') AS phrases, len(list_intersect({p}, {MAL})) > 0 AS malicious
        FROM docs_raw""")


def o_secret_scan():
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY pat_no, hit_no) AS BIGINT) AS hit_no,
               type, preview, cast(st AS BIGINT) AS start, cast(en AS BIGINT) AS "end"
        FROM ({S.secret_rows('cl', include_generic=True)})""", extra=_clean_cte())


def _spans_sql(mode="none", src="cl"):
    return S.pii_span_rows(src, mode=mode, gazetteer=GAZ)


def o_pii_spans():
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, entity_type, cast(st AS BIGINT) AS start, cast(en AS BIGINT) AS "end",
               cast(score AS DOUBLE) AS score, severity FROM ({_spans_sql()})""", extra=_clean_cte())


def o_pii_compliance():
    parts = [f"SELECT '{m}' AS mode, doc_id, entity_type, cast(st AS BIGINT) AS start, cast(en AS BIGINT) AS \"end\", severity "
             f"FROM ({_spans_sql(m)})" for m in ("gdpr", "hipaa")]
    return with_ctes(["docs_raw"], "\nUNION ALL\n".join(parts), extra=_clean_cte())


def o_pii_severity():
    n = lambda s: f"cast(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS n_{s}"
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, cast(count(*) AS BIGINT) AS n_spans, bool_or(severity = 'critical') AS has_critical,
               {n('critical')}, {n('high')}, {n('medium')}, {n('low')}
        FROM ({_spans_sql()}) GROUP BY doc_id""", extra=_clean_cte())


def _ingest_ctes() -> str:
    """CTE chain reproducing ``scan_documents`` over docs_raw."""
    return f"""
ing1 AS (
  SELECT doc_id, text, source, tenant_id, acl_roles AS acl_raw, ingested_at,
         sha256(text) AS document_hash, strlen(text) AS length_bytes,
         {S.zw_found('text')} AS zero_width, {S.strip_zw('text')} AS clean_text
  FROM docs_raw),
ing2 AS (SELECT *, {S.phrases('lower(clean_text)', C.INGEST_PHRASES)} AS phrases FROM ing1),
ing_sec AS ({S.secret_rows('ing2')}),
ing_secagg AS (SELECT doc_id, first(type ORDER BY pat_no, hit_no) AS first_type FROM ing_sec GROUP BY doc_id),
ing_pii AS ({S.pii_span_rows('ing2', gazetteer=GAZ, where='doc_id NOT IN (SELECT doc_id FROM ing_secagg)')}),
ing_piiagg AS (
  SELECT doc_id, bool_or(severity = 'critical') AS crit, bool_or(severity = 'high') AS high,
         list(entity_type ORDER BY st, en, entity_type) AS types
  FROM ing_pii GROUP BY doc_id),
{S.redaction_ctes('ing_pii', 'ing2', prefix='ing')},
ing3 AS (
  SELECT d.*, s.first_type, s.doc_id IS NOT NULL AS has_secret,
         len(list_intersect(d.phrases, {MAL})) > 0 AS malicious,
         coalesce(p.crit, false) AS crit, coalesce(p.high, false) AS high,
         coalesce(p.types, []::VARCHAR[]) AS types, coalesce(r.redacted, d.clean_text) AS redacted
  FROM ing2 d LEFT JOIN ing_secagg s USING (doc_id) LEFT JOIN ing_piiagg p USING (doc_id)
  LEFT JOIN ing_red r USING (doc_id)),
ing4 AS (
  SELECT *,
    CASE WHEN has_secret THEN first_type WHEN crit THEN 'critical_pii' WHEN malicious THEN 'prompt_injection' END AS qreason,
    CASE WHEN has_secret THEN 'TOP_SECRET' WHEN len(types) = 0 THEN 'PUBLIC' WHEN crit THEN 'RESTRICTED'
         WHEN high THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END AS sensitivity_class,
    has_secret OR crit AS has_critical,
    CASE WHEN malicious THEN '{C.INJECTION_QUARANTINE_PREFIX}' || array_to_string(phrases, ', ')
         WHEN has_secret THEN '{C.SECRETS_QUARANTINE_TEXT}' WHEN crit THEN '{C.CRITICAL_QUARANTINE_TEXT}'
         ELSE redacted END AS scrubbed_text,
    CASE WHEN malicious AND NOT has_secret AND len(types) = 0 THEN ['PROMPT_INJECTION'] ELSE types END AS pii_entities_found
  FROM ing3),
ing AS (
  SELECT *,
    CASE WHEN length_bytes > {C.MAX_INGEST_BYTES} THEN 'rejected' WHEN qreason IS NOT NULL THEN 'quarantined'
         WHEN NOT coalesce(regexp_matches(scrubbed_text, '\\S'), false) THEN 'skipped' ELSE 'ingested' END AS status,
    (qreason IS NOT NULL OR redacted <> clean_text) AS was_modified,
    {S.acl_or_default('acl_raw')} AS acl_roles
  FROM ing4),
ingx AS (
  SELECT *,
    CASE WHEN status = 'rejected' THEN 'payload_too_large' WHEN status = 'quarantined' THEN qreason
         WHEN status = 'skipped' THEN 'empty_after_scrub' END AS reason,
    was_modified OR len(zero_width) > 0 AS text_modified
  FROM ing)"""


def o_sensitivity_class():
    return with_ctes(["docs_raw"], "SELECT doc_id, sensitivity_class, has_critical FROM ingx", extra=_ingest_ctes())


def o_quarantine_decision():
    return with_ctes(["docs_raw"], "SELECT doc_id, status = 'quarantined' AS quarantined, coalesce(qreason, '') AS reason FROM ingx",
                     extra=_ingest_ctes())


def o_pii_redact():
    return with_ctes(["docs_raw"], "SELECT doc_id, cast(n_components AS BIGINT) AS n_components, redacted FROM r_red",
                     extra=_clean_cte() + ",\nsp AS (" + _spans_sql() + "),\n" + S.redaction_ctes("sp", "cl", prefix="r"))


def o_ingest_scan():
    return with_ctes(["docs_raw"], """
        SELECT doc_id, document_hash, tenant_id, source, status, coalesce(reason, '') AS reason, sensitivity_class,
               array_to_string(pii_entities_found, ',') AS pii_entities_found, text_modified,
               array_to_string(acl_roles, ',') AS acl_roles, cast(length_bytes AS BIGINT) AS length_bytes,
               sha256(scrubbed_text) AS scrubbed_sha
        FROM ingx""", extra=_ingest_ctes())


def o_provenance():
    return with_ctes(["docs_raw"], """
        SELECT doc_id, document_hash AS hash_sha256, cast(length_bytes AS BIGINT) AS length_bytes,
               len(zero_width) > 0 AS invisible_chars_detected, malicious AS malicious_instructions_detected,
               array_to_string(list_concat(phrases, list_transform(zero_width, lambda z: 'Invisible char: ' || z)), '|') AS detected_issues
        FROM ingx""", extra=_ingest_ctes())


def o_quarantine_log():
    return with_ctes(["docs_raw"], """
        SELECT doc_id, tenant_id, reason, array_to_string(pii_entities_found, ',') AS pii_types,
               './data/quarantine/' || doc_id || '_' || reason || '.enc' AS file_path, coalesce(source, 'unknown') AS source
        FROM ingx WHERE status = 'quarantined'""", extra=_ingest_ctes())


def o_size_gate():
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id, cast(strlen(text) AS BIGINT) AS length_bytes, strlen(text) <= {C.MAX_INGEST_BYTES} AS accepted
        FROM (SELECT doc_id, text FROM docs_raw UNION ALL SELECT '{OVERSIZE_ROW[0]}', repeat('a', {OVERSIZE_ROW[1]}))""")


def o_acl_roles_norm():
    return with_ctes(["docs_raw"], f"SELECT doc_id, array_to_string({S.acl_or_default('acl_roles')}, ',') AS acl_roles FROM docs_raw")


def o_list_meta_norm():
    vals = ", ".join(f"('s{i}', {S.q('|'.join(v))}, {len(v)})" for i, v in enumerate(LIST_ITEMS))
    n = S.normalize_list("acl_roles")
    return with_ctes(["docs_raw"], f"""
        SELECT doc_id AS k, array_to_string({n}, '|') AS items, cast(len({n}) AS BIGINT) AS n_items FROM docs_raw
        UNION ALL SELECT k, items, cast(n AS BIGINT) FROM (VALUES {vals}) v(k, items, n)""")


def o_doc_ids():
    return with_ctes(["docs_raw"], "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM docs_raw")


def o_mask_secret():
    m = lambda v: f"CASE WHEN length({v}) <= 4 THEN '***' ELSE substr({v}, 1, 4) || '***' END"
    return with_ctes(["users"], f"SELECT user_id, {m('password_hash')} AS masked, {m('substr(username, 1, 4)')} AS masked_short FROM users")


ORACLE = {
    "zero_width_clean": o_zero_width_clean,
    "hidden_instruction_scan": o_hidden_instruction_scan,
    "secret_scan": o_secret_scan,
    "pii_spans": o_pii_spans,
    "pii_compliance": o_pii_compliance,
    "pii_severity": o_pii_severity,
    "sensitivity_class": o_sensitivity_class,
    "quarantine_decision": o_quarantine_decision,
    "pii_redact": o_pii_redact,
    "ingest_scan": o_ingest_scan,
    "provenance": o_provenance,
    "quarantine_log": o_quarantine_log,
    "size_gate": o_size_gate,
    "acl_roles_norm": o_acl_roles_norm,
    "list_meta_norm": o_list_meta_norm,
    "doc_ids": o_doc_ids,
    "mask_secret": o_mask_secret,
}

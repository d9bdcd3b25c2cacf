"""Document ingest as one narrow projection chain.

``scan_documents`` adds the scan columns to a documents frame without any
shuffle: every column is a per-row expression, so on a cluster each task
scans its own parquet split.  The expensive PII extraction is staged in its
own projection so it is computed once and reused by the class, the
quarantine decision and the redaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import lists as L
from docshield.functions import text as T


def scan_documents(docs: DataFrame, *, on_critical: str = "quarantine", mode: str = "none",
                   entities=None, include_generic_secrets: bool = False,
                   person_names=None, max_bytes: int = C.MAX_INGEST_BYTES) -> DataFrame:
    """Scan raw documents.

    Input columns: ``doc_id`` (nullable), ``text``, ``tenant_id``,
    ``acl_roles`` (string or array), ``source``; others pass through.
    """
    if on_critical not in ("quarantine", "redact", "reject"):
        raise ValueError(f"on_critical must be quarantine|redact|reject, got {on_critical!r}")
    gaz = {"PERSON": list(person_names)} if person_names else None

    s1 = docs.select(
        "*",
        F.coalesce(F.col("doc_id"), L.short_doc_id("text")).alias("_doc_id"),
        L.acl_roles_or_default("acl_roles").alias("_acl"),
        F.octet_length("text").alias("length_bytes"),
        F.sha2(F.col("text"), 256).alias("document_hash"),
        T.zero_width_found("text").alias("zero_width"),
        # a text over the size limit is rejected and not searched
        F.when(F.octet_length("text") > max_bytes, F.lit("")).otherwise(T.strip_zero_width("text")).alias("clean_text"),
    ).drop("doc_id", "acl_roles").withColumnRenamed("_doc_id", "doc_id").withColumnRenamed("_acl", "acl_roles")

    s2 = s1.select(
        "*",
        T.phrases_found(F.lower("clean_text"), C.INGEST_PHRASES).alias("phrases"),
        T.secret_scan("clean_text", include_generic_secrets).alias("secrets"))

    # PII only runs when no secret was found: such documents are quarantined
    s3 = s2.select(
        "*",
        F.arrays_overlap("phrases", F.array(*[F.lit(p) for p in C.MALICIOUS_PHRASES])).alias("malicious"),
        F.when(F.size("secrets") == 0, T.pii_spans("clean_text", entities=entities, mode=mode, gazetteer=gaz))
         .otherwise(F.array().cast(T.SPAN_TYPE)).alias("pii"))

    has_secret = F.size("secrets") > 0
    pii_critical = F.exists("pii", lambda x: x["severity"] == "critical")
    critical_quarantine = pii_critical & F.lit(on_critical == "quarantine")
    reason = (F.when(has_secret, F.col("secrets")[0]["type"])
              .when(critical_quarantine, F.lit("critical_pii"))
              .when(F.col("malicious"), F.lit("prompt_injection")))
    s4 = s3.select(
        "*",
        (has_secret | pii_critical).alias("has_critical"),
        F.when(has_secret, F.lit("TOP_SECRET")).otherwise(T.severity_class("pii")).alias("sensitivity_class"),
        reason.alias("quarantine_reason"),
        T.redact("clean_text", "pii").alias("redacted"))

    scrubbed = (F.when(F.col("malicious"), F.concat(F.lit(C.INJECTION_QUARANTINE_PREFIX),
                                                   F.array_join("phrases", ", ")))
                .when(has_secret, F.lit(C.SECRETS_QUARANTINE_TEXT))
                .when(critical_quarantine, F.lit(C.CRITICAL_QUARANTINE_TEXT))
                .otherwise(F.col("redacted")))
    quarantined = F.col("quarantine_reason").isNotNull()
    was_modified = quarantined | (F.col("redacted") != F.col("clean_text"))
    too_big = F.col("length_bytes") > max_bytes
    status = (F.when(too_big, "rejected").when(quarantined, "quarantined")
              .when(F.coalesce(~F.col("scrubbed_text").rlike(r"\S"), F.lit(True)), "skipped").otherwise("ingested"))
    pii_types = F.transform("pii", lambda x: x["entity_type"])
    pii_types = F.when(F.col("malicious") & ~has_secret & (F.size("pii") == 0),
                       F.array(F.lit("PROMPT_INJECTION"))).otherwise(pii_types)
    out = s4.select("*", scrubbed.alias("scrubbed_text"), was_modified.alias("was_modified"),
                    pii_types.alias("pii_entities_found"))
    out = out.select(
        "*", status.alias("status"),
        F.when(too_big, F.lit("payload_too_large")).when(quarantined, F.col("quarantine_reason"))
         .when(status == "skipped", F.lit("empty_after_scrub")).alias("reason"),
        (F.col("was_modified") | (F.size("zero_width") > 0)).alias("text_modified"),
        F.struct(F.col("document_hash").alias("hash_sha256"), F.col("length_bytes").alias("length_bytes"),
                 (F.size("zero_width") > 0).alias("invisible_chars_detected"),
                 F.col("malicious").alias("malicious_instructions_detected"),
                 F.concat("phrases", F.transform("zero_width", lambda z: F.concat(F.lit("Invisible char: "), z)))
                 .alias("detected_issues")).alias("provenance"))
    return evaluate_once(out)


def evaluate_once(df: DataFrame) -> DataFrame:
    """Pin the scan columns behind a Generate node.

    Catalyst pushes a filter such as ``status = 'ingested'`` below a
    projection by inlining the aliased expression, which would run the whole
    PII extraction twice per row (once in the filter, once in the project).
    Filters cannot be pushed below a generator's output, so each row is
    scanned exactly once; the generator is a one-row inline, no shuffle.
    """
    cols = df.columns
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))


def ingest_log(scanned: DataFrame, chunk_count=None) -> DataFrame:
    """One row per document.  ``chunk_count`` is a per-row Column (the
    chunker's count for ``scrubbed_text``), so no join back to the scan is
    needed; without it the count is left null."""
    if isinstance(chunk_count, DataFrame):
        df = scanned.join(chunk_count, "doc_id", "left")
    else:
        df = scanned.withColumn("chunks_stored", chunk_count if chunk_count is not None
                                else F.lit(None).cast("bigint"))
    return df.select(
        F.sha2(F.concat_ws("|", F.lit("ingest"), "doc_id", "document_hash"), 256).alias("id"),
        "doc_id", "document_hash", "tenant_id", F.coalesce("source", F.lit("unknown")).alias("source"),
        "status", "reason",
        F.when(F.col("status") == "ingested", F.coalesce("chunks_stored", F.lit(0))).otherwise(F.lit(0))
         .cast("bigint").alias("chunks_stored"),
        "sensitivity_class",
        F.when(F.col("status") == "skipped", F.array().cast("array<string>"))
         .otherwise(F.col("pii_entities_found")).alias("pii_entities_found"),
        "text_modified", "acl_roles", "provenance", "ingested_at")


def quarantine_log(scanned: DataFrame, quarantine_dir: str = "./data/quarantine") -> DataFrame:
    """Quarantined documents, with the vault file name they would get."""
    q = scanned.where(F.col("status") == "quarantined")
    return q.select(
        F.sha2(F.concat_ws("|", F.lit("quarantine"), "doc_id", "document_hash"), 256).alias("id"),
        "doc_id", "tenant_id", F.col("reason"),
        F.col("pii_entities_found").alias("pii_types"),
        F.concat(F.lit(quarantine_dir.rstrip("/") + "/"), "doc_id", F.lit("_"), "reason", F.lit(".enc")).alias("file_path"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.col("ingested_at").alias("quarantined_at"))


def quarantine_vault(scanned: DataFrame, key: str | None) -> DataFrame:
    """AES-GCM encrypted payload per quarantined document.

    Without a key the raw text is never carried: only metadata rows are
    produced.  The key must be 16, 24 or 32 bytes.
    """
    q = scanned.where(F.col("status") == "quarantined")
    meta = [F.col("doc_id"), F.col("reason"),
            F.concat("doc_id", F.lit("_"), "reason", F.lit(".enc" if key else ".meta.json")).alias("file_name")]
    if not key:
        return q.select(*meta, F.lit(False).alias("encrypted"), F.lit(False).alias("raw_content_persisted"),
                        F.lit(None).cast("binary").alias("payload"))
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("quarantine key must be 16, 24 or 32 bytes")
    payload = F.to_json(F.struct(F.col("reason"), F.col("doc_id"), F.col("text")))
    return q.select(*meta, F.lit(True).alias("encrypted"), F.lit(True).alias("raw_content_persisted"),
                    F.aes_encrypt(payload, F.lit(key), F.lit("GCM")).alias("payload"))


def decrypt_vault(vault: DataFrame, key: str) -> DataFrame:
    return vault.select("doc_id", F.aes_decrypt("payload", F.lit(key), F.lit("GCM")).cast("string").alias("json"))

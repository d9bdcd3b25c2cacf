"""Answer-side checks and logs (O1–O3, T19, T20, H1–H4, S8–S10, E*).

Generated answers arrive as a table keyed by query id; everything here is a
per-row projection except the audit chain, which folds per (tenant, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.functions import text as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canary_found(text, tokens=C.CANARY_TOKENS) -> Column:
    """O1: configured tokens present (case-sensitive substring), list order."""
    t = _col(text)
    return F.filter(F.array(*[F.lit(x) for x in tokens]), lambda k: F.contains(t, k))


def canary_redact(text, found) -> Column:
    return F.aggregate(_col(found), _col(text), lambda acc, k: F.replace(acc, k, F.lit(C.CANARY_REDACTED)))


def sanitize(df: DataFrame, text_col: str, prefix: str, *, tokens=C.CANARY_TOKENS, rescrub: bool = True,
             person_names=None) -> DataFrame:
    """O1 + O2 on one text column.  Adds {prefix}_canaries, {prefix}_safe,
    {prefix}_pii_count and {prefix}_violations (JSON text)."""
    gaz = {"PERSON": list(person_names)} if person_names else None
    found = f"{prefix}_canaries"
    d = df.withColumn(found, canary_found(text_col, tokens))
    d = d.withColumn(f"{prefix}_c", canary_redact(text_col, found))
    if rescrub:
        d = d.withColumn(f"{prefix}_spans", T.pii_spans(f"{prefix}_c", gazetteer=gaz))
        d = d.withColumn(f"{prefix}_safe", T.redact(f"{prefix}_c", f"{prefix}_spans")) \
             .withColumn(f"{prefix}_pii_count", F.size(f"{prefix}_spans"))
    else:
        d = d.withColumn(f"{prefix}_safe", F.col(f"{prefix}_c")).withColumn(f"{prefix}_pii_count", F.lit(0))
    canary_v = F.when(F.size(found) > 0, F.concat(
        F.lit('{"type": "canary_leak", "tokens": ['),
        F.array_join(F.transform(found, lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ", "), F.lit("]}")))
    pii_v = F.when(F.col(f"{prefix}_pii_count") > 0, F.concat(
        F.lit('{"type": "output_pii", "count": '), F.col(f"{prefix}_pii_count").cast("string"), F.lit("}")))
    viol = F.concat(F.lit("["), F.concat_ws(", ", canary_v, pii_v), F.lit("]"))
    return d.withColumn(f"{prefix}_violations", viol).drop(f"{prefix}_c", f"{prefix}_spans")


def iso_utc(ts) -> Column:
    """Python ``datetime.isoformat()`` of an aware UTC timestamp."""
    t = _col(ts)
    micros = F.unix_micros(t) % 1000000
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")),
                    F.lit("+00:00"))


def audit_checksum(trace_id, user_id, audit_query, ts) -> Column:
    """H2 + H3: sha256(trace ‖ user ‖ sha256(query) ‖ isoformat(ts))."""
    return F.sha2(F.concat(_col(trace_id), _col(user_id).cast("string"), F.sha2(_col(audit_query), 256),
                           iso_utc(ts)), 256)


def verify_checksums(audit: DataFrame) -> DataFrame:
    """Rows whose stored checksum no longer matches their fields (tamper check)."""
    return audit.where(audit_checksum("trace_id", "user_id", "query", "timestamp") != F.col("checksum"))


MERKLE_DEPTH = 8


def merkle_roots(audit: DataFrame, group_cols=("tenant_id", "day"), depth: int = MERKLE_DEPTH) -> DataFrame:
    """H4: tamper-evident root per (tenant, day) as a hash-prefix Merkle tree.

    Leaves are the row checksums bucketed by their first ``depth`` hex
    digits; each level up groups by one digit less and hashes its (at most
    16) children in prefix order.  Adding, removing or changing any row
    changes the root.  No ordering window is needed, and every level is an
    aggregation whose groups are spread over many tasks even when one
    tenant-day holds most of the rows.
    """
    g = list(group_cols)

    def combine(children):
        parts = F.array_sort(F.collect_list(children))
        return F.sha2(F.array_join(F.transform(parts, lambda x: F.concat(x["p"], x["h"])), ""), 256)

    level = (audit.groupBy(*g, F.substring("checksum", 1, depth).alias("p"))
             .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("checksum")), ""), 256).alias("h")))
    for d in range(depth - 1, 0, -1):
        if d % 4 == 0:
            # cut the lineage into the shared checkpoint folder
            from docshield.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(level.sparkSession)
            level = level.checkpoint(eager=True)
        level = (level.groupBy(*g, F.substring("p", 1, d).alias("np"))
                 .agg(combine(F.struct("p", "h")).alias("h")).withColumnRenamed("np", "p"))
    return level.groupBy(*g).agg(combine(F.struct("p", "h")).alias("root"))


def grounding(response, context) -> Column:
    return T.grounding_risk(response, context)

"""Chunkers (X1, P7, S4, UD2).

``fixed_chunks`` is pure SQL (sequence + substring), so it stays in the JVM
and has a DuckDB oracle.  ``recursive_chunks`` reproduces the recursive
separator splitter (paragraph, line, sentence, word, character) with size
and overlap; it runs as an Arrow-batched pandas UDF because the greedy
merge-with-overlap is a sequential per-text loop.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.functions import pandas_udf

from docshield import constants as C


def fixed_windows(text, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """array<string> of windows of ``size`` chars starting every size-overlap."""
    t = F.col(text) if isinstance(text, str) else text
    step = size - overlap
    n = F.greatest(F.ceil((F.length(t) - overlap) / F.lit(step)), F.lit(1)).cast("int")
    return F.when(t.rlike(r"\S"), F.transform(F.sequence(F.lit(0), n - 1),
                                               lambda i: F.substring(t, i * step + 1, F.lit(size)))) \
        .otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------------------
# recursive splitter (plain Python, used inside the pandas UDF)
# ---------------------------------------------------------------------------

def _split_keep(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def _merge(splits: list[str], size: int, overlap: int) -> list[str]:
    docs, cur, total = [], [], 0
    for s in splits:
        n = len(s)
        if total + n > size and cur:
            doc = "".join(cur).strip()
            if doc:
                docs.append(doc)
            while total > overlap or (total + n > size and total > 0):
                total -= len(cur[0])
                cur.pop(0)
        cur.append(s)
        total += n
    doc = "".join(cur).strip()
    if doc:
        docs.append(doc)
    return docs


def split_text(text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
               separators=tuple(C.CHUNK_SEPARATORS)) -> list[str]:
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    sep, rest = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "":
            sep, rest = s, ()
            break
        if s in text:
            sep, rest = s, tuple(separators[i + 1:])
            break
    out, good = [], []
    for piece in _split_keep(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, size, overlap))
            good = []
        if rest:
            out.extend(split_text(piece, size, overlap, rest))
        else:
            out.append(piece)
    if good:
        out.extend(_merge(good, size, overlap))
    return out


def recursive_chunks_udf(size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP):
    @pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if isinstance(t, str) else [])
    return chunk


def chunk_rows(df: DataFrame, text_col: str, method: str = "recursive", size: int = C.CHUNK_SIZE,
               overlap: int = C.CHUNK_OVERLAP, keep=("doc_id",)) -> DataFrame:
    """One row per chunk: keep-columns, chunk_index, chunk_text."""
    arr = recursive_chunks_udf(size, overlap)(F.col(text_col)) if method == "recursive" \
        else fixed_windows(text_col, size, overlap)
    return df.select(*keep, F.posexplode(arr).alias("chunk_index", "chunk_text"))


def chunk_table(scanned: DataFrame, method: str = "recursive") -> DataFrame:
    """S4 + P7: chunks of every ingested document with inherited metadata."""
    ing = scanned.where(F.col("status") == "ingested")
    rows = chunk_rows(ing, "scrubbed_text", method,
                      keep=("doc_id", "tenant_id", "sensitivity_class", "acl_roles", "pii_entities_found",
                            "was_modified", "source"))
    return rows.select(
        F.concat("doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "chunk_index", F.col("chunk_text").alias("text"), "tenant_id", "sensitivity_class",
        F.col("pii_entities_found").alias("pii_found"), "acl_roles", F.col("was_modified").alias("pii_redacted"),
        "source")


def chunk_count(method: str = "recursive", text: str = "scrubbed_text") -> Column:
    """Number of chunks the chunker makes of ``text`` (a per-row Column)."""
    if method == "fixed":
        return F.size(fixed_windows(text)).cast("bigint")
    return F.size(recursive_chunks_udf()(F.col(text))).cast("bigint")


def write_chunk_table(chunks: DataFrame, path: str, batch_id: str) -> None:
    """Sink: parquet partitioned by tenant and batch.  A new batch is added to what its tenants have;
    re-running a batch replaces only its own rows (dynamic partition overwrite), so a retried job does
    not duplicate chunks."""
    chunks.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("tenant_id", "batch_id").parquet(path)


def read_chunk_table(spark, path: str, schema) -> DataFrame:
    """The chunk table with the types it was written with (a tenant ``007`` stays text), without the batch."""
    schema = StructType([*schema.fields, StructField("batch_id", StringType())])
    return spark.read.schema(schema).parquet(path).drop("batch_id")


def register_chunk_udtf(spark) -> None:
    """UD2: ``SELECT ... FROM t, LATERAL chunk_text(t.text, 512, 64)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, chunk string")
    class ChunkText:
        def eval(self, text, size, overlap):
            if text is None:
                return
            for i, c in enumerate(split_text(text, int(size), int(overlap))):
                yield i, c

    spark.udtf.register("chunk_text", ChunkText)

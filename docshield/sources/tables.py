"""Readers for the input tables.

Every reader returns a lazy DataFrame over parquet so that Catalyst can push
filters and prune columns into the scan.  ``events.ts`` is stored as
TIMESTAMP_NTZ; it is cast to TIMESTAMP (session tz is UTC) so watermarks and
interval arithmetic work on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        read(spark, sf_dir, t).createOrReplaceTempView(t)

"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "docshield") -> SparkSession:
    """Session with the settings every operator assumes (UTC, AQE, Arrow).

    On a cluster, call with ``master=None`` and let spark-submit decide; the
    shuffle partition count then stays whatever the cluster config says.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.redaction.string.regex", "(?i)aes_(en|de)crypt\\([^)]*\\)"))
    if partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("DOCSHIELD_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without it (a temporary folder is used then): on a cluster each
    executor would write to a disk of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(spark.sparkContext.applicationId)
    if not d:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = _LOCAL_DIRS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="docshield-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docshield`` importable in the Python workers.

    pandas UDFs, ``mapInPandas``, the UDTF and the streaming state functions
    run in worker processes that only see what Spark ships to them, so the
    package is zipped once per SparkContext and added with ``addPyFile``
    (Spark distributes it to every executor).
    """
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="docshield-pyfiles-"), "docshield.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for fn in files:
                if fn.endswith(".py"):
                    full = os.path.join(base, fn)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)

"""File source and sinks.

Scratch output goes under the shared folder named by ``spark.checkpoint.dir``
(set by the cluster); nothing is written to a machine-local temp folder.
"""

from __future__ import annotations

import contextlib
import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/docshield-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later reads see the same rows, and the lineage ends in files."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of files and files that a task of the file source hands on together, about.
READ_BYTES = 4 << 20
READ_FILES = 1000


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's file sources pass over."""
    return (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")) and not (folder and name.startswith(("_common_metadata", "_metadata")))


def _entries(fs: pafs.FileSystem, at: str):
    """(path, is a folder, length) of what lies in the folder ``at``; a local folder is read as it is listed, however much lies in it."""
    if fs.type_name == "local":
        with os.scandir(at) as found:
            for x in found:
                with contextlib.suppress(FileNotFoundError):  # a link to nowhere
                    if not _hidden(x.name, folder := x.is_dir()):
                        yield x.path, folder, 0 if folder else x.stat().st_size
        return
    for x in fs.get_file_info(pafs.FileSelector(at)):
        if not _hidden(x.base_name, folder := x.type == pafs.FileType.Directory):
            yield x.path, folder, x.size or 0


LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64())])


def _listed(uri: str):
    """mapInArrow body: what lies in the folders given."""
    def run(batches):
        fs, held = pafs.FileSystem.from_uri(uri)[0], []
        for b in batches:
            for folder in b.column("path").to_pylist():
                for x in _entries(fs, folder):
                    held.append(x)
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held))), schema=LISTED)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held))), schema=LISTED)
    return run


def _name():
    return F.element_at(F.split("path", r"[/\\]"), -1)


def _allowed(extensions):
    return F.exists(F.array(*[F.lit(e) for e in extensions]), lambda e: F.lower(_name()).endswith(e))


def _opened(spark: SparkSession, path: str, max_bytes: int, extensions) -> DataFrame:
    """path, length and content of every file under ``path``; content may be null where the rules reject a file by its name or length."""
    def by_spark():
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")

    if any(c in path for c in "*?{}[]\\"):
        return by_spark()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if not _folders_by_arrow(uri):
        return by_spark()
    fs, root = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return by_spark()
    before = uri[:-len(root)] if uri.endswith(root) else None
    if before is None:  # Arrow names it otherwise
        return by_spark()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = cut(folders.mapInArrow(_listed(uri), "path string, folder boolean, length long"))
        own = level.where("NOT folder AND length > 0").select("path", "length")
        files = own if files is None else files.unionByName(own)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(tasks, "path")

    def read(batches):
        fs, held, n = pafs.FileSystem.from_uri(uri)[0], [], 0
        for b in batches:
            for x, length, wanted in zip(*(b.column(n).to_pylist() for n in ("path", "length", "wanted"))):
                content = None
                if wanted:
                    with fs.open_input_stream(x) as f:
                        content = f.read()
                held.append((before + x, length, content))
                n += len(content or b"")
                if n >= READ_BYTES or len(held) >= READ_FILES:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), READ.types)), schema=READ)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), READ.types)), schema=READ)

    files = files.select("path", "length", (_allowed(extensions) & (F.col("length") <= max_bytes)).alias("wanted"))
    return files.repartition(tasks, "path").mapInArrow(read, "path string, length long, content binary")


READ = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def read_document_files(spark: SparkSession, path: str, max_bytes: int = C.MAX_INGEST_BYTES,
                        extensions=tuple(C.ALLOWED_EXTENSIONS)) -> DataFrame:
    """Every file under ``path`` with an accept/reject decision.

    Reject reasons follow the upload rules: 415 (extension), 413 (size),
    400 (nothing but white space).  Content is decoded as UTF-8 with
    replacement; the size gate uses the file length, so rejected files'
    bytes are never decoded.  Spark's file sources list no file of zero bytes,
    so such a file has no row.

    Spark lists all files on the driver, some kB for each.  So the folders are listed in tasks, a level of the tree at a time,
    wherever Arrow knows the file system; elsewhere, and for patterns, Spark lists.
    """
    f = _opened(spark, path, max_bytes, extensions)
    ext_ok = _allowed(extensions)
    # UTF-8 with replacement: invalid byte sequences become U+FFFD instead of failing
    text = F.call_function("make_valid_utf8", F.col("content").cast("string"))
    reason = (F.when(~ext_ok, F.lit(415)).when(F.col("length") > max_bytes, F.lit(413))
              .when(~text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(400)))
    out = f.select("path", _name().alias("source"), "length", reason.alias("reject_code"),
                   F.when(reason.isNull(), text).alias("text"))
    return out.withColumn("accepted", F.col("reject_code").isNull())


def _folder_value(value) -> str:
    """``value`` as Spark names a partition's folder."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\x7f\"#%'*/:=?\\{[]^" else c for c in str(value))


def _folders_by_arrow(path: str) -> bool:
    """Whether Arrow can write to the file system of ``path``."""
    try:
        pafs.FileSystem.from_uri(path)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def write_documents_as_files(docs: DataFrame, path: str) -> None:
    """Lay a documents table out as one text file per document (used to
    feed the file source from the given tables): rows of a doc_id are the lines of one file in the folder ``doc_id=<id>``,
    which lies in a folder of the task that wrote it, so no folder grows with the table alone.

    The tasks write the files by Arrow's file systems: Spark's writer takes 22 ms for each file of a local folder
    (a process for its permissions), and renames every folder on the driver.  A file is moved to its name when it is
    whole, so a task that is tried again changes nothing.  Where Arrow knows no such file system, Spark writes."""
    rows = docs.select("doc_id", "text").repartition("doc_id")
    if not _folders_by_arrow(path):
        rows.write.mode("overwrite").partitionBy("doc_id").text(path)
        return
    rows.limit(0).select("text").write.mode("overwrite").text(path)  # an empty folder

    def lay(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        out, at, n = None, None, 0
        part = f"part-{TaskContext.get().partitionId():05d}"
        name = f"{part}.txt"

        def close():
            if out is not None:
                out.close()
                fs.move(f"{at}/_{name}", f"{at}/{name}")

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                to = f"{root}/{part}/doc_id={_folder_value(doc_id)}"
                if to != at:
                    close()
                    at, n = to, n + 1
                    fs.create_dir(at)
                    out = fs.open_output_stream(f"{at}/_{name}")
                out.write((text.as_py() or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text")).sortWithinPartitions("doc_id")
    rows.mapInArrow(lay, "files long").write.format("noop").mode("overwrite").save()


def export_json(df: DataFrame, path: str) -> None:
    """Events export as JSON lines."""
    df.write.mode("overwrite").json(path)


def canary_chunks(tokens=C.CANARY_TOKENS, tenant: str = "system") -> list[tuple]:
    """One RESTRICTED chunk per canary token (tenant ``system``, role admin)."""
    import hashlib
    return [(f"canary_{hashlib.sha256(t.encode()).hexdigest()[:12]}", f"canary_doc_{i}", tenant,
             f"Internal reference code {t}. Do not disclose.", "RESTRICTED", ["admin"])
            for i, t in enumerate(tokens)]


def seed_canaries(spark: SparkSession, chunks: DataFrame, tokens=C.CANARY_TOKENS) -> DataFrame:
    rows = spark.createDataFrame(canary_chunks(tokens), "chunk_id string, doc_id string, tenant_id string, "
                                                        "text string, sensitivity_class string, acl_roles array<string>")
    return chunks.unionByName(rows, allowMissingColumns=True)

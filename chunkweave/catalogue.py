"""Repositories indexed into a store: one folder of chunks and one of files each."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import text as T
from chunkweave.operators.chunkers import chunk_files
from chunkweave.operators.chunkers.base import Config
from chunkweave.operators.chunkers.engine import without_errors
from chunkweave.operators.search import keyword_score
from chunkweave.sources import files as S


def repository_name(path_or_url: str) -> str:
    """The last part of a path or url, without `.git`."""
    return re.sub(r"\.git$", "", path_or_url.rstrip("/").rsplit("/", 1)[-1]) or "repository"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clone(url: str) -> str:
    """A shallow copy of a git repository in a new folder of this machine; the caller deletes it."""
    folder = tempfile.mkdtemp(prefix="chunkweave-clone-")
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, folder], check=True, capture_output=True)
    return folder


def index(spark: SparkSession, path_or_url: str, store: str, name: str | None = None, force: bool = False, cfg: Config = Config()) -> str:
    """Chunks a folder, or a git repository given by its url, into the store; its name there.

    A name that is in the store already is left as it is, unless `force`.  Files
    that fail leave an `error` row and the rest goes on.  A cloned copy lives on
    the driver's machine, so a url can be indexed by a local session only.
    """
    name = name or repository_name(path_or_url)
    if exists(spark, f"{store}/{name}/chunks") and not force:
        return name
    remote = re.match(r"(https?|ssh|git|file)://|git@", path_or_url) is not None and not path_or_url.startswith("file:///") or path_or_url.endswith(".git")
    if remote and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("clone the repository to a folder that all executors share, and index that")
    root = clone(path_or_url) if remote else path_or_url
    try:
        files = S.decode(S.scan(spark, root)).withColumn("file_path", F.regexp_replace("file_path", f"^{re.escape(root.rstrip('/'))}/", ""))
        S.file_info(files).write.mode("overwrite").parquet(f"{store}/{name}/files")
        chunk_files(files.select("file_path", "content"), cfg).write.mode("overwrite").parquet(f"{store}/{name}/chunks")
    finally:
        if remote:
            shutil.rmtree(root, ignore_errors=True)
    return name


def repositories(spark: SparkSession, store: str) -> list[str]:
    """Names in the store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _all(spark: SparkSession, store: str, part: str, name: str | None) -> DataFrame | None:
    out = None
    for n in [name] if name else repositories(spark, store):
        own = spark.read.parquet(f"{store}/{n}/{part}").withColumn("repository", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def search(spark: SparkSession, store: str, query: str, name: str | None = None, limit: int = 10) -> DataFrame | None:
    """The best chunks for the words of a query; None where nothing is indexed."""
    chunks = _all(spark, store, "chunks", name)
    if chunks is None:
        return None
    text = F.concat_ws("\n", "identifier", "content", F.array_join("tags", " "))
    found = without_errors(chunks).withColumn("score", keyword_score(text, query) * (0.7 + 0.3 * F.col("importance"))).filter("score > 0")
    return found.orderBy(F.desc("score"), "repository", "chunk_id").limit(limit).select("repository", "file_path", "start_line", "end_line", "chunk_type", "identifier", F.round("score", 4).alias("score"), T.preview(F.col("content")).alias("preview"))


def status(spark: SparkSession, store: str) -> DataFrame | None:
    """repository, files, bytes, lines, chunks, errors, mean_importance, complex_share."""
    files, chunks = _all(spark, store, "files", None), _all(spark, store, "chunks", None)
    if files is None or chunks is None:
        return None
    f = files.groupBy("repository").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"))
    bad = F.col("chunk_type") == "error"
    paths = F.try_to_number(F.col("metadata")["cyclomatic"], F.lit("999999"))
    c = chunks.groupBy("repository").agg(
        F.sum((~bad).cast("long")).alias("chunks"), F.sum(bad.cast("long")).alias("errors"), F.avg(F.when(~bad, F.col("importance"))).alias("mean_importance"), F.avg(F.when(~bad, (F.coalesce(paths, F.lit(0)) > 10).cast("double"))).alias("complex_share")
    )
    return f.join(c, "repository", "left").orderBy("repository")


def extensions(spark: SparkSession, store: str) -> DataFrame | None:
    """repository, extension, files, share: most frequent first."""
    files = _all(spark, store, "files", None)
    if files is None:
        return None
    n = files.groupBy("repository", "extension").agg(F.count(F.lit(1)).alias("files"))
    total = n.groupBy("repository").agg(F.sum("files").alias("all"))
    return n.join(total, "repository").select("repository", "extension", "files", (F.col("files") / F.col("all")).alias("share")).orderBy("repository", F.desc("files"), "extension")


def monitor(spark: SparkSession, root: str, store: str, name: str | None = None, checkpoint: str | None = None):
    """A streaming query that chunks each new file of a folder into the store's chunks; the caller stops it."""
    name = name or repository_name(root)
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    files = S.decode(raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("file_path"), "content")).select("file_path", "content")
    files = files.filter(~S.path_ignored(F.col("file_path"), S.IGNORED))
    return chunk_files(files).writeStream.format("parquet").option("path", f"{store}/{name}/chunks").option("checkpointLocation", checkpoint or f"{store}/{name}/progress").start()

"""Directory scans, JSON-lines stores and retained raw outputs."""

from __future__ import annotations

import fnmatch
import re
import subprocess
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Folders and files that a scan leaves out.
SKIP_FOLDERS = [".git", ".hg", ".svn", ".jj", "node_modules", "target", "build", "dist", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".idea", ".vscode", ".next", ".nuxt", ".turbo", ".cache", "vendor", "Pods", "DerivedData"]
SKIP_FILES = ["Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "go.sum"]


def listing(spark: SparkSession, root: str, extensions: list[str] | None = None, max_bytes: int = 1 << 20) -> DataFrame:
    """path (below root), size, modified: the content is never read. Spark leaves hidden files out."""
    return _below(spark, root, extensions, max_bytes).select("path", "size", "modified")


def _inside(root: str) -> Column:
    """The part of a file's path that is below root."""
    return F.regexp_replace("path", rf"^.*?{re.escape(root.rstrip('/').removeprefix('file://'))}/", "")


def _below(spark: SparkSession, root: str, extensions: list[str] | None, max_bytes: int) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    x = raw.select(F.col("path").alias("uri"), _inside(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    folders = "|".join(re.escape(f) for f in SKIP_FOLDERS)
    x = x.where(~F.col("path").rlike(rf"(^|/)({folders})/") & ~F.element_at(F.split("path", "/"), -1).isin(SKIP_FILES))
    return x if extensions is None else x.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([e.lower() for e in extensions]))


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, max_files: int = 5000, max_bytes: int = 1 << 20, tracked: bool = False) -> DataFrame:
    """path, size, modified, content (text) of at most ``max_files`` files, the first by path.

    ``tracked`` keeps files that git lists; else patterns of the root's .gitignore are left out.
    """
    x = _below(spark, root, extensions, max_bytes)
    local = root.removeprefix("file://")
    if tracked:
        x = x.join(spark.createDataFrame([(p,) for p in git_files(local)], "path string"), "path", "left_semi")
    else:
        for p in ignore_patterns(local):
            x = x.where(~F.col("path").rlike(p))
    # Which files are taken, ``max_files`` at most, is decided on the listing; only they are read.
    chosen = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["uri"]) for r in x.orderBy("path").limit(max_files).select("uri").collect()]
    if not chosen:
        return x.drop("uri").limit(0).withColumn("content", F.lit(None).cast("string"))
    read = spark.read.format("binaryFile").load(chosen)
    return read.select(_inside(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content")).orderBy("path")


def git_files(root: str) -> list[str]:
    """Files that git tracks, or none where there is no repository."""
    r = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, check=False)
    return [p for p in r.stdout.decode(errors="replace").split("\0") if p] if r.returncode == 0 else []


def ignore_patterns(root: str) -> list[str]:
    """Regular expressions for the plain patterns of .gitignore (no negation)."""
    path = Path(root, ".gitignore")
    out = []
    for line in path.read_text().splitlines() if path.exists() else []:
        line = line.strip()
        if line and not line.startswith(("#", "!")):
            body = fnmatch.translate(line.strip("/")).removesuffix(r"\Z").removesuffix(r"\z").removeprefix("(?s:").removesuffix(")").replace(".*", "[^/]*")
            out.append(("^" if "/" in line.rstrip("/") else "(^|/)") + body + "(/|$)")
    return out


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines store; lines that can't be parsed are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def insert(spark: SparkSession, path: str, rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Appends rows whose key is not in the store yet, once each; returns what was appended."""
    fresh = rows.dropDuplicates([key])
    try:
        fresh = fresh.join(read_store(spark, path, schema).select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a store that doesn't exist yet
            raise
    fresh.write.mode("append").json(path)
    return fresh


def clear(spark: SparkSession, path: str) -> None:
    """Empties a store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def retained(outputs: DataFrame, by: str, newest: str, keep: int) -> DataFrame:
    """The newest ``keep`` raw outputs of each key; of equally new ones those with the least hash."""
    w = Window.partitionBy(by).orderBy(F.col(newest).desc(), F.xxhash64(*outputs.columns))
    return outputs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def with_state(files: DataFrame) -> DataFrame:
    """Adds content_hash and line_hashes."""
    return files.withColumn("content_hash", T.content_hash("content")).withColumn("line_hashes", T.line_hashes("content"))

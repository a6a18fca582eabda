"""Files as a DataFrame: file_id, path, language, line_count, byte_size, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import constants as K
from stratalens.functions import paths
from stratalens.operators import index


def files(rows: DataFrame, path: Column, content: Column, file_id: Column, language: Column | None = None) -> DataFrame:
    out = rows.select(file_id.alias("file_id"), path.alias("path"), (paths.language(path) if language is None else language).alias("language"), F.coalesce(content, F.lit("")).alias("content"))
    return out.withColumn("line_count", F.size(F.split("content", "\n"))).withColumn("byte_size", F.octet_length("content").cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return files(d, F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))), F.col("text"), F.col("doc_id"), F.col("lang"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return files(d, F.regexp_replace("url", r"^[a-z]+://", ""), F.col("html"), F.col("page_id"), F.lit("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return files(d, F.concat_ws("/", "conv_id", "turn"), F.col("text"), F.col("conv_id") * 1000 + F.col("turn"), F.col("role"))


def directory(spark: SparkSession, root: str, patterns: list[str] = (), max_files: int = K.MAX_FILES, max_bytes: int = K.MAX_BYTES, max_file: int = K.MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """(files, listing) of a source tree, but for names that start with a dot or underscore, which Spark's readers pass over. listing: path, mtime, length, and whether the caps leave the file out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_extract("path", r"^(?:file:)?/*(/.*)$", 1), "^" + root.rstrip("/") + "/", "")
    rows = raw.withColumn("rel", rel).where(~paths.ignored(F.col("rel"), patterns) & (paths.language(F.col("rel")) != "unknown") & (F.col("length") <= max_file))
    # caps need a running sum in one order: over names and sizes alone, not contents
    listing = index.running(rows.select("rel", "modificationTime", "length"), ["rel"], "n", {"bytes": "length"})
    listing = listing.select(F.col("rel").alias("path"), F.col("modificationTime").alias("mtime"), "length", ((F.col("n") > max_files) | (F.col("bytes") > max_bytes)).alias("capped"), F.col("n").alias("file_id"))
    kept = listing.where("NOT capped").select(F.col("path").alias("p"), "file_id", "mtime")
    rows = rows.join(kept, F.col("rel") == F.col("p"))
    return files(rows, F.col("rel"), F.decode("content", "UTF-8"), F.col("file_id")), listing


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """The root's ignore file, one small text; by the file system, as Spark's readers pass over hidden names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [p for line in text.split("\n") if (p := line.strip().rstrip("/")) and p[0] not in "#!"]


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compares listings (path, mtime, length): unchanged, changed, added or removed for each path."""
    a, b = old.select("path", F.struct("mtime", "length").alias("was")), new.select("path", F.struct("mtime", "length").alias("is"))
    j = a.join(b, "path", "full_outer")
    what = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return j.select("path", what.alias("change"))

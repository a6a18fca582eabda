"""Snapshots: versioned Parquet directories with a pointer that is moved last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, EXTRACTOR = 4, 2


def save(root: str, workspace: str, tables: dict[str, DataFrame]) -> int:
    """Writes the tables as a new version; readers see it once its meta row is there."""
    spark = next(iter(tables.values())).sparkSession
    try:
        number = (spark.read.parquet(f"{root}/meta").agg(F.max("number")).first()[0] or 0) + 1
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        number = 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{number}/{name}")
    n_files = tables["files"].count() if "files" in tables else 0
    meta = spark.createDataFrame([(number, VERSION, EXTRACTOR, workspace, n_files)], "number int, version int, extractor int, workspace string, file_count long")
    meta.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/meta")
    return number


def load(spark: SparkSession, root: str, workspace: str) -> dict[str, DataFrame] | None:
    """The newest version, or None where version, extractor or workspace differ."""
    top = spark.read.parquet(f"{root}/meta").orderBy(F.desc("number")).first()
    if top is None or (top["version"], top["extractor"], top["workspace"]) != (VERSION, EXTRACTOR, workspace):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{top['number']}")
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return {n: spark.read.parquet(f"{root}/v{top['number']}/{n}") for n in names}

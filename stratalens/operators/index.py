"""Lines, postings, and how they follow changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import text


def lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", "language", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("file_id", "path", "language", (F.col("i") + 1).alias("line_no"), "line")


def posted(files: DataFrame, most_bytes: int | None) -> DataFrame:
    """Files that get postings: all, or those of most_bytes at most (the reference's gate is K.POSTING_BYTES)."""
    return files if most_bytes is None else files.where(F.col("byte_size") <= most_bytes)


def _trigrams(content: pa.Array, step: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, trigram as 63 bits), distinct: each three characters that stand in one line. About `step` bytes at a time."""
    size = np.asarray(content.value_lengths().fill_null(0)) if hasattr(content, "value_lengths") else np.array([len(x.as_py() or "") for x in content])
    run = (np.cumsum(size, dtype=np.int64) - 1).clip(0) // step
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(content)] if len(content) else []
    for a, b in zip(edges, edges[1:]):
        texts = [x or "" for x in content[a:b].to_numpy(zero_copy_only=False)]
        code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)  # no trigram goes over a line feed
        row = np.repeat(np.arange(a, b), np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))[: len(code)]
        line = code != 10
        at = np.flatnonzero(line[:-2] & line[1:-1] & line[2:]) if len(code) > 2 else np.zeros(0, np.int64)
        gram = code[at] << np.uint64(42) | code[at + 1] << np.uint64(21) | code[at + 2]
        row = row[at]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])) if len(row) else np.zeros(0, bool)
        yield row[new], gram[new]


def _spelled(gram: np.ndarray) -> pa.Array:
    """The trigrams' text; each distinct one is spelled once."""
    own, where = np.unique(gram, return_inverse=True)
    codes = np.stack([own >> np.uint64(42), own >> np.uint64(21) & np.uint64(0x1FFFFF), own & np.uint64(0x1FFFFF)], 1).astype("<u4")
    every = codes.tobytes().decode("utf-32-le")
    return pa.array([every[i : i + 3] for i in range(0, len(every), 3)], pa.string()).take(pa.array(where))


def trigram_postings(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """(file_id, trigram), one per file. Distinct within each file before any shuffle, as a file is one row."""
    rows = posted(files, most_bytes).select("file_id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, gram in _trigrams(b.column("content")):
                for i in range(0, len(row), 200_000):
                    yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(row[i : i + 200_000])), _spelled(gram[i : i + 200_000])], ["file_id", "trigram"])

    return rows.mapInArrow(run, f"file_id {dict(rows.dtypes)['file_id']}, trigram string")


def trigram_sizes(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """(trigram, files): how many files hold it. Counted where the texts are read; only counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, gram in _trigrams(b.column("content")):
                own, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([_spelled(own), pa.array(n)], ["trigram", "files"])

    return posted(files, most_bytes).select("content").mapInArrow(run, "trigram string, files long").groupBy("trigram").agg(F.sum("files").alias("files"))


BUCKETS = 256


def save_postings(postings: DataFrame, path: str) -> None:
    """Writes postings (trigram or word, file_id) by buckets of the term, so that a search reads a few folders only."""
    term = next(c for c in postings.columns if c != "file_id")
    postings.withColumn("bucket", F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms; of saved ones only their buckets are read."""
    term = next(c for c in postings.columns if c not in ("file_id", "bucket"))
    out = postings.where(F.col(term).isin(terms))
    if "bucket" in postings.columns and terms:
        own = postings.sparkSession.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)) for t in terms])).alias("b"))
        out = out.where(F.col("bucket").isin(sorted({int(r["b"]) for r in own.collect()})))  # as many as terms asked for
    return out


def word_postings(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    return posted(files, most_bytes).select("file_id", F.explode(F.array_distinct(text.words(F.col("content")))).alias("word"))


def upsert(table: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def remove(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def replay(changes: DataFrame) -> DataFrame:
    """The last record of each path decides; what was deleted last is gone. changes: seq, path, op."""
    last = changes.groupBy("path").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"), F.count("*").alias("n_changes"))
    return last.where("op <> 'deleted'")


def needs_compaction(dirty_ops: int, n_files: int) -> bool:
    return dirty_ops > max(64, n_files // 4)


def compact(postings: DataFrame, files: DataFrame) -> DataFrame:
    """Postings of live files only, rewritten without repeats."""
    return postings.join(files.select("file_id"), "file_id", "left_semi").distinct()


def splice(content: DataFrame, start: int, end: int, new: str) -> DataFrame:
    """Replaces lines start..end (1-based) of `content`; adds hashes of before and after."""
    parts = F.split("content", "\n")
    out = F.array_join(F.concat(F.slice(parts, 1, start - 1) if start > 1 else F.array().cast("array<string>"), F.array(F.lit(new)), F.slice(parts, F.lit(end + 1), F.greatest(F.size(parts) - end, F.lit(0)))), "\n")
    return content.withColumn("before_hash", F.xxhash64("content")).withColumn("content", out).withColumn("after_hash", F.xxhash64("content"))


def running(rows: DataFrame, order: list[str], number: str, sums: dict[str, str]) -> DataFrame:
    """Adds the row's number in the order (from 1) and running sums: {new column: column}. Rows are dealt by ranges of
    the order; each range counts by itself and starts at what the ranges before it hold. No task sees all rows."""
    from stratalens.operators.graph import _cut

    part = _cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))  # written, as ranges are drawn anew each time
    per = part.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()]).orderBy("__part")
    names, before, offsets = ["__n", *[f"__{n}" for n in sums]], None, []
    for r in per.toLocalIterator():  # one row per partition
        before = before or [0] * len(names)
        offsets.append((r["__part"], *before))
        before = [a + (r[c] or 0) for a, c in zip(before, names)]
    offset = rows.sparkSession.createDataFrame(offsets, ", ".join(["__p int", *[f"{c} long" for c in names]]))
    w = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = part.join(F.broadcast(offset), F.col("__part") == F.col("__p"))  # as many rows as partitions
    added = [(F.count("*").over(w) + F.col("__n")).alias(number), *[(F.sum(c).over(w) + F.col(f"__{n}")).alias(n) for n, c in sums.items()]]
    return out.select(*[c for c in rows.columns if c not in (number, *sums)], *added)


def numbered_changes(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    rows = events.select("ts", "event_id", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), op.alias("op"))
    return running(rows, ["ts", "event_id"], "seq", {}).select("seq", "path", "op", "ts")

"""What the corpus operators share: the shared folder, word patterns, bitmaps of bounded size, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import json
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract here has it: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: on one machine (tests) an own temporary one, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            at = shared_dir.own = tempfile.mkdtemp(prefix="stratalens-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


class Workspace:
    """Tables written to the shared folder, to cut lineage: any executor can read them again after a loss.

    Without `root` the folder is a new one, and goes when the driver's JVM ends: results may still be read from it.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}").rstrip("/")
        if root is None:
            fs, at = self._fs("")
            fs.mkdirs(at)
            fs.deleteOnExit(at)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def _fs(self, label: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label).rstrip("/"))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def save(self, df: DataFrame, label: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).option("compression", "zstd").parquet(self.path(label))
        return self.read(label, df.schema)

    def read(self, label: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(label))

    def exists(self, label: str) -> bool:
        fs, at = self._fs(label)
        return fs.exists(at)

    def drop(self, *labels: str) -> None:
        for label in labels:
            fs, at = self._fs(label)
            fs.delete(at, True)

    def put(self, label: str, value: dict) -> None:
        """Writes a small record under a new version; the last whole version counts."""
        version = self.get(label, (0, None), versioned=True)[0] + 1
        fs, at = self._fs(f"{label}/{version:08d}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if version > 2:
            self.drop(f"{label}/{version - 2:08d}.json")

    def get(self, label: str, default=None, versioned: bool = False):
        fs, at = self._fs(label)
        for f in sorted((str(f.getPath()) for f in fs.listStatus(at)), reverse=True) if fs.exists(at) else []:
            with contextlib.suppress(ValueError):  # cut short while it was written
                value = json.loads(self.spark.read.text(f, wholetext=True).first()[0])
                return (int(f.rsplit("/", 1)[1].split(".")[0]), value) if versioned else value
        return default

    def release_shuffles(self) -> None:
        """Has the JVM drop what is unreachable, so that its cleaner deletes the shuffle files of ended steps."""
        self.spark.sparkContext._jvm.System.gc()


def release_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs collect, which gives the heap that ended steps have left back to the system: Python workers need the room."""
    n = spark.sparkContext.defaultParallelism  # a task for each slot
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


# --- bitmaps: a set of any size as a filter of fixed size, which may let more rows through but loses none ---


def bitmap(df: DataFrame, key: Column, bits: int = 22) -> DataFrame:
    """At most 2**(bits-15) rows of 4 KB, whatever df holds: its size has a bound, so it may be broadcast."""
    slot = F.pmod(key, F.lit(1 << bits))
    return (
        df.select(slot.alias("s"))
        .where("s IS NOT NULL")
        .select(F.bitmap_bucket_number("s").alias("bm_no"), F.bitmap_bit_position("s").alias("p"))
        .groupBy("bm_no")
        .agg(F.bitmap_construct_agg("p").alias("bm_bits"))
    )


def maybe_in(df: DataFrame, key: Column, bm: DataFrame, bits: int = 22, flag: str = "maybe") -> DataFrame:
    """Adds a flag: false means that the key is surely not in the set of the bitmap."""
    slot = F.pmod(key, F.lit(1 << bits))
    out = df.withColumn("bm_slot", slot).withColumn("bm_want", F.bitmap_bucket_number("bm_slot"))
    out = out.join(F.broadcast(bm), F.col("bm_want") == F.col("bm_no"), "left")
    byte = "cast(conv(hex(substring(bm_bits, cast(bitmap_bit_position(bm_slot) div 8 as int) + 1, 1)), 16, 10) as bigint)"
    hit = F.expr(f"bm_bits IS NOT NULL AND bit_get({byte}, cast(bitmap_bit_position(bm_slot) % 8 as int)) = 1")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("bm_slot", "bm_want", "bm_no", "bm_bits")


def bitmap_bytes(bm: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as one array of 2**(bits-3) bytes on the driver, for a broadcast to Python workers."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for no, blob in bm.toLocalIterator():
        out[(no - 1) * 4096 : no * 4096] = np.frombuffer(blob, np.uint8)
    return out


# --- rows that can be named ---

FILE, ROW = "__file", "__row"


def _from_files(docs: DataFrame) -> bool:
    """Whether each row is one row of a file: filters and projections over one table of files, nothing else."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName().startswith(("Relation", "LogicalRelation"))


def addressable(docs: DataFrame, ws: Workspace, label: str = "addressable", **columns: str | Column) -> DataFrame:
    """The named columns with the file and the row number of each row: no other column of docs can clash with them.

    What doesn't come straight from files with row numbers is written first."""
    picked = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    if _from_files(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            return docs.select(*picked, meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))
        except AnalysisException as e:
            if "_metadata" not in str(e) and "row_index" not in str(e):
                raise
    kept = ws.save(docs.select(*picked), label)
    return kept.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """docs (as addressable gives them) less the rows whose keys are in dropped. Only rows that a bitmap can't clear are shuffled."""
    key = F.xxhash64(*keys)
    marked = maybe_in(docs, key, bitmap(dropped, key))
    clear, rest = marked.where("NOT maybe").drop("maybe"), marked.where("maybe").drop("maybe")
    return clear.unionByName(rest.join(dropped.select(*keys), keys, "left_anti"))


# --- Arrow ---


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the system: workers stay for the tasks that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, most: int = 4_000_000):
    """(start, stop) of runs of rows with about so many bytes of text; one longer text is a run of its own."""
    if not len(texts):
        return
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()))
    run = (np.cumsum(size) - 1).clip(0) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    yield from zip(edges, edges[1:])


def as_text(column) -> pa.Array:
    """A text column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_strings(values: list[str], seed: int = 0) -> np.ndarray:
    import xxhash

    f = xxhash.xxh64_intdigest
    return np.fromiter((f(v, seed) for v in values), np.uint64, len(values))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, each token's place among them, and where each text's tokens start (one more at the end)."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    filled = pc.not_equal(flat, "")
    keep = np.asarray(filled.cast(pa.uint8())).astype(bool) if len(flat) else np.zeros(0, bool)
    ends = np.asarray(split.offsets) - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
    starts = np.concatenate([[0], np.cumsum(keep)])[ends]
    coded = flat.filter(filled).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64), starts.astype(np.int64)


def each_text(starts: np.ndarray) -> np.ndarray:
    """The text's number for each token."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between starts; 0 where nothing lies between."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[starts[1:]] - c[starts[:-1]]

"""Exact dedup by stateful streaming: keyed state on disk, without expiry, of digest, stable id and content locator.

Arriving rows are reduced to digest, id and locator (batch, file, row number) and put in an inbox. A Structured
Streaming query keeps, in RocksDB state keyed by digest and id, the first locator and how many rows arrived; partial
aggregation before the shuffle keeps a text that a third of all rows share to one row for each task. The state stays in
the stream's checkpoint, so a later `ingest`, also of another process, continues where the last one ended. Digests that
occur more than once are hits: the full bytes of the rows behind them are compared (as grouping keys, so that copies
collapse before the shuffle), earlier batches' by their locators. Should two texts share a digest, their key becomes
digest and text.

Null texts count as empty. Null ids come last among equal texts. Of repeated rows with one id and text the first by
batch, file and row is kept. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import FILE, ROW, SPACE, Workspace, addressable, bitmap, documents, maybe_in

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space taken ahead
}


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class StreamingExactDedup:
    """`ingest` takes a batch of rows in; `decisions` says for all rows so far which one stays.

    With a `path` the inbox, the state and the list of batches stay there: a later process that opens the same path goes
    on where the last one ended. An ingest that was cut short is undone on opening: the state is made anew from the
    inbox's whole batches. Rows are named by batch, file and row number, so ingested files must stay in place.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha, files_per_trigger: int | None = None):
        self.spark, self.digest, self.per_trigger = spark, digest, files_per_trigger
        self.ws = Workspace(spark, "exact-dedup", path)
        known = self.ws.get("manifest", {}) if path else {}
        self.texts, self.clashing, self.gen = known.get("texts", []), set(known.get("clashing", [])), known.get("gen", 0)
        if known.get("pending"):
            self._rebuild()

    def _note(self, pending: bool = False) -> None:
        self.ws.put("manifest", {"texts": self.texts, "clashing": sorted(self.clashing), "gen": self.gen, "pending": pending})

    def _at(self, label: str) -> str:
        return f"{label}-{self.gen}"

    def _key(self, text: Column) -> Column:
        key = self.digest(text)
        return F.when(key.isin(*self.clashing), F.concat(key, F.lit(":"), text)).otherwise(key) if self.clashing else key

    def _arrive(self, rows: DataFrame, no: int) -> None:
        """rows: id, t, file and row."""
        rows = rows.select("id", self._key(F.col("t")).alias("digest"), sha(F.col("t")).alias("sha"), F.lit(no).alias("batch"), FILE, ROW)
        self.ws.save(rows, self._at("inbox"), "append")

    def _inbox(self) -> DataFrame:
        return self.spark.read.parquet(self.ws.path(self._at("inbox")))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: bool = False) -> None:
        """place: docs have a file and a row number already, as `addressable` gives them, under which the file has the texts as `text`."""
        no = len(self.texts)
        if no:
            self._note(pending=True)
        kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"), FILE, ROW) if place else addressable(docs, self.ws, f"batch-{no}", id=id_col, raw=text_col)
        rows = kept.select("id", normalised("raw").alias("t"), FILE, ROW)
        self._arrive(rows, no)
        self._advance(no)
        # the text column's name in the files that the locators name
        self.texts.append("raw" if self.ws.exists(f"batch-{no}") else "text" if place else text_col)
        if found := self._clashes(rows, no):
            self.clashing |= found
            self._rebuild()
        self._note()

    def _rebuild(self) -> None:
        """Makes inbox and state anew, texts read by their locators."""
        old, self.gen = self._inbox().where(F.col("batch") < len(self.texts)), self.gen + 1
        for no in range(len(self.texts)):
            self._arrive(self._texts(old.where(F.col("batch") == no), no, "id"), no)
            self._advance(no)
        self.ws.drop(*(f"{x}-{self.gen - 1}" for x in ("inbox", "state", "checkpoint", "hits")))
        self._hits()
        self._note()

    def _texts(self, at: DataFrame, no: int, *columns: str) -> DataFrame:
        """The columns of `at` with the texts t that its locators of batch `no` name. Only files with such a row are read."""
        path, uri = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jvm.java.net.URI
        files = [path(uri(r[0])).toString() for r in at.select(FILE).distinct().toLocalIterator()]  # no more than Spark's own list of files
        if not files:
            return at.select(*columns, F.lit("").alias("t"), FILE, ROW)
        meta = F.col("_metadata")
        rows = self.spark.read.parquet(*files).select(normalised(self.texts[no]).alias("t"), meta["file_path"].alias("f"), meta["row_index"].alias("r"))
        return at.join(rows, (F.col(FILE) == F.col("f")) & (F.col(ROW) == F.col("r"))).select(*columns, "t", FILE, ROW)

    def _advance(self, no: int) -> None:
        """Runs the stream over what is new in the inbox."""
        reader = self.spark.readStream.schema(self._inbox().schema)
        if self.per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.per_trigger)
        locator = F.struct("batch", FILE, ROW)
        state = reader.parquet(self.ws.path(self._at("inbox"))).groupBy("digest", "id").agg(F.min(locator).alias("at"), F.count("*").alias("n"))
        log = self.ws.path(self._at("state"))
        before = {k: self.spark.conf.get(k, None) for k in ROCKS}
        try:
            for k, v in ROCKS.items():
                self.spark.conf.set(k, v)
            query = (
                state.withColumn("ingest", F.lit(no)).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", self.ws.path(self._at("checkpoint")))
                .foreachBatch(lambda changed, k: changed.write.mode("overwrite").parquet(f"{log}/trigger={k}")).start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def groups(self) -> DataFrame:
        """One row per digest: the smallest id and the place of the first row that has it, the size, the first row of all, the last ingest that changed it."""
        id_type = dict(self._inbox().dtypes)["id"]
        log = self.spark.read.schema(f"digest string, id {id_type}, at struct<batch: int, {FILE}: string, {ROW}: long>, n long, ingest int").parquet(self.ws.path(self._at("state")))
        last = log.groupBy("digest", "id").agg(F.min("at").alias("at"), F.max("n").alias("n"), F.max("ingest").alias("ingest"))
        best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at"))
        out = last.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("group_size"), F.min("at").alias("first"), F.max("ingest").alias("ingest"))
        return out.select("digest", F.col("best.id").alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size", "first", "ingest")

    def _hits(self) -> DataFrame:
        """The groups of two and more, as a table: the join with them then deals both sides, and splits a hot digest."""
        return self.ws.save(self.groups().where("group_size > 1"), self._at("hits"))

    def _clashes(self, rows: DataFrame, no: int) -> set[str]:
        """Digests of batch `no` behind which the full bytes differ: none, unless the digest is weak.

        The batch's own hits are compared with each other and with one row of each earlier batch's group, read by its
        locator; earlier rows of a group have been compared when they came."""
        hits = self._hits().where(F.col("ingest") == no)
        key = F.xxhash64("digest")
        texts = maybe_in(rows.select(self._key(F.col("t")).alias("digest"), "t"), key, bitmap(hits.select("digest"), key)).where("maybe").select("digest", "t")
        old = hits.where(F.col("first.batch") < no).select("digest", "first.*")
        for b in range(no):
            texts = texts.union(self._texts(old.where(F.col("batch") == b), b, "digest").select("digest", "t")) if old.where(F.col("batch") == b).limit(1).count() else texts
        differ = texts.groupBy("digest", "t").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
        return {r["digest"] for r in differ.select("digest").toLocalIterator()}

    def decisions(self) -> DataFrame:
        """id, keep_id, group_size, kept, text_sha256 and the row's batch, file and row number; one row for each row taken in."""
        hits = self.spark.read.parquet(self.ws.path(self._at("hits"))).select(F.col("digest").alias("hit"), "keep_id", "keep_at", "group_size")
        out = self._inbox().join(hits, F.col("digest") == F.col("hit"), "left")
        alone = F.col("hit").isNull()
        return out.select(
            "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.struct("batch", FILE, ROW) == F.col("keep_at"))).alias("kept"), F.col("sha").alias("text_sha256"), "batch", FILE, ROW,
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: bool = False) -> DataFrame:
    """The decisions for one batch."""
    run = StreamingExactDedup(docs.sparkSession)
    run.ingest(docs, id_col, text_col, place)
    return run.decisions()


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

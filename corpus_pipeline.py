"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, rows whole: toxicity drops what scores 0.5 or more, exact dedup and SimHash near-dedup (five-word
shingles, Jaccard similarity of 0.8 or more) keep one row of each group (the first with the smallest doc_id), mixing
repeats or drops rows to meet the sources' targets. The last returns two sampled segmentations per row, as piece ids.
Null and empty texts are clean and go through like any other text. Extra columns are carried along, whatever their
names: rows travel as one struct while a stage decides on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import exact_dedup, mixing, sentencepiece_sampling, simhash, toxicity
from stratalens.llm.common import FILE, ROW, Workspace, addressable, documents, release_heaps, remainder, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    p = toxicity.ToxicityParams(slice_bytes=1_000_000)  # leaves room beside the executors' heaps; scores are the same
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", p, remainder("k", 5) != 0)
    return docs.where(toxicity.scorer(spark, model, p)(F.col("text")) < 0.5)


def _rows(docs: DataFrame, name: str) -> DataFrame:
    """The whole row as one struct d, what the stages read of it, and its place."""
    return addressable(docs, Workspace(docs.sparkSession, name), d=F.struct("*"), id="doc_id", text="text", source="source")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    release_heaps(spark)
    rows = _rows(docs, "stage-exact")
    lost = exact_dedup.exact_dedup(rows, "id", "text", place=True).where("NOT kept").select(FILE, ROW)
    return without(rows.select("d", FILE, ROW), lost, [FILE, ROW]).select("d.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: the one with the smallest doc_id."""
    release_heaps(spark)
    rows, ws = _rows(docs, "stage-simhash"), Workspace(spark, "stage-simhash")
    lost = ws.save(simhash.similar_dedup(rows, "id", "text", place=True).where("NOT kept").select(FILE, ROW), "lost")
    return without(rows.select("d", FILE, ROW), lost, [FILE, ROW]).select("d.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it."""
    release_heaps(spark)
    rows = _rows(docs, "stage-mixing")
    taken = mixing.mix_sources(rows, "id", "text", "source", place=True).where("copies > 0").select(F.col(FILE).alias("f"), F.col(ROW).alias("r"), "copies")
    rows = rows.select("d", FILE, ROW).join(taken, (F.col(FILE) == F.col("f")) & (F.col(ROW) == F.col("r")))
    return rows.select("d", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("d.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each row."""
    release_heaps(spark)
    p = sentencepiece_sampling.SampleParams(slice_bytes=300_000, room=300_000)  # leaves room beside the heaps; samples are the same
    return sentencepiece_sampling.sample_segmentations(docs, params=p).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("SentencePiece sampling", encode),
]

ORACLE_SQL = None  # no stage but exact dedup can be said in SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ws, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.save(docs, f"stage-{k}")
            if k:
                ws.drop(f"stage-{k - 1}")
    return docs

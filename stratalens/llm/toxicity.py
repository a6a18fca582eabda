"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Null and empty texts have no features and get the score of the bias. Repeated rows get equal scores. Labels that are
null are not learned from; of several labels for one id the highest counts. Without any label all scores are 0.0.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from stratalens.llm.common import as_text, documents, each_text, hash_strings, mix, remainder, slices, tidy, words_of


#: Lengths of the stems, in letters.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20  # features are hashed to 2**bits
    sample_rows: int = 12_000  # the bound on labelled rows that are learned from
    sample_features: int = 60_000_000  # the bound on their features: rows of the sample beyond it are left out
    slice_bytes: int = 4_000_000  # of text whose features are held at once: a worker's memory grows with it
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 15.0
    l2: float = 0.0
    toxic_weight: float = 2.0  # how many clean rows a toxic one counts for


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) for every word, its stems, word pair and pair with one word left out; with repeats.

    A stem is a word's first letters, so that an inflected form that was never labelled is known by its stem.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    names, codes, starts = words_of(plain)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, of = hash_strings(names, 5)[codes], each_text(starts)
    rows, hashes = [of], [mix(h)]
    for n in STEMS:
        long = np.array([len(x) > n for x in names])[codes]
        rows.append(of[long])
        hashes.append(mix(hash_strings([x[:n] for x in names], 7 + n)[codes[long]]))
    for step, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93)):
        if len(h) > step:
            same = of[step:] == of[:-step]
            rows.append(of[step:][same])
            hashes.append(mix(h[:-step] * np.uint64(salt) + h[step:])[same])
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; weights follow from z and n only where |z| exceeds l1, so most stay zero."""

    def __init__(self, p: ToxicityParams):
        self.p, self.z, self.n = p, np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        p, z, n = self.p, self.z[at], self.n[at]
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        g = g * weight if y else g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, p: ToxicityParams, learn_from: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features with a weight, weights); the last feature is the bias. One task learns from the bounded sample."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where("y IS NOT NULL AND k IS NOT NULL")
    if learn_from is not None:
        known = known.where(learn_from)
    picked = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(p.sample_rows)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(picked), "k")  # picked has sample_rows rows at most

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_text(b.column("t"))
            for i, j in slices(texts, p.slice_bytes):
                row, feature = features(texts[i:j], p.bits)
                both = np.unique(row << p.bits | feature)
                cut = np.searchsorted(both >> p.bits, np.arange(j - i + 1))
                idx = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((both & ((1 << p.bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("k")[i:j], b.column("y")[i:j].cast(pa.float64()), idx], ["k", "y", "idx"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, bias = Ftrl(p), [], np.array([1 << p.bits])
        room = p.sample_features
        for b in batches:
            for x, y in zip(b.column("idx"), b.column("y").to_pylist()):
                room -= len(x.values)
                if room >= 0:
                    seen.append((np.concatenate([x.values.to_numpy(), bias]), float(y > 0)))
        for _ in range(p.epochs):
            for x, y in seen:
                model.learn(x, y, p.toxic_weight)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["f", "w"])
        del model, seen, w
        tidy()

    key = next(f"{t} " for n, t in docs.select(F.col(id_col).alias("k")).dtypes)
    found = rows.mapInArrow(digest, f"k {key}, y double, idx array<int>").orderBy(F.xxhash64("k", F.lit(3)), "k", "y", "idx").limit(p.sample_rows)  # an id may have many rows
    out = found.mapInArrow(learn, "f long, w double").toArrow()
    return out.column("f").to_numpy(), out.column("w").to_numpy()


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray], p: ToxicityParams):
    """A column function text -> score. Only the non-zero weights are broadcast: 2**bits + 1 pairs at most."""
    at, w = model
    sent = spark.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float32)))
    empty = len(at) == 0

    @arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros((1 << p.bits) + 1, np.float32)
        table[sent.value[0]] = sent.value[1]
        for column in parts:
            texts, out = as_text(column), []
            for i, j in slices(texts, p.slice_bytes):
                row, feature = features(texts[i:j], p.bits)
                live = table[feature] != 0
                both = np.unique(row[live] << p.bits | feature[live])
                margin = table[-1] + np.bincount(both >> p.bits, table[both & ((1 << p.bits) - 1)], j - i)
                out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))) * (not empty))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
        tidy()

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds=5, held_out=0, params=ToxicityParams()) -> DataFrame:
    """Learns from labelled rows outside the held-out fold; scores all rows. One row per document."""
    model = fit(docs, labels, id_col, text_col, label_col, params, remainder("k", folds) != held_out)
    score = scorer(docs.sparkSession, model, params)
    out = docs.select(F.col(id_col), (remainder(id_col, folds) == held_out).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

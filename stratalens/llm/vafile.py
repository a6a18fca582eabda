"""Exact top-k by inner product with vector-approximation files.

Vectors become integers; each stripe of them is a file of its own: one byte per component (the cell), the cells' edges,
and the exact vectors beside. A query first scans the cells alone: they bound its score from below and above. The kth
best lower bound rules most vectors out. The others' exact vectors are read in the order of their upper bounds until the
kth exact score is above the next bound. A stripe has a bounded number of bytes and is sent to one task, once; the
queries stream past it, a copy for each stripe, and the stripes' answers meet by query, k rows each.

Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part. Vectors of
different length are never compared. A query's own id is no candidate, also where its row is repeated; equal scores go
to the smaller id. Repeated rows ask once. Scores are ranked whole, and those beyond 64 bits shown as the largest long.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, tidy


@dataclass(frozen=True)
class VaParams:
    k: int = 20
    scale: int = 64
    cells: int = 32  # per component; 256 at most
    stripe_bytes: int = 32_000_000  # most of a stripe's exact vectors
    least_rows: int = 2048  # a stripe has as many at least, however many tasks could run
    block: int = 128  # queries whose bounds are held at once


_EXACT = 1 << 53


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * x) of each component of each whole vector."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    return rows.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _pack(cells: int):
    def pack(key: tuple, t: pa.Table) -> pa.Table:
        """One stripe as one row: ids, edges and widths of cells, cells, exact vectors."""
        dim = key[0].as_py()
        v = _matrix(t.column("v"), dim)
        lo, hi = (v.min(0), v.max(0)) if dim else (v[0], v[0])
        # widths as floats: the range of 64-bit numbers may not fit one
        width = np.maximum(1, np.ceil((hi.astype(np.float64) - lo + 1) / cells)).astype(np.uint64)
        cell = np.minimum((v.view(np.uint64) - lo.view(np.uint64)) // width, 255).astype(np.uint8) if dim else v.astype(np.uint8)
        blob = [np.asarray(t.column("id")).astype(np.int64), lo.astype(np.int64), width, cell, v.astype(np.int64)]
        return pa.table({"dim": pa.array([dim], pa.int32()), "stripe": pa.array([key[1].as_py()], pa.int64()), **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("ids", "lo", "width", "cells", "exact"), blob)}})

    return pack


class Stripe:
    def __init__(self, dim: int, ids: np.ndarray, lo: np.ndarray, width: np.ndarray, cells: np.ndarray, exact: np.ndarray, big: bool, p: VaParams):
        """big: scores may be beyond what doubles hold exactly."""
        self.dim, self.ids, self.exact, self.big, self.p = dim, ids, exact, big, p
        self.span = width.astype(np.float64) - 1
        self.corner = (lo + cells.astype(np.float64) * width).astype(np.float64)
        # of bounds in doubles, for vectors whose scores they don't hold: what rounding may take
        self.slack = np.abs(self.corner).max(initial=0) + self.span.max(initial=0) if big else 0.0

    def search(self, q_ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(place of the query, ids, scores) of each query's k best here."""
        for at in range(0, len(q), self.p.block):
            part = q[at : at + self.p.block].astype(np.float64)
            base = part @ self.corner.T
            margin = np.abs(part).sum(1) * self.slack * (self.dim + 8) * 2.0**-50
            up, down = np.maximum(part, 0) @ self.span + margin, np.minimum(part, 0) @ self.span - margin
            for i in range(len(part)):
                own = self.ids == q_ids[at + i]
                k = min(self.p.k, len(own) - int(own.sum()))
                if k:
                    yield at + i, *self._nearest(q[at + i], np.where(own, -np.inf, base[i] + up[i]), np.where(own, -np.inf, base[i] + down[i]), k)

    def _nearest(self, q: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        sure = np.partition(lower, len(lower) - k)[len(lower) - k]
        order = np.flatnonzero((upper >= sure) & (upper > -np.inf))
        order = order[np.argsort(-upper[order], kind="stable")]
        got, score, seen = np.zeros(0, np.int64), [], 0
        while seen < len(order) and (len(got) < k or upper[order[seen]] >= float(score[-1])):
            read = order[seen : seen + max(2 * k, 64)]
            seen += len(read)
            got = np.concatenate([got, read])
            if self.big:
                score += [int(x) for x in self.exact[read].astype(object) @ q.astype(object)]
                best = sorted(range(len(got)), key=lambda x: (-score[x], self.ids[got[x]]))[:k]
            else:
                score = np.concatenate([np.asarray(score, np.int64), self.exact[read] @ q])
                best = np.lexsort((self.ids[got], -score))[:k]
            got, score = got[best], [score[x] for x in best]
        return self.ids[got], score


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", params: VaParams = VaParams()) -> DataFrame:
    """query_id, rank, vec_id, score. asks: which rows of `vectors` are queries."""
    p, spark = params, vectors.sparkSession
    ws = Workspace(spark, "vafile")
    rows = integers(vectors, id_col, vector_col, p.scale).withColumn("dim", F.size("v"))
    queries = integers(vectors.where(asks), id_col, vector_col, p.scale).withColumn("dim", F.size("v")).distinct()
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    per = rows.groupBy("dim").agg(F.count("*").alias("n"), largest.alias("largest"))
    least = F.least(F.lit(spark.sparkContext.defaultParallelism), F.ceil(F.col("n") / p.least_rows))
    stripes = F.greatest(least, F.ceil(F.col("n") * (F.col("dim") + 1) * 8 / p.stripe_bytes)).cast("long")
    big = F.col("largest") * F.col("largest") * F.greatest("dim", F.lit(1)) >= float(_EXACT)
    per = ws.save(per.select(F.col("dim").alias("d"), stripes.alias("stripes"), big.alias("big")), "dims")
    # dealt by a running number: repeated rows are spread like any others
    dealt = rows.withColumn("no", F.monotonically_increasing_id()).join(per, F.col("dim") == F.col("d")).select("dim", "id", "v", F.pmod(F.xxhash64("no"), "stripes").alias("stripe"))
    blobs = ["ids", "lo", "width", "cells", "exact"]
    file = ws.save(dealt.groupBy("dim", "stripe").applyInArrow(_pack(p.cells), f"dim int, stripe long, {', '.join(f'{c} binary' for c in blobs)}"), "stripes")
    file = file.join(per, F.col("dim") == F.col("d")).select("dim", "stripe", "big", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<long>").alias("v"), *blobs)
    asked = queries.join(per, F.col("dim") == F.col("d")).select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("stripe"), "big", F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), "v", *[F.lit(None).cast("binary").alias(c) for c in blobs])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a stripe, then its queries."""
        stripe, at = None, None
        for b in batches:
            dims, nos, kinds, ids = (np.asarray(b.column(c).fill_null(0)) for c in ("dim", "stripe", "kind", "id"))
            cuts = np.concatenate([[0], np.flatnonzero((dims[1:] != dims[:-1]) | (nos[1:] != nos[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(dims)]])
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if kinds[i] == 0:
                    dim, raw = int(dims[i]), {c: np.frombuffer(b.column(c)[int(i)].as_buffer(), t) for c, t in zip(blobs, (np.int64, np.int64, np.uint64, np.uint8, np.int64))}
                    n, at = len(raw["ids"]), (dims[i], nos[i])
                    stripe = Stripe(dim, raw["ids"], raw["lo"], raw["width"], raw["cells"].reshape(n, dim), raw["exact"].reshape(n, dim), b.column("big")[int(i)].as_py(), p)
                elif at == (dims[i], nos[i]):  # a stripe without rows has no file
                    q, out = _matrix(b.column("v")[i:j], stripe.dim), [[], [], [], []]
                    for k, vec, score in stripe.search(ids[i:j], q):
                        for x, y in zip(out, ([ids[i + k]] * len(vec), [k] * len(vec), vec.tolist(), score)):
                            x.extend(y)
                    tie = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in np.ascontiguousarray(q)], np.uint64).view(np.int64)[out[1]] if len(q) else np.zeros(0, np.int64)
                    short = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in out[3]]
                    wide = [(int(x) + (1 << 191)).to_bytes(24) for x in out[3]] if stripe.big else [None] * len(short)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(tie, pa.int64()), pa.array(out[2], pa.int64()), pa.array(short, pa.int64()), pa.array(wide, pa.binary())], ["query_id", "tie", "vec_id", "score", "wide"])
        del stripe
        tidy()

    met = file.unionByName(asked).repartition("dim", "stripe").sortWithinPartitions("dim", "stripe", "kind")
    found = met.mapInArrow(search, "query_id long, tie long, vec_id long, score long, wide binary")
    rank = F.row_number().over(W.partitionBy("query_id", "tie").orderBy(F.desc("wide"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

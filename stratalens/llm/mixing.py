"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents should be taken: a whole number of copies and a
fraction. Fractions are rounded in pairs: mass moves at random from one document to the other, size times fraction
kept, until one of them is 0 or 1. Each source has a reduction tree of its own: documents meet in buckets by a hash;
the one document that stays fractional in a bucket goes on to the next level, where `fan` buckets meet, up to the root.
With it go a few documents of each magnitude that are decided (spares). At the root the last fraction goes to the nearer
side, and what the source's words miss by that is made good by turning spares over, one by one, then in pairs. The random numbers
come from ids, sizes and the seed: reruns agree.

Null texts and texts without words have size 0 and are never taken. The null source is a source and comes last. Rows
that share an id and a size beyond what a bucket holds (null ids, one id repeated) are dealt by file name and row number
instead. Repeated rows are rounded as rows of their own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import common
from stratalens.llm.common import FILE, ROW, WORD, Workspace, addressable, documents


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0  # times a source's size
    bucket_rows: int = 1024
    fan: int = 64
    spares: int = 2  # of each magnitude and side that go up with a bucket's fraction
    seed: int = 11


def size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, ws: Workspace, p: MixParams) -> DataFrame:
    """source, source_size, n, target: by weight, stopped at `most` times the source's size, the excess reshared until
    none is above. Sources are ranked and water is filled by aggregates, however many there are. rows: source, size."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ordered = per.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ordered = ws.save(ordered, "sources")
    # the rank of a source: its place in its sorted part, and the sources in the parts before
    before, offsets = 0, {}
    for r in ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").toLocalIterator():  # one row per partition
        offsets[r["part"]] = before - r["first"]
        before += r["n"]
    if not offsets:
        return ordered.select("source", "source_size", "n", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv])[F.col("part").cast("long")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), ((F.col("at") + offset) % len(p.weights) + 1).cast("int"))
    plan = ordered.select("source", "source_size", "n", weight.alias("w"), (F.col("source_size") * p.most).alias("cap"))
    words, all_w = plan.agg(F.sum("source_size"), F.sum("w")).first()
    level = p.share * words / all_w  # words per weight
    while True:
        full, w = plan.agg(F.sum(F.when(F.col("cap") <= F.col("w") * level, F.col("cap"))), F.sum(F.when(F.col("cap") > F.col("w") * level, F.col("w")))).first()
        higher = (p.share * words - (full or 0.0)) / w if w else level
        if higher <= level:
            return plan.select("source", "source_size", "n", F.least(F.col("cap"), F.col("w") * level).alias("target"))
        level = higher


def pivot(sizes: np.ndarray, probs: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """Pairs the rows of one source in turn; at most one of the returned probabilities is not 0 or 1."""
    p, hold = probs.copy(), -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if hold < 0:
            hold = i
            continue
        a, b = float(sizes[hold]), float(sizes[i])
        # words that can go from hold to i, and back
        to_i, to_hold = min(a * p[hold], b * (1 - p[i])), min(b * p[i], a * (1 - p[hold]))
        if rand[i] * (to_i + to_hold) < to_hold:
            x, full, spent = to_i, b * (1 - p[i]) <= to_i, a * p[hold] <= to_i
            p[hold], p[i] = 0.0 if spent else p[hold] - x / a, 1.0 if full else p[i] + x / b
        else:
            x, full, spent = to_hold, a * (1 - p[hold]) <= to_hold, b * p[i] <= to_hold
            p[hold], p[i] = 1.0 if full else p[hold] + x / a, 0.0 if spent else p[i] - x / b
        if not 0 < p[hold] < 1:
            hold = i if 0 < p[i] < 1 else -1
    return p


def spares(sizes: np.ndarray, probs: np.ndarray, most: int) -> np.ndarray:
    """A few decided rows of each magnitude (power of two) on each side. sizes: in descending order."""
    out = np.zeros(len(sizes), bool)
    for side in (0.0, 1.0):
        at = np.flatnonzero((probs == side) & (sizes > 0))
        power = np.frexp(sizes[at].astype(float))[1]
        first = np.flatnonzero(np.diff(power, prepend=-1)) if len(at) else at
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        out[at[rank < most]] = True
    return out


def settle(sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Rounds the last fraction, then turns rows over wherever that brings the sum nearer to what it was: single ones,
    largest first, then pairs, one on each side, the best pair each time."""
    out = np.rint(probs)
    over = float((sizes * out).sum() - (sizes * probs).sum())
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = float(sizes[i])
        if over > 0 and out[i] == 1 and s < 2 * over:
            out[i], over = 0.0, over - s
        elif over < 0 and out[i] == 0 and 0 < s < -2 * over:
            out[i], over = 1.0, over + s
    for _ in range(20):
        take, drop = np.flatnonzero((out == 0) & (sizes > 0)), np.flatnonzero(out == 1)
        if abs(over) < 1 or not len(take) or not len(drop):
            break
        drop = drop[np.argsort(sizes[drop], kind="stable")]
        want = sizes[take] + over  # the size of the row to drop for each row to take
        near = np.searchsorted(sizes[drop], want)
        both = np.stack([np.clip(near - 1, 0, len(drop) - 1), np.clip(near, 0, len(drop) - 1)])
        miss = np.abs(sizes[drop][both] - want)
        side, k = np.unravel_index(miss.argmin(), miss.shape)
        if miss[side, k] >= abs(over):
            break
        i, j = take[k], drop[both[side, k]]
        out[i], out[j], over = 1.0, 0.0, over + float(sizes[i]) - float(sizes[j])
    return out


def _round(p: MixParams, level: int):
    def one(t: pa.Table) -> pa.Table:
        """One bucket of one source."""
        t = t.sort_by([("size", "descending"), ("order", "ascending"), ("place", "ascending")])
        sizes, probs, order = (t.column(c).to_numpy() for c in ("size", "prob", "order"))
        h = common.mix(order.view(np.uint64) + np.uint64((p.seed * 1000 + level) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out = pivot(sizes, probs, (h >> np.uint64(11)) / float(1 << 53))
        if t.column("buckets")[0].as_py() == 1:
            out, up = settle(sizes, out), np.zeros(len(out), bool)
        else:
            up = (out > 0) & (out < 1) | spares(sizes, out, p.spares)
        t = t.set_column(t.schema.get_field_index("prob"), "prob", pa.array(out))
        return t.set_column(t.schema.get_field_index("up"), "up", pa.array(up))

    return one


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams = MixParams(), place: bool = False) -> DataFrame:
    """id, source, size, source_size, target, copies, taken and the row's file and row number.

    place: docs have these two columns already, as `addressable` gives them."""
    p, ws = params, Workspace(docs.sparkSession, "mixing")
    rows = docs if place else addressable(docs, ws, id=id_col, source=source_col, t=text_col)
    names = (id_col, source_col, text_col) if place else ("id", "source", "t")
    rows = rows.select(F.col(names[0]).alias("id"), F.col(names[1]).alias("source"), size(names[2]).alias("size"), FILE, ROW)
    rows = ws.save(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    plan = targets(rows, ws, p).withColumnRenamed("source", "s")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate).cast("long")).withColumn("prob", rate - F.floor(rate))
    buckets = F.ceil(F.col("n") / p.bucket_rows)
    order = F.xxhash64("id", "size", F.lit(p.seed))
    at = F.xxhash64(F.element_at(F.split(FILE, "/"), -1), F.col(ROW))
    state = rows.where("prob > 0 AND prob < 1").select("row", "source", "size", "prob", order.alias("order"), at.alias("place"), buckets.alias("buckets"))
    state = ws.save(state.withColumn("bucket", F.pmod("order", "buckets")), "fractions")
    # a bucket that repeated ids fill is dealt anew by place: over all the source's buckets, whose number counts its rows
    heavy = state.groupBy("source", "bucket").agg(F.count("*").alias("held")).where(F.col("held") > 8 * p.bucket_rows).select(F.col("source").alias("hs"), F.col("bucket").alias("hb"))
    if heavy.limit(1).count():
        state = state.join(heavy, F.col("source").eqNullSafe(F.col("hs")) & (F.col("bucket") == F.col("hb")), "left")
        state = state.withColumn("order", F.when(F.col("hb").isNull(), F.col("order")).otherwise(F.xxhash64("place", F.lit(p.seed)))).drop("hs", "hb")
        state = state.withColumn("bucket", F.pmod("order", "buckets"))
    state, level, done = state.withColumn("up", F.lit(True)), 0, None
    while True:
        state = ws.save(state.groupBy("source", "bucket").applyInArrow(_round(p, level), state.schema), f"level-{level}")
        own = state.where("NOT up").select(F.col("row").alias("r"), F.col("prob").cast("long").alias("extra"))
        done = own if done is None else done.union(own)
        state = state.where("up").withColumn("buckets", F.ceil(F.col("buckets") / p.fan))
        state, level = state.withColumn("bucket", F.pmod("bucket", "buckets")), level + 1
        if not state.limit(1).count():
            break
    out = rows.drop("prob").join(done, F.col("row") == F.col("r"), "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0).cast("long"))
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), FILE, ROW)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


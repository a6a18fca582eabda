"""LM scoring: a hashed maximum-entropy model with class-factored softmax, beside an add-one unigram base.

Counts are exact and cover all training texts. The base needs the count of every word: the most frequent words are
broadcast (HEAD of them, of HEAD_BYTES bytes at most: a fixed bound), the others' counts come by a join.

The model grows with the counted vocabulary (`LmParams.shape`). Its events are the most frequent of: words, the end, and
tails. A tail is the set of words without an event of their own that end in the same two letters' hash; a tail word's
probability is its tail's times its add-one share of it, with one more for words never seen. Events are sorted by
frequency into classes. The probability of an event is that of its class times that of the event within it, both
softmaxes over sums of hashed weights: of the word before (2-gram), the two before (3-gram), the one before the last
(skip), and a bias from the counts. As a context a word is itself if it is known `context` times, else its tail.

Training goes in synchronous rounds, each over its own hash fold of the training texts. All tasks start a round from the
same weights and add up, for every weight, how often its feature and output met and how often the model expected it: the
gradient is the difference. The sums meet in a tree, and each weight then moves along its gradient at a rate of its own,
one over the logarithmic mean of both counts: by the logarithm of their ratio. So weights don't depend on how rows are
dealt to tasks, but for rounding.

Null and empty texts are one end. Without training texts the model is uniform and N = V = 0. Repeated rows get equal
scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace, as_text, documents, each_text, hash_strings, mix, remainder, slices, sums, tidy, words_of


@dataclass(frozen=True)
class Shape:
    """Sizes of the model."""

    classes: int
    width: int  # events in a class
    tails: int
    class_bits: int  # rows of weights for classes
    event_bits: int  # rows of weights for events within classes


@dataclass(frozen=True)
class LmParams:
    rounds: int = 2
    rate: float = 0.5
    smooth: float = 1.0
    context: int = 30  # how often a word is seen that is a context of its own
    max_classes: int = 128  # bounds the weights, which are broadcast, to 2**18 and 2**19 rows of so many
    head: int = 300_000
    head_bytes: int = 64
    batch: int = 8192
    merge: int = 32  # shards added up at once
    tasks: int = 2048  # most tasks that add up gradients, whose tables are as large as the model

    def shape(self, words: int) -> Shape:
        """For a vocabulary of so many distinct words."""
        c = min(self.max_classes, 4 * ceil((12 + words**0.2) / 4))
        bits = int(log2(16 * c * c))
        return Shape(c, c, c * c * 3 // 16, bits, bits + 1)


END = "\n"  # no word has it
_START = np.uint64(1)


def tail_of(word: str, tails: int) -> int:
    """As pmod(xxhash64(right(word, 2)), tails) in SQL."""
    h = xxhash.xxh64_intdigest(word[-2:].encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % tails


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over all texts t; one end per text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = lowered(as_text(b.column("t")))
            for i, j in slices(texts, 16_000_000):
                names, codes, _ = words_of(texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([*names, END], pa.string()), pa.array([*np.bincount(codes, minlength=len(names)).tolist(), j - i], pa.int64())], ["word", "c"])

    return rows.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Events:
    """Maps tokens to events. Broadcast: at most head words, slots and tails."""

    def __init__(self, head: list[tuple[str, int]], tails: list[tuple[int, int]], words: int, p: Shape):
        self.p = p
        own = head[:words]  # by count
        ranked = sorted([(c, 0, w) for w, c in own] + [(m, 1, t) for t, m in tails], key=lambda x: (-x[0], x[1], str(x[2])))
        self.event = {x: k for k, (_, kind, x) in enumerate(ranked) if kind == 0}
        self.tail_event = np.zeros(p.tails, np.int64)
        self.tail_mass = np.ones(p.tails)
        for k, (m, kind, x) in enumerate(ranked):
            if kind:
                self.tail_event[x], self.tail_mass[x] = k, m
        self.mass = np.array([max(c, 0.5) for c, *_ in ranked], np.float64)
        self.known = {w: c << 16 | self.event.get(w, 0xFFFF) for w, c in head}
        del self.event
        self.tail = {}  # of two letters

    def of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its event, its count if in the head (else -1), the mass of its tail (0 if it is no tail word)."""
        get = self.known.get
        both = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
        count, event, mass = both >> 16, both & 0xFFFF, np.zeros(len(names))
        far = np.flatnonzero(event == 0xFFFF)
        if len(self.tail) > 1_000_000:
            self.tail.clear()
        last = [names[k][-2:] for k in far.tolist()]
        for x in set(last).difference(self.tail):
            self.tail[x] = tail_of(x, self.p.tails)
        t = np.fromiter((self.tail[x] for x in last), np.int64, len(last))
        event[far], mass[far] = self.tail_event[t], self.tail_mass[t]
        return event, count, mass


class MaxEnt:
    def __init__(self, p: Shape, mass: np.ndarray, batch: int = 8192):
        self.p, self.batch = p, batch
        full = np.full(p.classes * p.width, 1e-9)
        full[: len(mass)] = mass
        full = full.reshape(p.classes, p.width)
        self.class_bias = np.log(full.sum(1) / full.sum()).astype(np.float32)
        self.event_bias = np.log(full / full.sum(1, keepdims=True)).astype(np.float32)
        self.w = [np.zeros((1 << p.class_bits, p.classes), np.float32), np.zeros((1 << p.event_bits, p.width), np.float32)]

    def rows(self, event: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of weights that each token's features hash to: (tokens, 3) for its class, and within it."""
        a, b = one, two
        f = np.stack([a * np.uint64(3) + np.uint64(1), mix(a * np.uint64(0x9E3779B97F4A7C15) + b), b * np.uint64(3) + np.uint64(2)], 1)
        c = (event // self.p.width).astype(np.uint64)[:, None]
        at = mix(f * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.p.class_bits)
        within = mix(f * np.uint64(0xA0761D6478BD642F) + c + np.uint64(7)) >> np.uint64(64 - self.p.event_bits)
        return at.astype(np.int64), within.astype(np.int64)

    def forward(self, event: np.ndarray, at: np.ndarray, within: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(exponentials of the logits, their sums) for the class and within it. Logits are sums of a few small weights."""
        out = []
        for w, rows, bias in ((self.w[0], at, self.class_bias), (self.w[1], within, self.event_bias[event // self.p.width])):
            x = np.take(w, rows[:, 0], axis=0)
            x += np.take(w, rows[:, 1], axis=0)
            x += np.take(w, rows[:, 2], axis=0)
            x += bias
            np.exp(x, out=x)
            out.append((x, x @ np.ones(x.shape[1], np.float32)))
        return out

    def score(self, event: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probability of each token's event."""
        out = np.empty(len(event))
        for i in range(0, len(event), self.batch):
            e = event[i : i + self.batch]
            k, total = np.arange(len(e)), 0.0
            for (x, z), hit in zip(self.forward(e, *self.rows(e, one[i : i + self.batch], two[i : i + self.batch])), (e // self.p.width, e % self.p.width)):
                total = total + np.log10(x[k, hit].astype(np.float64)) - np.log10(z)
            out[i : i + self.batch] = total
        return out

    def tables(self) -> list[np.ndarray]:
        """(observed, expected) for each table of weights."""
        return [np.zeros((2, *w.shape), np.float32) for w in self.w]

    def gather(self, event: np.ndarray, one: np.ndarray, two: np.ndarray, sums: list[np.ndarray]) -> None:
        """Adds to sums how often each row of weights met each output, and how often the model expected it."""
        for i in range(0, len(event), self.batch):
            e = event[i : i + self.batch]
            rows = self.rows(e, one[i : i + self.batch], two[i : i + self.batch])
            for r, (x, z), hit, (seen, expected) in zip(rows, self.forward(e, *rows), (e // self.p.width, e % self.p.width), sums):
                x *= (1 / z)[:, None]
                own, total = row_sums(x, r.astype(np.uint16) if len(seen) <= 1 << 16 else r)
                expected[own] += total
                np.add.at(seen.reshape(-1), (r * seen.shape[1] + hit[:, None]).ravel(), np.float32(1))

    def step(self, sums: list[np.ndarray], p: LmParams) -> None:
        for w, (seen, expected) in zip(self.w, sums):
            for at in range(0, len(w), 4096):
                w[at : at + 4096] += p.rate * np.log((seen[at : at + 4096] + p.smooth) / (expected[at : at + 4096] + p.smooth))


def row_sums(g: np.ndarray, rows: np.ndarray, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the sum of g over the tokens that have each): rows has all rows of a token, g one line per token.

    The first `most` tokens of all rows are added rank by rank, rows with many tokens before the others; what rows have
    beyond that is added row by row.
    """
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # of 16 bits: by radix
    flat, token = flat[order], order // rows.shape[1]
    cut = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(cut, append=len(flat))
    by = np.argsort(-count, kind="stable")
    cut, count = cut[by], count[by]
    total = np.take(g, token[cut], axis=0)
    for k in range(1, min(most, count[0])):
        n = np.searchsorted(-count, -k)  # rows with more than k
        total[:n] += np.take(g, token[cut[:n] + k], axis=0)
    for k in range(np.searchsorted(-count, -most)):
        total[k] += np.take(g, token[cut[k] + most : cut[k] + count[k]], axis=0).sum(0)
    return flat[cut], total


def _tokens(events: Events, texts: pa.Array, context: int):
    """(names, count, mass, codes, starts, event, one, two): tokens of a slice, ends put in; one and two: the words before."""
    names, codes, starts = words_of(texts)
    names = [*names, END]
    event, count, mass = events.of(names)
    word = np.where(count >= context, hash_strings(names), mix(event.astype(np.uint64) + np.uint64(2)))
    code = np.insert(codes, starts[1:], len(names) - 1)
    starts = starts + np.arange(len(starts))
    h = word[code]
    one, two = np.concatenate([[_START], h[:-1]]), np.concatenate([[_START, _START], h[:-2]])[: len(h)]
    one[starts[:-1]], two[starts[:-1]] = _START, _START
    second = starts[:-1] + 1
    two[second[second < starts[1:]]] = _START
    return names, count, mass, code, starts, event[code], one, two


def train(rows: DataFrame, events: Events, ws: Workspace, p: LmParams, shape: Shape) -> list[np.ndarray]:
    """The weights after all rounds. rows: t, fold (below p.rounds)."""
    spark, block = rows.sparkSession, 256
    sent, model = spark.sparkContext.broadcast(events), MaxEnt(shape, events.mass, p.batch)
    tasks = min(p.tasks, 2 * spark.sparkContext.defaultParallelism)
    names, schema = ["shard", "part", "at", "w"], "shard long, part int, at int, w binary"

    def descend(weights):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = MaxEnt(shape, sent.value.mass, p.batch)
            model.w = weights.value
            sums, n = model.tables(), 0
            for b in batches:
                texts = lowered(as_text(b.column("t")))
                for i, j in slices(texts, 2_000_000):
                    *_, e, one, two = _tokens(sent.value, texts[i:j], p.context)
                    model.gather(e, one, two, sums)
                    n += len(e)
            for k, x in enumerate(sums if n else []):
                for at in range(0, x.shape[1], block):
                    if x[:, at : at + block].any():
                        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([x[:, at : at + block].tobytes()], pa.binary())], names)
            del sums
            tidy()

        return run

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in t.column("w"))
        return pa.table([[t.column("shard")[0].as_py() // p.merge], pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([t.column("at")[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=names)

    for turn in range(p.rounds):
        weights = spark.sparkContext.broadcast(model.w)  # of a size that max_classes bounds
        made = rows.where(F.col("fold") == turn).select("t").coalesce(tasks).mapInArrow(descend(weights), schema)
        shards, level = ws.save(made, f"shards-{turn}-0"), 0
        while True:  # a tree: `merge` shards to one, until one is left
            top = shards.select(F.max("shard")).first()[0]
            if not top and level:
                break
            level += 1
            shards = ws.save(shards.groupBy(F.expr(f"shard div {p.merge}").alias("g"), "part", "at").applyInArrow(average_by(add), schema), f"shards-{turn}-{level}")
        sums = model.tables()
        for r in shards.toLocalIterator():  # as large as the model
            x = sums[r["part"]]
            own = np.frombuffer(r["w"], np.float32).reshape(2, -1, x.shape[2])
            x[:, r["at"] : r["at"] + own.shape[1]] = own
        model.step(sums, p)
        ws.drop(*[f"shards-{turn}-{k}" for k in range(level + 1)])
        weights.unpersist()
    return model.w


def average_by(f):
    return lambda key, table: f(table)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, params: LmParams = LmParams()) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    p, spark = params, docs.sparkSession
    ws = Workspace(spark, "maxent")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    learn = rows.where(remainder("id", folds) != held_out).select("t", F.pmod(F.xxhash64("id", "t"), F.lit(p.rounds)).alias("fold"))
    counts = ws.save(count_words(learn), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    shape = p.shape(v)
    words = shape.classes * shape.width - shape.tails
    short = counts.where(F.octet_length("word") <= p.head_bytes)
    if v > 4 * p.head:  # twice as many as wanted, and the error of the quantile, are left to sort
        cut = short.agg(F.percentile_approx("c", max(0.0, 1 - 2 * p.head / v - 1 / 5000), 10_000)).first()[0]
        short = short.where(F.col("c") >= (cut or 0))
    head = [(r["word"], r["c"]) for r in short.orderBy(F.desc("c"), "word").limit(p.head).toLocalIterator()]
    slots = spark.createDataFrame(head[:words], "w string, k long")  # as many words as the model has slots
    tails = counts.join(F.broadcast(slots), F.col("word") == F.col("w"), "left_anti").groupBy(F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(shape.tails)).cast("int").alias("tail")).agg((F.sum("c") + F.count("*") + 1).alias("m"))
    masses = {k: 1 for k in range(shape.tails)} | {r["tail"]: r["m"] for r in tails.collect()}  # one row per tail
    events = Events(head, sorted(masses.items()), words, shape)
    weights = train(learn, events, ws, p, shape)
    sent, model_ = spark.sparkContext.broadcast(events), spark.sparkContext.broadcast(weights)
    base = np.log10(n + v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = sent.value
        model = MaxEnt(shape, events.mass, p.batch)
        model.w = model_.value
        for b in batches:
            texts, row = lowered(as_text(b.column("t"))), np.asarray(b.column("row"))
            for i, j in slices(texts, 2_000_000):
                names, count, mass, code, starts, e, one, two = _tokens(events, texts[i:j], p.context)
                plain = np.log10(np.maximum(count, 0) + 1.0)  # of words outside the head: by the join
                tail = np.where(mass > 0, plain - np.log10(np.maximum(mass, 1)), 0.0)
                own = model.score(e, one, two) + tail[code]
                ints = lambda x: pa.array(np.rint(sums(x, starts)).astype(np.int64))
                yield batch(b.slice(i, j - i), 0, [ints(np.ones(len(code))), ints(count[code] > 0), pa.array(sums(plain[code], starts)), pa.array(sums(own, starts)), *[pa.nulls(j - i, t) for t in (pa.string(), pa.int64())]])
                far = np.flatnonzero(count[code] < 0)
                if len(far):
                    pair, times = np.unique(each_text(starts)[far] * len(names) + code[far], return_counts=True)
                    spelled = pa.array(names, pa.string()).take(pa.array(pair % len(names)))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), b.schema.field("id").type), pa.array(row[i + pair // len(names)]), *[pa.nulls(len(pair), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], spelled, pa.array(times)], cols)

    def batch(b: pa.RecordBatch, _: int, rest: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), *rest], cols)

    cols = ["id", "row", "n_tokens", "n_known", "base", "own", "word", "times"]
    kind = rows.dtypes[0][1]
    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, f"id {kind}, row long, n_tokens long, n_known long, base double, own double, word string, times long")
    scored = ws.save(scored, "scored")
    far = scored.where("word IS NOT NULL").select(F.col("row").alias("far_row"), F.col("word").alias("far_word"), "times")
    far = far.join(counts, F.col("far_word") == F.col("word")).groupBy("far_row").agg(F.sum("times").alias("far_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("far_base"))
    out = scored.where("word IS NULL").join(far, F.col("row") == F.col("far_row"), "left")
    more = F.coalesce("far_base", F.lit(0.0))
    return out.select(
        "id", (remainder("id", folds) == held_out).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(base))).alias("base_score"), (F.col("own") + more).alias("score"),
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")

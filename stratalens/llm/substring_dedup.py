"""Substring dedup with a log-structured fingerprint index.

Every window of `words` words that contains a repeat contains, at the same place, the smallest of its word n-gram
hashes; those smallest hashes are what the index holds. The index is a list of immutable runs; a run has, for each
bucket of the hash space, one sorted array of hashes with counts. A batch becomes a sorted run, is merge-joined bucket
by bucket with the runs before it, and hashes seen twice are hits. When the runs are more than `fanout`, compaction
merges them into one. An index with a path outlives its process: a manifest lists the runs that count.

To judge texts, hits set bits in a bitmap whose size has a bound; a reading of the texts hashes in full only windows
whose smallest hash may be a hit. Windows with equal hashes are compared: those of one task word by word at once; others
as spans. A span is a stretch of windows of one text whose partner (the first place with the same hash, for that one the
second) is a stretch of another; the bytes of both are read again and compared by their SHA-256. Should any two differ,
the hashes collided, and all windows are hashed anew with other constants until none do. Words that repeats cover are
removed; windows are judged on the input.

Words are bytes between white space, unchanged. Null and empty texts have no words. A document shorter than a window
loses nothing. Repeated rows repeat all their windows, as any two documents do. An empty table gives no rows. Extra
columns are not read. A file of 2**32 rows or more is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import FILE, ROW, Workspace, addressable, as_text, bitmap, documents, hash_strings, maybe_in, mix, slices, tidy, words_of


@dataclass(frozen=True)
class SubstringParams:
    words: int = 35
    gram: int = 18
    batches: int = 5
    fanout: int = 4
    bucket_rows: int = 60_000  # hashes in a bucket, about
    max_bits: int = 31  # of the bitmap
    first_bits: int = 96  # of a window's hash that count at first; tests take fewer, so that they collide


_STEP = np.random.default_rng(2).integers(0, 1 << 64, 4, np.uint64, endpoint=False) | np.uint64(1)


def grams(w: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of each n consecutive words, by doubling."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    out, have, part, size, step = None, 0, w, 1, np.array([base])  # an array, as its products wrap around
    while True:
        if n & size:
            out = part if out is None else out[: len(w) - have - size + 1] * step + part[have : have + len(w) - have - size + 1]
            have += size
        if size * 2 > n:
            return mix(out)
        part = part[: len(part) - size] * step + part[size:]
        step, size = step * step, size * 2


def sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """f (minimum or maximum) over each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(w: np.ndarray, starts: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, each window's smallest, which windows lie in one text)."""
    g = grams(w, p.gram, _STEP[1])
    small = sliding(np.minimum, g, p.words - p.gram + 1) if len(w) >= p.words else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = of[: len(small)] == of[p.words - 1 :] if len(small) else np.zeros(0, bool)
    return g, small, whole


def chosen(g: np.ndarray, small: np.ndarray, whole: np.ndarray, p: SubstringParams) -> np.ndarray:
    """The hashes that are smallest of some window, once for each place."""
    if not len(small):
        return np.zeros(0, np.uint64)
    pad = np.zeros(p.words - p.gram, np.uint64)
    top = sliding(np.maximum, np.concatenate([pad, np.where(whole, small, 0), pad]), p.words - p.gram + 1)
    return g[top == g]


def _blobs(bucket: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """rows, sorted by bucket, as one blob per bucket."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[cut].tolist(), [r.tobytes() for r in np.split(rows, cut[1:])] if len(cut) else []


_RUN = np.dtype([("h", "<u8"), ("n", "<u4")])
_WINDOW = np.dtype([("h", "<u8"), ("v", "<u4"), ("pos", "<u4"), ("file", "<u8"), ("row", "<u4")])
#: A window and its partner; what is its own partner has been compared.
_PLACE = np.dtype([("file", "<u8"), ("row", "<u4"), ("pos", "<u4"), ("pfile", "<u8"), ("prow", "<u4"), ("ppos", "<u4")])
#: n windows in a row of one text, and where its partner's begin.
_SPAN = np.dtype([("pos", "<u4"), ("n", "<u4"), ("pfile", "<u8"), ("prow", "<u4"), ("ppos", "<u4")])


def _summed(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    out = np.empty(len(cut), _RUN)
    out["h"] = h[cut]
    out["n"] = np.minimum(np.add.reduceat(n.astype(np.int64), cut), 1 << 31) if len(cut) else 0
    return out


def _read(column: pa.ChunkedArray, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]


class FingerprintIndex:
    """Sorted immutable runs of hashes. `add` merge-joins a batch with them and makes it a run."""

    def __init__(self, spark: SparkSession, path: str | None = None, params: SubstringParams = SubstringParams()):
        self.p, self.ws = params, Workspace(spark, "fingerprints", path)
        known = self.ws.get("manifest", {}) if path else {}
        self.runs, self.made, self.bits = known.get("runs", []), known.get("made", 0), known.get("bits")

    def _note(self) -> None:
        self.ws.put("manifest", {"runs": self.runs, "made": self.made, "bits": self.bits})

    def _read(self, *columns: str) -> DataFrame:
        """Of all runs: bucket, run (sorted hashes with counts), hits (sorted hashes seen twice by the time of the run)."""
        out = self.ws.spark.createDataFrame([], _RUN_SCHEMA)
        for r in self.runs:
            out = out.union(self.ws.read(r, _RUN_SCHEMA))
        return out.select(*columns)

    def ingest(self, docs: DataFrame, text_col: str = "text") -> None:
        """Takes a batch of texts in."""
        self.add(self.fingerprints(docs.select(F.col(text_col).alias("t"))).select("bucket", "blob"))

    def fingerprints(self, rows: DataFrame, batches: int = 1) -> DataFrame:
        """(batch, bucket, blob of hashes with counts) of the texts t, dealt into batches."""
        p = self.p
        if self.bits is None:
            size = rows.select(F.sum(F.octet_length("t"))).first()[0] or 0
            self.bits = max(0, int(size / 50 / p.bucket_rows - 1).bit_length())
        bits = self.bits

        def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                texts = as_text(b.column("t"))
                for i, j in slices(texts, 1_000_000):
                    names, codes, starts = words_of(texts[i:j])
                    w = hash_strings(names)[codes]
                    h, n = np.unique(chosen(*anchors(w, starts, p), p), return_counts=True)
                    run = np.empty(len(h), _RUN)
                    run["h"], run["n"] = h, n
                    where, blobs = _blobs(_bucket(h, bits), run)
                    part = int(mix(starts[-1:].astype(np.uint64) + w[:1].sum())[0] % np.uint64(batches)) if len(w) else 0
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(where), pa.int32()), pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "bucket", "blob"])
            tidy()

        return rows.mapInArrow(index, "batch int, bucket long, blob binary")

    def add(self, batch: DataFrame) -> None:
        """batch: (bucket, blob of hashes with counts)."""

        def join(new: pa.Table, old: pa.Table) -> pa.Table:
            key = (new if new.num_rows else old).column("bucket")[0].as_py()
            parts = _read(new.column("blob"), _RUN)
            run = _summed(*(np.concatenate([x[c] for x in parts]) for c in ("h", "n"))) if parts else np.zeros(0, _RUN)
            seen = run["n"] > 1
            for past in _read(old.column("run"), _RUN):  # both sorted: a merge join
                at = np.searchsorted(past["h"], run["h"])
                at[at == len(past)] = 0
                seen = seen | (past["h"][at] == run["h"]) if len(past) else seen
            return pa.table({"bucket": [key], "run": pa.array([run.tobytes()], pa.binary()), "hits": pa.array([run["h"][seen].tobytes()], pa.binary())})

        name, self.made = f"run-{self.made}", self.made + 1
        self.ws.save(batch.groupBy("bucket").cogroup(self._read("bucket", "run").groupBy("bucket")).applyInArrow(join, _RUN_SCHEMA), name)
        self.runs.append(name)
        if len(self.runs) > self.p.fanout:
            self.compact()
        self._note()

    def compact(self) -> None:
        """Merges all runs into one, in finer buckets if theirs have grown."""
        held = self._read("run").select(F.sum(F.octet_length("run"))).first()[0] or 0
        bits = self.bits
        while held / _RUN.itemsize > 4 * self.p.bucket_rows << bits:
            bits += 2

        def merge(t: pa.Table) -> pa.Table:
            parts = _read(t.column("run"), _RUN)
            run = _summed(*(np.concatenate([x[c] for x in parts]) for c in ("h", "n")))
            hits = np.unique(np.concatenate([np.zeros(0, "<u8"), *_read(t.column("hits"), np.dtype("<u8"))]))
            where, runs = _blobs(_bucket(run["h"], bits), run)
            found = dict(zip(*_blobs(_bucket(hits, bits), hits)))
            return pa.table({"bucket": pa.array(where, pa.int64()), "run": pa.array(runs, pa.binary()), "hits": pa.array([found.get(k, b"") for k in where], pa.binary())})

        name, old, self.made = f"run-{self.made}", self.runs, self.made + 1
        self.ws.save(self._read("bucket", "run", "hits").groupBy("bucket").applyInArrow(merge, _RUN_SCHEMA), name)
        self.runs, self.bits = [name], bits
        self._note()
        self.ws.drop(*old)

    def hit_bits(self) -> tuple[np.ndarray, int]:
        """A bitmap of all hits and the logarithm of its size: 16 to 32 bits for each hit, up to the bound."""
        self.bits = self.bits or 0
        bits, hits = self.bits, self._read("bucket", "hits")
        n = hits.select(F.sum(F.octet_length("hits"))).first()[0] or 0
        size_bits = min(self.p.max_bits, max(20, bits + 3, int(n * 2).bit_length()))
        low = size_bits - bits

        def paint(t: pa.Table) -> pa.Table:
            own = np.zeros(1 << (low - 3), np.uint8)
            for h in _read(t.column("hits"), np.dtype("<u8")):
                slot = (h >> np.uint64(64 - size_bits)).astype(np.int64) & ((1 << low) - 1)
                np.bitwise_or.at(own, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
            return pa.table({"bucket": [t.column("bucket")[0].as_py()], "bits": pa.array([own.tobytes()], pa.binary())})

        table = np.zeros(1 << (size_bits - 3), np.uint8)  # at most 2**(max_bits - 3) bytes
        for r in hits.groupBy("bucket").applyInArrow(paint, "bucket long, bits binary").toLocalIterator():
            table[r["bucket"] << (low - 3) : (r["bucket"] + 1) << (low - 3)] = np.frombuffer(r["bits"], np.uint8)
        return table, size_bits


_RUN_SCHEMA = "bucket long, run binary, hits binary"


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _same(codes: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from a on are those from b on."""
    out = np.ones(len(a), bool)
    for k in range(n):
        out &= codes[a + k] == codes[b + k]
    return out


def _grouped(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each window's group, which windows are not the first): windows sorted by hash."""
    new = np.ones(len(windows), bool)
    new[1:] = (windows["h"][1:] != windows["h"][:-1]) | (windows["v"][1:] != windows["v"][:-1])
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(np.append(first, len(windows)))), ~new


def _places(windows: np.ndarray, partners: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Windows with their partners by groups of up to 256 rows of one file."""
    out = np.empty(len(windows), _PLACE)
    for c in ("file", "row", "pos"):
        out[c], out[f"p{c}"] = windows[c], partners[c]
    part = (out["file"] ^ (out["row"] >> np.uint32(8)).astype(np.uint64)).view(np.int64)
    order = np.argsort(part, kind="stable")
    return _blobs(part[order], out[order])


def repeats(rows: DataFrame, index: FingerprintIndex, table, size_bits: int, attempt: int, ws: Workspace) -> DataFrame:
    """(file, row, blob of spans) of windows that occur elsewhere too, unless their hashes collide. rows: t, file, row."""
    p, bits = index.p, max(1, index.bits)
    strong = attempt or p.first_bits >= 96

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap_ = table.value
        for b in batches:
            texts = as_text(b.column("t"))
            file, row = np.asarray(b.column("file")).view(np.uint64), np.asarray(b.column("row"))
            if len(row) and row.max() >= 1 << 32:
                raise ValueError("a file has too many rows")
            for i, j in slices(texts, 1_000_000):
                names, codes, starts = words_of(texts[i:j])
                w = hash_strings(names)[codes]
                _, small, whole = anchors(w, starts, p)
                slot = (small >> np.uint64(64 - size_bits)).astype(np.int64)
                at = np.flatnonzero(whole & (bitmap_[slot >> 3] >> (slot & 7) & 1 > 0))
                out = np.empty(len(at), _WINDOW)
                w = hash_strings(names, attempt)[codes] if attempt else w
                out["h"] = grams(w, p.words, _STEP[2])[at]
                out["v"] = grams(w, p.words, _STEP[3])[at] >> np.uint64(32)
                if not strong:
                    out["h"], out["v"] = out["h"] >> np.uint64(64 - p.first_bits) << np.uint64(64 - p.first_bits), 0
                doc = np.searchsorted(starts, at, "right") - 1
                out["pos"], out["file"], out["row"] = at - starts[doc], file[i + doc], row[i + doc]
                order = np.lexsort((out["v"], out["h"])) if not strong else np.argsort(out["h"], kind="stable")
                out, at = out[order], at[order]
                # what repeats right here is compared right here; of such a group only the first goes on to meet others
                lead, later = _grouped(out)
                member = np.flatnonzero(later)
                member = member[_same(codes, at[member], at[lead[member]], p.words)]
                known = np.unique(np.concatenate([member, lead[member]]))
                on = np.ones(len(out), bool)
                on[member] = False
                places = _places(out[known], out[known])
                out = out[on]
                where, blobs = _blobs(_bucket(out["h"], bits), out)
                over = [x & ((1 << bits) - 1) for x in places[0]]  # places only pass through a bucket
                yield pa.RecordBatch.from_arrays([pa.array([*where, *over], pa.int64()), pa.array([*[None] * len(where), *places[0]], pa.int64()), pa.array([*blobs, *places[1]], pa.binary())], ["bucket", "part", "blob"])
        tidy()

    def meet(t: pa.Table) -> pa.Table:
        own = t.filter(pc.is_null(t.column("part")))
        past = t.filter(pc.is_valid(t.column("part"))).select(["part", "blob"])
        every = np.concatenate([np.zeros(0, _WINDOW), *_read(own.column("blob"), _WINDOW)])
        every = every[np.argsort(every["h"], kind="stable")]
        again = every["h"][1:] == every["h"][:-1]
        every = every[np.concatenate([again, [False]]) | np.concatenate([[False], again])] if len(every) else every
        every = every[np.lexsort((every["pos"], every["row"], every["file"], every["v"], every["h"]))]
        partner, later = _grouped(every)
        alone = ~later & ~np.append(later[1:], False) if len(every) else later
        partner[~later] += 1
        at = np.flatnonzero(~alone)
        part, blobs = _places(every[at], every[partner[at]])
        return pa.concat_tables([pa.table({"part": pa.array(part, pa.int64()), "blob": pa.array(blobs, pa.binary())}), past])

    def gather(t: pa.Table) -> pa.Table:
        every = np.concatenate(_read(t.column("blob"), _PLACE))
        known = (every["file"] == every["pfile"]) & (every["row"] == every["prow"]) & (every["pos"] == every["ppos"])
        every = every[np.lexsort((~known, every["pos"], every["row"], every["file"]))]
        step = lambda *cs: np.any([every[c][1:] != every[c][:-1] for c in cs], axis=0)
        every = every[np.concatenate([[True], step("file", "row", "pos")])]  # of two entries for a place the one that is known
        text = np.concatenate([[True], step("file", "row")])
        known = (every["file"] == every["pfile"]) & (every["row"] == every["prow"]) & (every["pos"] == every["ppos"])
        new = text | np.concatenate([[True], step("pfile", "prow") | (every["pos"][1:] != every["pos"][:-1] + 1) | (every["ppos"][1:] != every["ppos"][:-1] + 1) | (known[1:] != known[:-1])])
        cut = np.flatnonzero(new)
        spans = np.empty(len(cut), _SPAN)
        spans["n"] = np.diff(np.append(cut, len(every)))
        for c in ("pos", "pfile", "prow", "ppos"):
            spans[c] = every[c][cut]
        first = np.flatnonzero(text[cut])
        blobs = [x.tobytes() for x in np.split(spans, first[1:])]
        return pa.table({"file": pa.array(every["file"][cut[first]].view(np.int64)), "row": pa.array(every["row"][cut[first]].astype(np.int64)), "spans": pa.array(blobs, pa.binary())})

    made = rows.mapInArrow(windows, "bucket long, part long, blob binary")
    places = made.groupBy("bucket").applyInArrow(meet, "part long, blob binary")
    found = ws.save(places.groupBy("part").applyInArrow(gather, "file long, row long, spans binary"), f"found-{attempt}")
    ws.release_shuffles()
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per span that is still to be compared."""
    names = ["file", "row", "pos", "n", "pfile", "prow", "ppos"]
    for b in batches:
        parts = [np.frombuffer(x.as_buffer(), _SPAN) for x in b.column("spans")]
        spans, count = np.concatenate([np.zeros(0, _SPAN), *parts]), [len(x) for x in parts]
        own = [np.repeat(np.asarray(b.column(c)), count) for c in ("file", "row")]
        cols = [*own, spans["pos"], spans["n"], np.ascontiguousarray(spans["pfile"]).view(np.int64), spans["prow"], spans["ppos"]]
        open_ = (cols[0] != cols[4]) | (cols[1] != cols[5]) | (cols[2] != cols[6])
        yield pa.RecordBatch.from_arrays([pa.array(c[open_].astype(np.int64)) for c in cols], names)


def _keep(words: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, text, digests = [], [], [], []
            for t, blob, asked in zip(as_text(b.column("t")), b.column("spans"), b.column("asked").to_pylist()):
                own = t.as_buffer().to_pybytes().split()
                n.append(len(own))
                digests.append([{**a, "sha": hashlib.sha256(b" ".join(own[a["pos"] : a["pos"] + a["n"] + words - 1])).digest()} for a in asked or ()])
                if blob.is_valid:
                    step = np.zeros(len(own) + 1, np.int64)
                    spans = np.frombuffer(blob.as_buffer(), _SPAN)
                    ends = np.minimum(spans["pos"].astype(np.int64) + spans["n"] + words - 1, len(own))
                    np.add.at(step, np.minimum(spans["pos"].astype(np.int64), len(own)), 1)
                    np.add.at(step, ends, -1)
                    live = np.cumsum(step[:-1]) == 0
                    own = [own[i] for i in np.flatnonzero(live).tolist()]
                gone.append(n[-1] - len(own))
                text.append(b" ".join(own))
            rest = [b.column(c) for c in ("id", "file", "row")]
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int64()), ("sha", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(digests, kind)], ["id", "file", "row", "n_words", "n_removed", "kept_text", "digests"])
        tidy()

    return keep


def judge(docs: DataFrame, index: FingerprintIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_text for docs: all the rows that the index has taken in, in whatever batches."""
    ws = Workspace(docs.sparkSession, "substring")
    base = addressable(docs, ws, id=id_col, t=text_col)
    table, size_bits = index.hit_bits()
    sent, attempt = docs.sparkSession.sparkContext.broadcast(table), 0
    kind = dict(base.dtypes)["id"]
    schema = f"id {kind}, file long, row long, n_words long, n_removed long, kept_text string, digests array<struct<pos: long, n: long, sha: binary>>"
    while True:
        rows = base.select("id", "t", F.xxhash64(FILE, F.lit(attempt)).alias("file"), F.col(ROW).alias("row"))
        found = repeats(rows.select("t", "file", "row"), index, sent, size_bits, attempt, ws)
        links = ws.save(found.mapInArrow(_links, "file long, row long, pos long, n long, pfile long, prow long, ppos long"), f"links-{attempt}")
        asked = links.select("file", "row", "pos", "n").union(links.select("pfile", "prow", "ppos", "n")).distinct()
        asked = asked.groupBy("file", "row").agg(F.collect_list(F.struct("pos", "n")).alias("asked"))  # distinct spans of one text
        found = found.join(asked, ["file", "row"], "left").select(F.col("file").alias("f"), F.col("row").alias("r"), "spans", "asked")
        marked = maybe_in(rows, F.xxhash64("file", "row"), bitmap(found, F.xxhash64("f", "r"), 24), 24)
        rest = marked.where("maybe").join(found, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left").select("id", "t", "file", "row", "spans", "asked")
        judged = ws.save(rest.mapInArrow(_keep(index.p.words), schema), f"judged-{attempt}")
        digest = judged.select(F.col("file").alias("f"), F.col("row").alias("r"), F.explode("digests").alias("d")).select("f", "r", F.col("d.pos").alias("at"), F.col("d.n").alias("m"), "d.sha")
        own = links.join(digest, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")) & (F.col("pos") == F.col("at")) & (F.col("n") == F.col("m")))
        own = own.select("pfile", "prow", "ppos", "n", F.col("sha").alias("mine")).distinct()
        both = own.join(digest, (F.col("pfile") == F.col("f")) & (F.col("prow") == F.col("r")) & (F.col("ppos") == F.col("at")) & (F.col("n") == F.col("m")))
        if not both.where("mine <> sha").limit(1).count():
            break
        ws.drop(f"found-{attempt}", f"links-{attempt}", f"judged-{attempt}")
        attempt += 1
    clear = marked.where("NOT maybe").select("id", "t", "file", "row", F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<struct<pos: long, n: long>>").alias("asked"))
    return clear.mapInArrow(_keep(index.p.words), schema).union(judged).select("id", "n_words", "n_removed", "kept_text")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SubstringParams = SubstringParams()) -> DataFrame:
    """id, n_words, n_removed, kept_text (the words that stay, joined by one space). One table, dealt into batches."""
    index = FingerprintIndex(docs.sparkSession, None, params)
    arrived = index.ws.save(index.fingerprints(docs.select(F.col(text_col).alias("t")), params.batches), "arrived")
    for k in range(params.batches):
        index.add(arrived.where(F.col("batch") == k).select("bucket", "blob"))
    index.ws.drop("arrived")
    index.ws.release_shuffles()
    return judge(docs, index, id_col, text_col)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM p),
again AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN again USING (t)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

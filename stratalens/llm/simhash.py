"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: for each word shingle an XXH64; a bit is set if it is set in over half of them. Equal fingerprints are
one node, so copies cost nothing more. Two fingerprints that differ in few bits agree on some choice of bit blocks
(pigeonhole): each choice is a route that brings such pairs together without missing any. The number of blocks grows
with the number of fingerprints, so that groups stay small. Within a group fingerprints are sorted by Gray rank; runs of
LEAF make leaves, runs of FANOUT nodes their parents. The bits that a node's members share are factored out of them
into the node; a search adds up differences on the way down and prunes a node as soon as they exceed the limit. A group
over HEAVY is dealt into cells, each pair of its parts one cell. A group gives each member's link to the smallest of its
local component, not all pairs; components over these links are the result.

`similar_dedup` links texts by a similarity instead: five-word shingle sets with a Jaccard similarity of 0.8 or more.
Such texts differ in about 10 of 64 bits, too many for blocks that miss none at a price that grows with the rows. There
fingerprints have 128 bits, the routes are random bit masks (as many as bring a pair at the limit together with the
probability `recall`), the same index searches each group within the bits that the similarity allows, and the true
similarity of each pair found is computed from the texts before it counts. First a member of a group asks for its nearest
and its first neighbour, which in a large cluster gives a star and not all its pairs; then, with the components that these
links make, for all others that its component lacks. So each pair in a group is either compared or connected already.
Those others may be as many as pairs, so they never become rows: a first look names the members that have any, these
members' sets go to their groups, and there pairs are compared one by one; only a link that joins two components leaves.

Null texts and texts without words have fingerprint 0, linked like any other. Null ids get fingerprints and components,
but never name one, unless a component has no other. Repeated rows get equal answers. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from stratalens.llm.common import FILE, ROW, Workspace, addressable, as_text, bitmap, documents, maybe_in, mix, tidy
from stratalens.llm.graph import components


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4
    max_bits: int = 4
    group_rows: int = 256  # routes are as many as keep a random group at about so many fingerprints
    heavy_rows: int = 8192


@dataclass(frozen=True)
class SimilarParams:
    shingle: int = 5
    similarity: float = 0.8
    recall: float = 0.98  # the chance that some route brings a pair at the limit together
    slack: float = 3.0  # standard deviations that a pair at the limit may lie beyond its expected bits
    group_rows: int = 128
    heavy_rows: int = 8192
    heavy_bytes: int = 32_000_000  # of sets that one task holds at a time
    seed: int = 23

    @property
    def apart(self) -> float:
        """The chance that one bit differs, at the limit: the angle between two sets."""
        return acos(2 * self.similarity / (1 + self.similarity)) / pi

    def bits(self, n: int) -> int:
        return ceil(n * self.apart + self.slack * sqrt(n * self.apart * (1 - self.apart)))


LEAF, FANOUT = 32, 16
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle, repeats included, some at a time; of fewer words one, of no words none."""
    words = text.lower().split()  # bytes: A-Z only, and the six white space bytes only
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    a, b = [0, *ends[: n - 1].tolist()], (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    f, step = xxhash.xxh64_intdigest, 1 << 15
    for at in range(0, n, step):
        yield np.array([f(joined[i:j], 42) for i, j in zip(a[at : at + step], b[at : at + step])], np.uint64)


def _bits_over_half(parts: Iterator[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return _bits_over_half(shingle_hashes(text, shingle))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, p: SimHashParams | SimilarParams) -> DataFrame:
    """docs: id, t and, where they have them, file and row. t becomes fp, the 64 bits as a signed long; for SimilarParams
    fp and fp2, 128 bits of the set of shingles, the second half out of the hashes mixed once more, and the set's size."""
    rest, fps = [c for c in docs.columns if c != "t"], ["fp", "fp2", "size"] if isinstance(p, SimilarParams) else ["fp"]

    def bits(text: bytes) -> tuple[int, ...]:
        if len(fps) == 1:
            return (fingerprint(text, p.shingle),)
        h = shingle_set(text, p.shingle)
        return _bits_over_half([h]), _bits_over_half([mix(h + np.uint64(p.seed))]), len(h)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([bits(x.as_buffer().to_pybytes()) for x in as_text(b.column("t"))], np.uint64).reshape(-1, len(fps))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in made.T]], [*rest, *fps])
        tidy()

    kinds = dict(docs.dtypes)
    return docs.select(*rest, "t").mapInArrow(make, ", ".join([*[f"{c} {kinds[c]}" for c in rest], *[f"{c} long" for c in fps]]))


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit word in Gray order (as a signed long)."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def routes(n: int, p: SimHashParams) -> list[int]:
    """Bit masks: any two words that differ in max_bits bits or fewer agree on all bits of some mask."""
    for extra in range(1, 9):
        blocks = p.max_bits + extra
        if n >> (64 * extra // blocks) <= p.group_rows or comb(blocks + 1, extra + 1) > 500:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, extra)]


class GrayIndex:
    """The hierarchy over fingerprints sorted by Gray rank. levels[0] has the leaves, the last level the roots."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.levels = fps, []
        mask, pattern, start = np.full(len(fps), ~np.uint64(0)), fps, np.arange(len(fps))
        step = LEAF
        while True:
            at = np.arange(0, len(pattern), step)
            all_, any_, seen = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at), np.bitwise_and.reduceat(mask, at)
            self.levels.append([seen & ~(all_ ^ any_), all_, start[at], at])
            mask, pattern, start, step = self.levels[-1][0], all_ & self.levels[-1][0], start[at], FANOUT
            if len(at) <= FANOUT:
                break
        for k, level in enumerate(self.levels):  # what remains of a node's mask once its parent's bits are factored out
            up = self.levels[k + 1] if k + 1 < len(self.levels) else None
            parent = np.zeros(len(level[0]), np.uint64) if up is None else np.repeat(up[0], np.diff([*up[3], len(level[0])]))
            level.append(level[0] & ~parent)

    def near(self, asked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in asked, place in the index) of all pairs that differ in `most` bits or fewer."""
        roots = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(asked)), roots), np.tile(np.arange(roots), len(asked))
        so_far = np.zeros(len(q), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            _, pattern, _, kids, own = self.levels[k]
            so_far = so_far + np.bitwise_count((asked[q] ^ pattern[node]) & own[node])
            live = so_far <= most
            q, node, so_far = q[live], node[live], so_far[live]
            below = len(self.fps) if k == 0 else len(self.levels[k - 1][0])
            first, count = kids[node], np.append(kids, below)[node + 1] - kids[node]
            leaf = node
            q, so_far = np.repeat(q, count), np.repeat(so_far, count)
            node = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(count.sum()) if len(count) else first
            if k == 0:
                rest = ~self.levels[0][0][np.repeat(leaf, count)]
                hit = so_far + np.bitwise_count((asked[q] ^ self.fps[node]) & rest) <= most
                return q[hit], node[hit]
        raise AssertionError


def local_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its local component) for each member that isn't the smallest itself."""
    index, label = GrayIndex(fps), np.arange(len(fps))
    for at in range(0, len(fps), 512):
        i, j = index.near(fps[at : at + 512], most)
        i, j = i[i + at < j] + at, j[i + at < j]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def _by_gray_rank(rows: np.ndarray) -> np.ndarray:
    rank = rows[:, 0].copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return np.lexsort((rows[:, 1], rank))


def near_links(p: SimilarParams):
    """For a group's 128-bit fingerprints (n, 2): (member, other) with each member's nearest and first neighbour. `in_doubt` and `verified_links` have the rest."""
    one, both = p.bits(64), p.bits(128)

    def find(fps: np.ndarray, _) -> Iterator[np.ndarray]:
        fps = fps[_by_gray_rank(fps)]
        index, step = GrayIndex(np.ascontiguousarray(fps[:, 0])), max(16, min(512, 1_000_000 // len(fps)))
        for at in range(0, len(fps), step):
            i, j = index.near(fps[at : at + step, 0], one)
            i, d = i + at, np.bitwise_count(fps[i + at] ^ fps[j]).sum(1)
            ok = (d <= both) & (i != j)
            i, j, d = i[ok], j[ok], d[ok]
            pairs = []
            for order in (np.lexsort((j, d, i)), np.lexsort((j, i))):
                first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                pairs.append(np.stack([i[first], j[first]], 1))
            pairs = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
            yield fps[pairs].reshape(len(pairs), 4)

    return find


class OtherPairs:
    """Of a group's rows (fingerprint, two words; component, two words; size of the set): all pairs of two components within
    the bits, whose sizes allow the similarity, unless an earlier mask brings them together, too."""

    def __init__(self, p: SimilarParams, masks: list[int]):
        self.p, self.one, self.both = p, p.bits(64), p.bits(128)
        self.words = np.array([[m & (1 << 64) - 1, m >> 64] for m in masks], np.uint64)

    def __call__(self, rows: np.ndarray, own: np.ndarray, route: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """rows in Gray order; own: their components' numbers. (place, place) of each pair once, some at a time."""
        fps, size, members = np.ascontiguousarray(rows[:, :2]), rows[:, 4].astype(np.float64), np.bincount(own)
        if len(members) == 1:
            return
        asks = own != members.argmax()  # of each pair one at least is outside the largest component
        asked = np.flatnonzero(asks)
        index, step = GrayIndex(np.ascontiguousarray(fps[:, 0])), max(16, min(512, 1_000_000 // len(fps)))
        for at in range(0, len(asked), step):
            i, j = index.near(fps[asked[at : at + step], 0], self.one)
            i = asked[at : at + step][i]
            ok = (own[i] != own[j]) & (~asks[j] | (i < j)) & (np.minimum(size[i], size[j]) / np.maximum(np.maximum(size[i], size[j]), 1) >= self.p.similarity)
            i, j = i[ok], j[ok]
            x = fps[i] ^ fps[j]
            ok = np.bitwise_count(x).sum(1) <= self.both
            for word in self.words[:route]:
                ok &= (x & word).any(1)
            yield i[ok], j[ok]


def in_doubt(p: SimilarParams, masks: list[int]):
    """For a group's rows as OtherPairs reads them: those that have such a pair, with route and part."""
    others = OtherPairs(p, masks)

    def find(rows: np.ndarray, key: tuple) -> Iterator[np.ndarray]:
        rows = rows[_by_gray_rank(rows)]
        own = np.unique(rows[:, 2:4], axis=0, return_inverse=True)[1].reshape(-1)
        doubt = np.zeros(len(rows), bool)
        for i, j in others(rows, own, int(key[0])):
            doubt[i] = doubt[j] = True
            if doubt.all():
                break
        place = np.array([[key[0], key[1]]], np.int64).view(np.uint64)
        yield np.concatenate([rows[doubt], np.repeat(place, doubt.sum(), 0)], 1)

    return find


class Overlaps:
    """Sets of hashes by number; what only one of them holds is counted, not kept."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        every = np.sort(flat)
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        at = np.searchsorted(shared, flat)
        kept = at < len(shared)
        kept[kept] = shared[at[kept]] == flat[kept]
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(self.size)])]
        self.start, self.count, self.ids = ends[:-1], np.diff(ends), at[kept].astype(np.int32)
        self.mark = np.zeros(len(shared), bool)

    def similar(self, i: int, others: np.ndarray, least: float) -> np.ndarray:
        """Those of others whose Jaccard similarity with i is `least` or more."""
        share = lambda js, both: both / np.maximum(1, self.size[i] + self.size[js] - both)
        others = others[share(others, np.minimum(self.count[i], self.count[others])) >= least]
        if not len(others):
            return others
        own = self.ids[self.start[i] : self.start[i] + self.count[i]]
        self.mark[own] = True
        slabs = np.flatnonzero(np.diff((np.cumsum(self.count[others]) - 1).clip(0) // 1_000_000)) + 1
        both = [self._hits(js) for js in np.split(others, slabs)]
        self.mark[own] = False
        return others[share(others, np.concatenate(both)) >= least]

    def _hits(self, js: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.count[js])
        at = np.repeat(self.start[js] - ends + self.count[js], self.count[js]) + np.arange(ends[-1])
        hits = np.concatenate([[0], np.cumsum(self.mark[self.ids[at]])])
        return hits[ends] - hits[ends - self.count[js]]


def verified_links(p: SimilarParams, masks: list[int]):
    """For a group's rows as OtherPairs reads them, and their sets: (member, other) of similar pairs, as few as join all components that such pairs join."""
    others = OtherPairs(p, masks)

    def find(rows: np.ndarray, key: tuple, sets: list[np.ndarray]) -> Iterator[np.ndarray]:
        order = _by_gray_rank(rows)
        rows = rows[order]
        own = np.unique(rows[:, 2:4], axis=0, return_inverse=True)[1].reshape(-1)
        overlaps, label, links = Overlaps([sets[k] for k in order]), own.copy(), []
        for i, j in others(rows, own, int(key[0])):
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for at, js in zip(i[np.concatenate([[0], cuts])] if len(i) else [], np.split(j, cuts)):
                js = overlaps.similar(at, js[label[js] != label[at]], p.similarity)
                if len(js):
                    joined, first = np.unique(label[js], return_index=True)
                    links += [(at, k) for k in js[first]]
                    label[np.isin(label, joined)] = label[at]
        if links:
            yield rows[np.array(links), :2].reshape(len(links), 4)

    return find


def _search(find, cols: list[str], names: list[str], held: str | None = None):
    """find: what one group gives, as rows of names, some at a time. Rows have route, part, cell and cols, all longs; find
    gets these columns, the group's place and, where there is a column `held`, a set of hashes for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; a group may go over from one batch to the next."""
        group: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        key, out = None, []

        def close() -> Iterator[pa.RecordBatch]:
            own = np.concatenate(group)
            if len(own) > 1:
                for found in find(own, key, sets) if held else find(own, key):
                    if len(found):
                        out.append(found)
                    if sum(map(len, out)) > 100_000:
                        yield batch()

        def batch() -> pa.RecordBatch:
            every = np.concatenate(out).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in every.T], names)

        for b in batches:
            row = np.stack([np.asarray(b.column(c)).view(np.uint64) for c in cols], 1)
            place = [np.asarray(b.column(c)) for c in ("route", "part", "cell")]
            new = np.any([c[1:] != c[:-1] for c in place], axis=0) if len(row) > 1 else np.zeros(0, bool)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(row)]])
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                own = tuple(c[i] for c in place)
                if own != key:
                    if group:
                        yield from close()
                    key, group, sets = own, [], []
                group.append(row[i:j])
                if held:
                    sets.extend(np.frombuffer(x.as_buffer(), np.uint64).copy() for x in b.column(held)[i:j])
            if out:
                yield batch()
        if group:
            yield from close()
        if out:
            yield batch()
        if held:
            tidy()

    return run, ", ".join(f"{c} long" for c in names)


def _fps(nodes: DataFrame) -> list[str]:
    return [c for c in nodes.columns if c in ("fp", "fp2")]


def deal(dealt: DataFrame, heavy_rows: int, load: Column) -> DataFrame:
    """Adds cell: groups (route, part) whose load is over 1 are dealt into cells, so that each two members share one."""
    cols, fps = dealt.columns, _fps(dealt)
    heavy = dealt.groupBy("route", "part").agg(load.alias("load")).where("load > 1")
    heavy = heavy.select(F.col("route").alias("hr"), F.col("part").alias("hp"), F.ceil(F.col("load") * heavy_rows / (heavy_rows // 2)).cast("int").alias("parts"))
    if not heavy.limit(1).count():
        return dealt.withColumn("cell", F.lit(0))
    dealt = dealt.join(heavy, (F.col("route") == F.col("hr")) & (F.col("part") == F.col("hp")), "left")
    mine = F.pmod(F.xxhash64(*fps, F.lit(7)), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, mine) * F.col("parts") + F.greatest(x, mine))
    return dealt.select(*cols, F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))


def search_groups(nodes: DataFrame, masks: list[int], find, heavy_rows: int, names: list[str] | None = None) -> DataFrame:
    """What `find` gives for each group of nodes that agree on the bits of a mask: links unless names say other columns.
    nodes: distinct fp, or fp and fp2, for which masks have 128 bits, the upper ones for fp2; then what else `find` reads
    of them, as longs."""
    cols, fps = nodes.columns, _fps(nodes)
    words = [[m >> 64 * k & (1 << 64) - 1 for k in range(len(fps))] for m in masks]
    mask = F.array(*[F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in ws]) for ws in words])
    own = [F.col(c).bitwiseAND(F.col("mask")[k]) for k, c in enumerate(fps)]
    part = own[0] if len(own) == 1 else F.xxhash64(*own)  # groups that share a hash only have more members
    dealt = nodes.select(*cols, F.posexplode(mask).alias("route", "mask")).select(*cols, "route", part.alias("part"))
    dealt = deal(dealt, heavy_rows, F.count("*") / heavy_rows)
    order = [gray_rank(F.col("fp"))] if len(fps) == 1 else []
    dealt = dealt.repartition("route", "part", "cell").sortWithinPartitions("route", "part", "cell", *order)
    names = names or [f"{side}{k or ''}" for side in "ab" for k in range(len(fps))]
    return dealt.mapInArrow(*_search(find, cols, names)).distinct()


def links(nodes: DataFrame, p: SimHashParams) -> DataFrame:
    """Edges (a, b) that connect just what fingerprints at most max_bits apart connect. nodes: distinct fp."""
    return search_groups(nodes, routes(nodes.count(), p), lambda fps, _: [np.stack(local_links(fps[:, 0], p.max_bits), 1)], p.heavy_rows)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """id, fingerprint, component_id, in_component (rows in the component)."""
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), params), "fingerprints")
    nodes = ws.save(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "nodes")
    label = components(links(nodes.select("fp"), params), ws)
    own = nodes.join(label, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("label", "fp").alias("label"))
    least = own.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("n").alias("in_component")).withColumnRenamed("label", "l")
    own = own.join(least, F.col("label") == F.col("l")).select(F.col("fp").alias("own_fp"), "component_id", "in_component")
    out = rows.join(own, F.col("fp") == F.col("own_fp"))
    return out.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "in_component")


def sampled_routes(n: int, p: SimilarParams) -> list[int]:
    """Random masks of 128 bits, so wide that a random group has about group_rows of n fingerprints, and enough for
    `recall` of pairs at the limit that differ in a standard deviation more bits than expected."""
    wide, apart = max(4, (n // p.group_rows).bit_length()), p.apart + sqrt(p.apart * (1 - p.apart) / 128)
    count = ceil(log(1 - p.recall) / log(1 - (1 - apart) ** wide))
    rng = np.random.default_rng(p.seed)
    return [sum(1 << int(b) for b in rng.choice(128, wide, replace=False)) for _ in range(count)]


def similar_links(nodes: DataFrame, texts: DataFrame, p: SimilarParams, ws: Workspace) -> DataFrame:
    """Edges (a, b) between nodes (as 32 hex digits) whose texts have the similarity, as many as connect what such pairs
    connect. nodes: fp, fp2, size, file and row of one text; texts: t, file and row of all."""
    masks = sampled_routes(nodes.count(), p)
    near = similar_pairs(search_groups(nodes.select("fp", "fp2"), masks, near_links(p), p.heavy_rows), nodes, texts, p, ws, "near")
    label = components(near, ws)
    known = nodes.withColumn("name", _name("fp", "fp2")).join(label, F.col("name") == F.col("node"), "left").withColumn("label", F.coalesce("label", "name"))
    word = lambda at: F.conv(F.substring("label", at, 16), 16, -10).cast("long")
    known = known.select("fp", "fp2", word(1).alias("l"), word(17).alias("l2"), "size")
    doubt = ws.save(search_groups(known, masks, in_doubt(p, masks), p.heavy_rows, [*known.columns, "route", "part"]), "doubt")
    sets = sets_of(doubt.select(_name("fp", "fp2").alias("node")), nodes, texts, p, ws)
    dealt = deal(doubt, p.heavy_rows, F.greatest(F.count("*") / p.heavy_rows, F.sum("size") * 8 / p.heavy_bytes))
    dealt = dealt.join(sets, _name("fp", "fp2") == F.col("node")).drop("node")
    dealt = dealt.repartition("route", "part", "cell").sortWithinPartitions("route", "part", "cell")
    found = dealt.mapInArrow(*_search(verified_links(p, masks), known.columns, ["a", "a1", "b", "b1"], "held"))
    other = ws.save(found.select(_name("a", "a1").alias("a"), _name("b", "b1").alias("b")), "other")
    ws.drop("doubt", "asked", "sets")
    return near.union(other)


def _name(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def sets_of(named: DataFrame, nodes: DataFrame, texts: DataFrame, p: SimilarParams, ws: Workspace) -> DataFrame:
    """node, held: the set of shingles of each node that `named` (node) has."""
    asked = named.distinct()
    asked = ws.save(nodes.select(_name("fp", "fp2").alias("own"), F.col(FILE).alias("f"), F.col(ROW).alias("r")).join(asked, F.col("own") == F.col("node")).select("node", "f", "r"), "asked")
    some = maybe_in(texts, F.xxhash64(FILE, ROW), bitmap(asked, F.xxhash64("f", "r"))).where("maybe").select("t", FILE, ROW)
    some = some.join(asked, (F.col(FILE) == F.col("f")) & (F.col(ROW) == F.col("r"))).select("node", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(x.as_buffer().to_pybytes(), p.shingle).tobytes() for x in as_text(b.column("t"))], pa.binary())], ["node", "held"])

    return ws.save(some.mapInArrow(sets, "node string, held binary"), "sets")


def similar_pairs(found: DataFrame, nodes: DataFrame, texts: DataFrame, p: SimilarParams, ws: Workspace, label: str) -> DataFrame:
    """Those pairs of `found` whose texts have the similarity, as names (a, b)."""
    pairs = ws.save(found.select(_name("a", "a1").alias("a"), _name("b", "b1").alias("b")), "pairs")
    own = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, texts, p, ws)

    @arrow_udf("double")
    def jaccard(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            out = []
            for x, y in zip(left, right):
                a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both / max(1, len(a) + len(b) - both))
            yield pa.array(out, pa.float64())

    both = pairs.join(own.select(F.col("node").alias("na"), F.col("held").alias("ha")), F.col("a") == F.col("na")).join(own.select(F.col("node").alias("nb"), F.col("held").alias("hb")), F.col("b") == F.col("nb"))
    similar = ws.save(both.where(jaccard("ha", "hb") >= p.similarity).select("a", "b"), label)
    ws.drop("pairs", "asked", "sets")
    return similar


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimilarParams = SimilarParams(), place: bool = False) -> DataFrame:
    """id, component_id (smallest id), in_component, kept (one row of each component: the first by id, file, row), file and row.

    place: docs have the last two columns already, as `addressable` gives them."""
    p, ws = params, Workspace(docs.sparkSession, "similar")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), FILE, ROW) if place else addressable(docs, ws, id=id_col, t=text_col)
    rows = ws.save(fingerprints(texts, p), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", FILE, ROW, "size"))
    nodes = ws.save(rows.groupBy("fp", "fp2").agg(best.alias("rep"), F.count("*").alias("n")), "nodes")
    label = components(similar_links(nodes.select("fp", "fp2", "rep.size", f"rep.{FILE}", f"rep.{ROW}"), texts, p, ws), ws)
    own = nodes.withColumn("name", _name("fp", "fp2")).join(label, F.col("name") == F.col("node"), "left").select("fp", "fp2", "rep", "n", F.coalesce("label", "name").alias("label"))
    least = own.groupBy("label").agg(F.min("rep").alias("first"), F.sum("n").alias("in_component")).withColumnRenamed("label", "l")
    own = own.join(least, F.col("label") == F.col("l")).select(F.col("fp").alias("f1"), F.col("fp2").alias("f2"), "first", "in_component")
    out = rows.join(own, (F.col("fp") == F.col("f1")) & (F.col("fp2") == F.col("f2")))
    kept = (F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}"))
    return out.select("id", F.col("first.id").alias("component_id"), "in_component", kept.alias("kept"), FILE, ROW)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")

"""SentencePiece encoding and decoding with Gumbel top-k: distinct sampled segmentations without replacement.

The lattice of a text has a node at each character and an edge for each piece of the vocabulary; characters that no
piece has are encoded as bytes. No piece goes over the start of a word or a line feed, so the lattice falls apart into
chunks, and a segmentation of the text is one segmentation per chunk. A file of the BPE kind holds ranks, not
probabilities: the weight of a piece is -sharpness * ln(2 + rank), as words' frequencies fall with their ranks.

Sampling is A-star over the tree of prefixes, with perturbed log-probabilities as keys. The key of a node is the largest
Gumbel-perturbed log-probability below it, which the backward sums of the lattice make exact: a path is followed to its
end at once, and all that branches off it at one chunk waits in the queue as one set, whose key is a Gumbel of that
set's mass, truncated at the key above. The queue's best set gives the next segmentation. After k of them the best key
that still waits, kappa, gives the inclusion score 1 - exp(-exp(log_prob - kappa)), to weigh samples by. For long texts
it is too small for a double, so its logarithm comes beside it.

Random numbers are hashes of the row's key, the sample, the chunk and the step: reruns agree, in whatever order rows
come. Null and empty texts have one segmentation, without pieces. If a text has fewer than k segmentations, it has as
many rows. Repeated rows with one key get equal samples. Spaces become U+2581 with one before the text. `decoder` turns
ids back into texts; a U+2581 in a text comes back as a space, and round_trip is false there. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from stratalens.llm.common import as_text, documents, mix, slices, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_ALL = (1 << 64) - 1
_BASE, _SPREAD, BUCKET_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 16
#: Beyond so many levels or steps of one chunk the loops go on without numpy: a very long word is alone there.
DEEP = 256


@dataclass(frozen=True)
class SampleParams:
    k: int = 2
    sharpness: float = 1.0
    seed: int = 17
    slice_bytes: int = 1_000_000  # of text that is sampled at once
    room: int = 1_500_000  # characters whose lattices are kept; a worker's memory grows with both


class Vocabulary:
    def __init__(self, model: bytes, sharpness: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(m.get_piece_size())
        self.pieces = [m.id_to_piece(i) for i in every]
        self.byte_id = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.raw = [b"" if m.is_control(i) or m.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        self.raw_len = np.array([len(x) for x in self.raw], np.int32)
        self.raw_at = np.cumsum(self.raw_len, dtype=np.int32) - self.raw_len
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        usable = [i for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) or "\n" in self.pieces[i] for i in usable):
            raise ValueError("a piece goes over the start of a word")
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.weight = np.array([-sharpness * np.log(2 - m.get_score(i)) if i in set_ else -np.inf for set_ in [set(usable)] for i in every])
        whole = {self.pieces[i]: i for i in usable}
        self.tables = []
        for n in range(1, self.longest + 1):  # all beginnings of n characters; -1: no piece itself
            starts = sorted({p[:n] for p in whole if len(p) >= n})
            h = rolling(np.array([[ord(c) for c in x] for x in starts], np.uint64).reshape(len(starts), n))
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces have one hash")
            order = np.argsort(h * _SPREAD)
            bucket = (h[order] * _SPREAD) >> np.uint64(64 - BUCKET_BITS)
            from_ = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)).astype(np.int32)
            ids = np.array([whole.get(x, -1) for x in starts], np.int32)[order]
            self.tables.append((np.append(h[order], np.uint64(0)), np.append(ids, -2), from_, int(np.diff(from_).max())))

        self.single = np.full(max(ord(x[0]) for x in whole) + 2, -2)  # by character; the last stands for all above
        for x in whole:
            self.single[ord(x[0])] = max(self.single[ord(x[0])], whole[x] if len(x) == 1 else -1)

    def find(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """The piece of n characters with this hash; -1: only longer pieces begin so; -2: none does."""
        h, ids, from_, most = self.tables[n - 1]
        at = from_[(hashes * _SPREAD) >> np.uint64(64 - BUCKET_BITS)]
        out = np.where(h[at] == hashes, ids[at], -2)
        if most > 1:  # the others of a bucket, for what its first isn't
            rest = np.flatnonzero(out == -2)
            for k in range(1, most):
                x = np.minimum(at[rest] + k, len(h) - 1)
                hit = h[x] == hashes[rest]
                out[rest[hit]] = ids[x[hit]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: marks as spaces, without the first."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.raw)):
            raise ValueError("an id is not in the vocabulary")
        n = self.raw_len[ids]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat(self.raw_at[ids] - ends + n, n)
        at += np.arange(len(at), dtype=np.int32)
        return self.blob[at].tobytes()[1:]


def rolling(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(codes.shape[0], np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k] + np.uint64(1)
    return h


class Lattices:
    """The lattices of distinct chunks, one node per character. Edges are sorted by node, longer pieces first.

    Lattices are kept for the texts that follow, until they have `room` characters. A chunk's numbers depend on nothing
    but the chunk: what is kept changes no result."""

    NODES = {"first": np.int64, "code": np.uint32, "left": np.int32, "ways": np.float32}
    EDGES = {"piece": np.int32, "size": np.int16, "prob": np.float64, "cum": np.float64}

    def __init__(self, v: Vocabulary, room: int):
        self.v, self.room = v, room
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.start, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for name, kind in {**self.NODES, **self.EDGES}.items():
            setattr(self, name, np.zeros(1, kind))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each distinct chunk here, spaces as marks. Numbers hold until the next call."""
        if self.nodes > self.room:
            self.thin()
        out = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        length = np.fromiter(map(len, map(chunks.__getitem__, new.tolist())), np.int64, len(new))
        order = np.argsort(length, kind="stable")  # equal lengths together: few levels in most parts
        new, length = new[order], length[order]
        out[new] = len(self.known) + np.arange(len(new))
        own = [chunks[i] for i in new.tolist()]
        self.known.update(zip(own, out[new].tolist()))
        part = (np.cumsum(length) - 1).clip(0) // 150_000  # keeps what is needed meanwhile small
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            self.add(self.part(own[a:b], length[a:b], self.v))
        self.asked = np.concatenate([self.asked, np.zeros(len(self.start) - len(self.asked), np.int32)])
        self.asked[out] += 1
        return out

    def thin(self) -> None:
        """Keeps the chunks asked for most often, in half the room at most; what is dropped is made anew when it comes."""
        size = np.diff(np.append(self.start, self.nodes))
        per = np.bincount(np.minimum(self.asked, 1000), size, 1001)
        least = max(2, int(np.searchsorted(-np.cumsum(per[::-1])[::-1], -self.room / 2)))
        keep = np.flatnonzero(self.asked >= least)
        if not len(keep):
            return self.clear()
        names, size = list(self.known), size[keep]
        node = np.arange(size.sum()) + np.repeat(self.start[keep] - np.cumsum(size) + size, size)
        fan = self.first[node + 1] - self.first[node]
        edge = np.arange(fan.sum()) + np.repeat(self.first[node] - np.cumsum(fan) + fan, fan)
        got = {name: getattr(self, name)[node if name in self.NODES else edge] for name in (*self.NODES, *self.EDGES)}
        got |= {"start": np.cumsum(size) - size, "first": np.cumsum(fan) - fan}
        asked = self.asked[keep] // 2
        self.clear()
        self.add(got)
        self.known, self.asked = {names[k]: i for i, k in enumerate(keep.tolist())}, asked

    def add(self, x: dict[str, np.ndarray]) -> None:
        n, m = len(x["code"]), len(x["piece"])
        self.start = np.concatenate([self.start, x["start"] + self.nodes])
        for name in (*self.NODES, *self.EDGES):
            at, more = (self.nodes, n) if name in self.NODES else (self.edges, m)
            had = getattr(self, name)
            if len(had) < at + more + 1:
                grown = np.zeros(max(at + more + 1, len(had) * 3 // 2), had.dtype)
                grown[: at + 1] = had[: at + 1]
                setattr(self, name, had := grown)
            had[at : at + more] = x[name] + self.edges if name == "first" else x[name]
        self.nodes, self.edges = self.nodes + n, self.edges + m
        self.first[self.nodes] = self.edges

    @staticmethod
    def part(chunks: list[str], length: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
        start, total = np.cumsum(length) - length, int(length.sum())
        code = np.frombuffer("".join(chunks).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
        left = (np.repeat(start + length, length) - np.arange(total)).astype(np.int32)  # characters to the chunk's end
        found, h, at, n = [], np.zeros(total, np.uint64), np.arange(total, dtype=np.int32), 0
        single = np.zeros(total, bool)
        while len(at) and n < v.longest:
            n += 1
            h = h * _BASE + code[at + n - 1] + np.uint64(1)
            piece = v.find(n, h) if n > 1 else v.single[np.minimum(code, len(v.single) - 1)]
            hit = piece >= 0
            found.append((at[hit], piece[hit], n))
            if n == 1:
                single[at[hit]] = True
            go = (piece > -2) & (left[at] > n)
            at, h = at[go], h[go]
        bare = np.flatnonzero(~single).astype(np.int32)  # characters that are no piece: as bytes
        found.append((bare, np.full(len(bare), -1), 1))
        fan = np.zeros(total, np.int32)
        for x, *_ in found:
            fan[x] += 1
        first = np.cumsum(fan) - fan
        free, many = first.astype(np.int32), int(fan.sum())
        piece, size = np.empty(many, np.int32), np.empty(many, np.int32)
        for x, y, n in found[::-1]:  # a node's longest pieces first
            to = free[x]
            piece[to], size[to] = y, n
            free[x] += 1
        node = np.repeat(np.arange(total, dtype=np.int32), fan)
        weight = np.where(piece >= 0, v.weight[piece], -20.0)
        ahead = np.where(left[node] == size, total, node + size)  # the end of all chunks: nothing lies beyond, one way
        beta, ways = np.zeros(total + 1), np.ones(total + 1)
        prob = np.empty(len(node))
        most = int(left.max(initial=0))
        level = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")  # short integers sort fast
        cuts = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=most + 1)[1:])]) if total else np.zeros(1, np.int64)
        for a, b in zip(cuts[: DEEP + 1], cuts[1 : DEEP + 1]):  # from the chunks' ends to their starts
            x = level[a:b]
            if not len(x):
                continue
            n = fan[x]
            cut = np.cumsum(n) - n
            e = np.arange(n.sum()) + np.repeat(first[x] - cut, n)
            to = ahead[e]
            s = weight[e] + beta[to]
            top = np.maximum.reduceat(s, cut)
            y = np.exp(s - np.repeat(top, n))
            sum_ = np.add.reduceat(y, cut)
            beta[x] = top + np.log(sum_)
            prob[e] = y / np.repeat(sum_, n)
            ways[x] = np.minimum(np.add.reduceat(ways[to], cut), 1e300)
        for x in level[cuts[DEEP] :].tolist() if most > DEEP else []:  # a few nodes a level: the same, one by one
            a, b = int(first[x]), int(first[x] + fan[x])
            to = ahead[a:b].tolist()
            own = [w + beta.item(t) for w, t in zip(weight[a:b].tolist(), to)]
            top = max(own)
            y = [math.exp(v - top) for v in own]
            sum_ = math.fsum(y)
            beta[x] = top + math.log(sum_)
            prob[a:b] = [v / sum_ for v in y]
            ways[x] = min(sum(ways.item(t) for t in to), 1e300)
        cum, x, k = prob.copy(), np.flatnonzero(fan > 1), 1
        while len(x):  # each node's own running sums
            cum[first[x] + k] += cum[first[x] + k - 1]
            k += 1
            x = x[fan[x] > k]
        cum[first + fan - 1] = 2.0  # the last edge takes what rounding leaves
        return {"start": start, "first": first, "code": code, "left": left, "ways": np.minimum(ways[:-1], 1e30), "piece": piece, "size": size, "prob": prob, "cum": cum}

    def sample(self, chunk: np.ndarray, uniform) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One free segmentation for each occurrence: (log-probability, where its edges start and the end, edges)."""
        pos, occ, logp = self.start[chunk], np.arange(len(chunk)), np.zeros(len(chunk))
        steps, step = [], 0
        while len(occ) and step < DEEP:
            u, edge = uniform(occ, step), self.first[pos]
            open_ = np.flatnonzero(self.cum[edge] <= u)
            while len(open_):
                edge[open_] += 1
                open_ = open_[self.cum[edge[open_]] <= u[open_]]
            logp[occ] += np.log(self.prob[edge])
            steps.append((occ, edge))
            n = self.size[edge]
            go = np.flatnonzero(self.left[pos] > n)
            occ, pos, step = occ[go], pos[go] + n[go], step + 1
        for o, at in zip(occ.tolist(), pos.tolist()):  # very long words: a few, one by one
            edges, n = [], DEEP
            while at >= 0:
                for u in uniform(o, np.arange(n, n + 4096)).tolist():
                    e = self.first.item(at)
                    while self.cum.item(e) <= u:
                        e += 1
                    edges.append(e)
                    at = at + self.size.item(e) if self.left.item(at) > self.size.item(e) else -1
                    if at < 0:
                        break
                n += 4096
            logp[o] += np.log(self.prob[edges]).sum()
            steps += [(np.array([o]), np.array([e])) for e in edges] if len(edges) < DEEP else [(np.full(len(edges), o), np.array(edges))]
        return (logp, *in_order([s[0] for s in steps], [s[1] for s in steps], len(chunk)))

    def rest(self, chunk: int, taken: list[list[int]]) -> list:
        """The tree of the segmentations taken. A node: [character, probability from here on of all but those taken, {length: node or None}]."""
        root = [int(self.start[chunk]), 0.0, {}]
        nodes = [root]
        for lengths in taken:
            node = root
            for n in lengths[:-1]:
                if n not in node[2]:
                    node[2][n] = [node[0] + n, 0.0, {}]
                    nodes.append(node[2][n])
                node = node[2][n]
            node[2][lengths[-1]] = None
        for node in reversed(nodes):
            node[1] = sum(self._open(node[0], node)[1])
        return root

    def _open(self, pos: int, node: list | None) -> tuple[list[int], list[float]]:
        """The edges' lengths, and of each edge's probability what isn't taken."""
        a, b = self.first.item(pos), self.first.item(pos + 1)
        size, prob = self.size[a:b].tolist(), self.prob[a:b].tolist()
        for k, n in enumerate(size):
            if node is not None and n in node[2]:
                prob[k] *= 0.0 if node[2][n] is None else node[2][n][1]
        return size, prob

    def sample_other(self, chunk: int, taken: list[list[int]], uniform) -> tuple[float, list[int]]:
        """A segmentation other than those taken (as lengths), each with its probability among the rest."""
        node, pos, out, logp, step = self.rest(chunk, taken), int(self.start[chunk]), [], 0.0, 0
        while True:
            size, prob = self._open(pos, node)
            want, k = uniform(step) * sum(prob), 0
            while k + 1 < len(size) and want >= prob[k]:
                want -= prob[k]
                k += 1
            while prob[k] == 0.0:  # where rounding has led to what is taken
                k -= 1
            n = size[k]
            logp += math.log(self.prob.item(self.first.item(pos) + k))
            out.append(n)
            node = node[2].get(n) if node is not None else None
            if self.left.item(pos) <= n:
                return logp, out
            pos, step = pos + n, step + 1

    def edges_of(self, chunk: int, lengths: list[int]) -> np.ndarray:
        pos, out = int(self.start[chunk]), []
        for n in lengths:
            out.append(next(e for e in range(self.first[pos], self.first[pos + 1]) if self.size[e] == n))
            pos += n
        return np.array(out)

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, ids per edge): an edge without a piece is as many byte pieces as its character has bytes."""
        ids, n = self.piece[edges].astype(np.int64), np.ones(len(edges), np.int64)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, n
        code, where = np.unique(self.code[np.searchsorted(self.first[: self.nodes + 1], edges[bare], "right") - 1], return_inverse=True)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()]
        n[bare] = np.array([len(r) for r in raw])[where]
        out = np.repeat(ids, n)
        first = np.cumsum(n) - n
        for k in range(4):
            has = np.flatnonzero(n[bare] > k)
            out[first[bare[has]] + k] = self.v.byte_id[np.array([r[k] if len(r) > k else 0 for r in raw])[where[has]]]
        return out, n


@functools.lru_cache(maxsize=1)
def lattices(model: bytes, sharpness: float, room: int) -> Lattices:
    """Workers stay for the tasks that follow, and so does this."""
    return Lattices(Vocabulary(model, sharpness), room)


def in_order(occ: list[np.ndarray], values: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of step after step, put in the order of occurrence, then step. Step s of an occurrence follows s - 1."""
    count = np.zeros(n, np.int64)
    for o in occ:
        count += np.bincount(o, minlength=n) if len(o) > n // 8 else 0
        if len(o) <= n // 8:
            np.add.at(count, o, 1)
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for o, x in zip(occ, values):
        if len(o) > 1 and o[0] == o[-1]:  # steps of one occurrence
            out[at[o[0]] + np.arange(len(o))] = x
            at[o[0]] += len(o)
        else:
            out[at[o]] = x
            at[o] += 1
    return np.append(np.cumsum(count) - count, len(out)), out


def gumbel_below(mass: np.ndarray, cap: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels with location `mass`, truncated at `cap`."""
    with np.errstate(divide="ignore"):
        return np.where(mass == -np.inf, -np.inf, -np.logaddexp(-cap, np.log(-np.log(u)) - mass))


def chunks(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts, marks as spaces, and how many each text has. A chunk starts where spaces do, and at and after a line feed."""
    marked = pc.replace_substring(texts, MARK, " ").cast(pa.large_string())
    marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), marked, pa.scalar(" ", pa.large_string())))
    marked = marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked
    at = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[: at[-1]]
    space, feed = data == 32, data == 10
    begin = feed.copy()
    begin[1:] |= feed[:-1] | space[1:] & ~space[:-1]
    begin[at[:-1][at[:-1] < at[1:]]] = True
    begin[: at[0]] = False
    starts = np.append(np.flatnonzero(begin), len(data))
    cut = np.searchsorted(starts[:-1], at)
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode(), np.diff(cut)


def gumbel_one(mass: float, cap: float, u: float) -> float:
    """As gumbel_below."""
    a, b = -cap, math.log(-math.log(u)) - mass
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


def segment(keys: np.ndarray, texts: pa.Array, lat: Lattices, p: SampleParams) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text its samples: (log_prob, perturbed log_prob, log of the inclusion score, piece ids)."""
    coded, count = chunks(texts)
    first = np.cumsum(count) - count
    code = lat.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(code)) - first[doc]
    key = mix(keys.astype(np.uint64) ^ np.uint64(p.seed))

    own_key = key[doc] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # of each occurrence

    def draw(keys: np.ndarray, sample: int, step: int | np.ndarray) -> np.ndarray:
        if isinstance(step, np.ndarray):
            step = (step + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(sample * 0x632BE59BD9B4E019 & _ALL)
        else:
            step = np.uint64((sample * 0x632BE59BD9B4E019 + (step + 1) * 0xA0761D6478BD642F) & _ALL)
        h = mix(keys + step)
        return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)

    def one(at: int, sample: int, step: int) -> float:  # as draw
        h = (own_key.item(at) + sample * 0x632BE59BD9B4E019 + (step + 1) * 0xA0761D6478BD642F) & _ALL
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & _ALL
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & _ALL
        return ((h ^ h >> 33) >> 11) / (1 << 53) + 0.5 / (1 << 53)

    full = np.arange(len(texts))
    none = count == 0
    cap = -np.log(-np.log(draw(key, 0, -2)))  # the largest key of all
    found: list[list[dict]] = [[] for _ in texts]
    queue: list[list[tuple]] = [[] for _ in texts]
    # a turn follows one path in each text: from chunk `at` on freely, what comes before as its parent has it
    turn = [(d, 0, None) for d in full[~none].tolist()]  # (text, first free chunk, what the path continues)
    for sample in range(p.k):
        ds = np.array([t[0] for t in turn], np.int64)
        at = np.array([t[1] for t in turn], np.int64)
        n = count[ds] - at
        begin = np.cumsum(n) - n
        occ = np.arange(n.sum()) + np.repeat(first[ds] + at - begin, n)
        keys_ = own_key[occ]
        logp, edge_at, edges = lat.sample(code[occ], lambda o, step: draw(keys_[o], sample, step))
        before = np.array([0.0 if t[2] is None else t[2]["phi"] for t in turn])
        top = np.array([cap[t[0]] if t[2] is None else t[2]["key"] for t in turn])
        need = p.k - sample  # of one path no more sets than this can still be asked for
        for k, (d, a, parent) in enumerate(turn):
            lo, hi = int(begin[k]), int(begin[k] + n[k])
            # each text by itself: the numbers don't depend on the texts beside it
            phi = float(before[k]) + float(logp[lo:hi].sum())
            me = {"parent": parent, "from": a, "edges": edges, "edge_at": edge_at, "lo": lo, "hi": hi, "log_prob": phi, "key": float(top[k])}
            found[d].append(me)
        for k, i, key_, phi0 in branches(lat, code, occ, begin, n, logp, before, top, lambda o: draw(keys_[o], sample, -3), need):
            d, a, _ = turn[k]
            heapq.heappush(queue[d], (-key_, sample, a + i, found[d][-1], phi0, 1))
        if sample + 1 == p.k:
            break
        turn = []
        for d in full[~none].tolist():
            if not queue[d]:
                continue
            score, _, i, me, phi0, gone = heapq.heappop(queue[d])
            c = int(code[first[d] + i])
            taken = me["taken"] if "taken" in me and me["at"] == i else [self_lengths(me, i, lat)]
            lp, lengths = lat.sample_other(c, taken, lambda step: one(first[d] + i, sample + 1, step + 1000))
            turned = {"parent": me["parent"] if "taken" in me and me["at"] == i else me, "at": i, "lengths": lengths, "phi": phi0 + lp, "key": -score}
            rest = float(lat.rest(c, [*taken, lengths])[1])
            if gone + 1 < lat.ways[lat.start[c]] and rest > 0:
                base = me if not ("taken" in me and me["at"] == i) else me["base"]
                again = {"taken": [*taken, lengths], "at": i, "base": base, "parent": base}
                value_ = gumbel_one(phi0 + math.log(rest), -score, one(first[d] + i, sample + 1, -4))
                heapq.heappush(queue[d], (-value_, sample + 0.5, i, again, phi0, gone + 1))
            turn.append((d, i + 1, turned))
    paths = [path_edges(s, lat, code, first[d]) for d, samples in enumerate(found) for s in samples]
    ids, n = lat.ids(np.concatenate(paths)) if paths else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.cumsum(n)[np.cumsum([len(x) for x in paths]) - 1].tolist() if paths else []
    out, at, k = [], 0, 0
    for d, samples in enumerate(found):
        kappa, rows = -queue[d][0][0] if queue[d] else -np.inf, []
        for s in samples:
            rows.append((s["log_prob"], s["key"], log_inclusion(s["log_prob"], kappa), ids[at : ends[k]]))
            at, k = ends[k], k + 1
        out.append(rows if count[d] else [(0.0, float(cap[d]), 0.0, np.zeros(0, np.int64))])
    return out


def log_inclusion(log_prob: float, kappa: float) -> float:
    """ln(1 - exp(-exp(log_prob - kappa))), which a long text's tiny probabilities don't bring to ln(0)."""
    x = log_prob - kappa
    if kappa == -math.inf or x > 3.5:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def branches(lat: Lattices, code: np.ndarray, occ: np.ndarray, begin: np.ndarray, n: np.ndarray, logp: np.ndarray, before: np.ndarray, top: np.ndarray, uniform, need: int) -> Iterator[tuple[int, int, float, float]]:
    """For each path its `need` best sets that branch off it: (path, chunk of it, key, log-probability before the chunk)."""
    k, wide = np.flatnonzero(n), 64
    while len(k):
        # Below exp(-120) of its start a path's sets are beyond the reach of doubles: one before them has exp(-70) or more.
        inside = np.arange(wide) < n[k][:, None]
        place = np.where(inside, begin[k][:, None] + np.arange(wide), 0)
        after = before[k][:, None] + np.cumsum(np.where(inside, logp[place], 0.0), 1)
        above = np.concatenate([before[k][:, None], after[:, :-1]], 1)
        go_on = (n[k] > wide) & (after[:, -1] > before[k] - 120)
        x, y = np.nonzero(inside & (above > before[k][:, None] - 120) & ~go_on[:, None])
        own = place[x, y]
        left = np.where(lat.ways[lat.start[code[occ[own]]]] > 1, np.maximum(-np.expm1(logp[own]), 1e-15), 0.0)
        with np.errstate(divide="ignore"):
            mass = above[x, y] + np.log(left)
        waiting = np.full(inside.shape, -np.inf)
        waiting[x, y] = gumbel_below(mass, top[k][x], uniform(own))
        best = np.argsort(-waiting, 1, kind="stable")[:, :need] if need > 1 else waiting.argmax(1)[:, None]
        i, j = np.nonzero(np.take_along_axis(waiting, best, 1) > -np.inf)
        c = best[i, j]
        yield from zip(k[i].tolist(), c.tolist(), waiting[i, c].tolist(), above[i, c].tolist())
        k, wide = k[go_on], wide * 4


def self_lengths(path: dict, i: int, lat: Lattices) -> list[int]:
    """The lengths by which a path cuts chunk i of its text."""
    while path is not None and not ("edges" in path and i >= path["from"]):
        if "lengths" in path and path["at"] == i:
            return path["lengths"]
        path = path["parent"]
    at = path["edge_at"][path["lo"] + i - path["from"] :]
    return lat.size[path["edges"][at[0] : at[1]]].tolist()


def path_edges(path: dict, lat: Lattices, code: np.ndarray, first: int) -> np.ndarray:
    """All edges of a path, the parts before it branched off from its parents."""
    parts, end = [], None
    while path is not None:
        if "edges" in path:
            stop = path["hi"] if end is None else path["lo"] + max(0, end - path["from"])
            parts.append(path["edges"][path["edge_at"][path["lo"]] : path["edge_at"][stop]])
            end = path["from"] if end is None else min(end, path["from"])
        elif "lengths" in path:
            if end is None or path["at"] < end:
                parts.append(lat.edges_of(int(code[first + path["at"]]), path["lengths"]))
                end = path["at"]
        path = path["parent"]
    return np.concatenate(parts[::-1])


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SampleParams = SampleParams(), model_file: str = MODEL) -> DataFrame:
    """One row per sample: id, sample (from 1), n_pieces, log_prob, perturbed, inclusion and its logarithm log_inclusion, round_trip (whether decoding gives the text back), ids."""
    p = params
    sent = docs.sparkSession.sparkContext.broadcast(open(model_file, "rb").read())  # the model's file: fixed size
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(text_col).alias("t"))
    names = ["id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "log_inclusion", "round_trip", "ids"]
    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(sent.value, p.sharpness, p.room)
        for b in batches:
            texts, keys = as_text(b.column("t")), np.asarray(b.column("key")).view(np.uint64)
            for i, j in slices(texts, p.slice_bytes):
                row, cols, every = [], [[] for _ in kinds], []
                for k, samples in enumerate(segment(keys[i:j], texts[i:j], lat, p)):
                    own = texts[i + k].as_buffer().to_pybytes()
                    for s, (log_prob, perturbed, log_score, ids) in enumerate(samples):
                        row.append(i + k)
                        every.append(ids)
                        for x, y in zip(cols, (s + 1, len(ids), log_prob, perturbed, math.exp(log_score), log_score, lat.v.decode(ids) == own)):
                            x.append(y)
                ends = np.cumsum([0, *map(len, every)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(every).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds)), ids], names)
                del cols, row, every, ids
            tidy()

    kind = rows.dtypes[0][1]
    return rows.mapInArrow(run, f"id {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double, round_trip boolean, ids array<int>")


def decoder(spark: SparkSession, model_file: str = MODEL):
    """A column function ids -> text. Null ids give null; no ids the empty text; bytes that are no UTF-8 U+FFFD. An id that the vocabulary lacks is an error."""
    sent = spark.sparkContext.broadcast(open(model_file, "rb").read())

    @arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = lattices(sent.value, SampleParams.sharpness, SampleParams.room).v
        for column in parts:
            yield pa.array([v.decode(np.asarray(x.values)).decode(errors="replace") if x.is_valid else None for x in column], pa.string())

    return decode


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")

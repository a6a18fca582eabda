"""Each operator against a brute-force version, and on the awkward cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import gc
import hashlib
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalens.llm import exact_dedup, langid, maxent_lm, mixing, queries, simhash, substring_dedup, token_counts, toxicity, vafile
from stratalens.llm import sentencepiece_sampling as sp
from stratalens.llm.common import mix

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, row long, id string, t string, size long, fp long, keep_id long"
LONG = " ".join(f"w{i % 977} x{i * 7 % 1009}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "Hello  world\tagain", "en", "a"), (2, "Hello world again", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n", "en", None), (6, LONG, "en", "a"), (7, LONG + " end", "de", "a"), (2, "Hello world again", "en", "a"),
    (None, "Hello world again", "en", "a"), (9, "12 34 !!", "fr", "b"), (10, PASSAGE + " and more", "en", "b"), (11, "before " + PASSAGE, "en", "b"), (12, "repeat " * 80, "en", "b"), (13, "ÀÉ ünï x 😀", "fr", "b"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0, 9.0, "w", 3, "x", "y", 1, 2, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("t") / "docs")
    docs(spark).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).cache()


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_exact_dedup(some, none):
    got = exact_dedup.exact_dedup(some).collect()
    want = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    assert len(got) == len(ROWS)
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((x for x in ids if x is not None), default=None)
    assert sum(r.kept for r in got) == len(want)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_clashing_digest_and_increments(spark, some):
    weak = lambda t: (F.length(t) % 2).cast("string")
    run = exact_dedup.StreamingExactDedup(spark, digest=weak)
    run.ingest(some)
    assert run.decisions().where("kept").count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in ROWS})
    run = exact_dedup.StreamingExactDedup(spark)
    run.ingest(some.where("doc_id <= 4"))
    run.ingest(some.where("doc_id > 4 OR doc_id IS NULL"))
    assert run.decisions().where("kept").count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in ROWS})


def test_exact_dedup_reopened(spark, some, tmp_path):
    """Batches taken in by new objects over the same path; digests clash between batches, too."""
    weak = lambda t: F.when(t == "", "e").otherwise(F.substring(t, 1, 5))
    want = sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(some).collect())
    parts = [some.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(3)) == k) for k in range(3)]
    for k, part in enumerate(parts):
        exact_dedup.StreamingExactDedup(spark, str(tmp_path / "a"), digest=weak).ingest(part)
    run = exact_dedup.StreamingExactDedup(spark, str(tmp_path / "a"), digest=weak)
    got = run.decisions().collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want and len(run.texts) == 3
    assert sum(r.kept for r in got) == len({x[3] for x in want})
    run._note(pending=True)  # as if the fourth had been cut short
    again = exact_dedup.StreamingExactDedup(spark, str(tmp_path / "a"), digest=weak)
    again.ingest(some.limit(3))  # not straight from files
    assert again.decisions().count() == len(ROWS) + 3 and again.decisions().where("kept").count() == len({x[3] for x in want})


def brute_fp(t):
    w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, some, none):
    got = simhash.simhash_dedup(some).collect()
    fp = {(r.id, r.fingerprint) for r in got}
    assert fp == {(i, f"{brute_fp(t):016x}") for i, t, *_ in ROWS} and len(got) == len(ROWS)
    assert {r.component_id for r in got if int(r.fingerprint, 16) == 0} == {3}
    assert simhash.simhash_dedup(none).count() == 0 and simhash.similar_dedup(none).count() == 0


def test_simhash_components_of_a_table(spark):
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, D).collect()}
    ids = sorted(got)
    fps = np.array([int(got[i].fingerprint, 16) for i in ids], np.uint64)
    assert all(f"{brute_fp(r.text):016x}" == got[r.doc_id].fingerprint for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    near, lab = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, np.arange(len(ids))
    while True:
        new = np.array([lab[x].min() for x in near])
        if (new == lab).all():
            break
        lab = new
    assert [got[i].component_id for i in ids] == [ids[k] for k in lab]


def shingle_sets(rows, k=5):
    out = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def similar_pairs(sets, least=0.8):
    """All pairs of distinct sets with a similarity of `least` or more, by a look at every pair that shares a shingle."""
    by = collections.defaultdict(list)
    for i, x in sets.items():
        for g in x:
            by[g].append(i)
    both = collections.Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    return [(a, b) for (a, b), n in both.items() if n / (len(sets[a]) + len(sets[b]) - n) >= least]


def test_similar_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    sets = shingle_sets(rows)
    pairs = similar_pairs(sets)
    comp = {r.id: r.component_id for r in simhash.similar_dedup(d).collect()}
    assert sum(comp[a] == comp[b] for a, b in pairs) >= 0.95 * len(pairs)
    apart = [(a, b) for a, b in pairs if sets[a] != sets[b]]
    assert sum(comp[a] == comp[b] for a, b in apart) >= 0.9 * len(apart) > 0
    up = {i: i for i in sets}  # nothing is linked that similar pairs don't connect
    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    empty = min((i for i, x in sets.items() if not x), default=None)
    assert all(top(c if sets[i] else i) == top(i) or c == empty for i, c in comp.items())


def test_similar_texts_in_a_large_cluster(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        for i in rng.choice(200, 2, replace=False):
            w[i] = f"n{k}x{i}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"o{k}y{i}" for i in range(60))) for k in range(50)]
    got = simhash.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string"), params=simhash.SimilarParams(heavy_rows=100)).collect()
    assert [r.id for r in got if r.kept and r.id < 1000] == [0] and sum(r.kept for r in got) == 51


@pytest.mark.parametrize("heavy", [8192, 60])
def test_similar_texts_whose_nearest_are_not_similar(spark, heavy):
    """Most pairs lie just below the similarity, so that the nearest fingerprint is seldom a similar text."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(240):
        w = [f"b{i}" for i in range(200)]
        for i in rng.choice(200, 3, replace=False):
            w[i] = f"n{k}x{i}"
        rows.append((k, " ".join(w)))
    pairs = similar_pairs(shingle_sets(rows))
    p = simhash.SimilarParams(heavy_rows=heavy, recall=0.9999, slack=6.0)
    comp = {r.id: r.component_id for r in simhash.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string"), params=p).collect()}
    up = {i: i for i, _ in rows}
    for a, b in pairs * 2:  # the components of all similar pairs
        up = {i: min(up[a], up[b]) if x in (up[a], up[b]) else x for i, x in up.items()}
    assert comp == up and 5 < len(set(up.values())) < 235


@pytest.mark.parametrize("more", [{}, {"heavy_bytes": 100_000}])
def test_rows_of_a_group_of_similar_texts_below_the_limit(spark, monkeypatch, more):
    """Most of the 79,800 pairs have to be compared, but no table has a row for each: members times routes bound all of them."""
    from stratalens.llm.common import Workspace

    rng, n = np.random.default_rng(12), 400
    rows = []
    for k in range(n):
        w = [f"b{i}" for i in range(200)]
        for i in rng.choice(200, 3, replace=False):
            w[i] = f"n{k}x{i}"
        rows.append((k, " ".join(w)))
    save, made = Workspace.save, []

    def counted(self, df, label, *args):
        saved = save(self, df, label, *args)
        made.append((saved.count(), label))
        return saved

    monkeypatch.setattr(Workspace, "save", counted)
    p = simhash.SimilarParams(recall=0.9999, slack=6.0, **more)
    comp = {r.id: r.component_id for r in simhash.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string"), params=p).collect()}
    assert max(made)[0] <= 2 * len(simhash.sampled_routes(n, p)) * n < 79_800 // 4
    up = {i: i for i, _ in rows}
    for a, b in similar_pairs(shingle_sets(rows)) * 2:
        if up[a] != up[b]:
            lo, hi = sorted((up[a], up[b]))
            up = {i: lo if x == hi else x for i, x in up.items()}
    assert comp == up and 5 < len(set(up.values())) < n - 5


def test_overlaps():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 1 << 63, 60, np.uint64)
    sets = [np.unique(rng.choice(word, k)) for k in rng.integers(0, 120, 80)] + [np.zeros(0, np.uint64), word[:1], rng.integers(0, 1 << 63, 5, np.uint64)]
    long = rng.integers(0, 1 << 63, 150_000, np.uint64)  # a set of which no more than six are looked at at once
    sets += [np.unique(np.concatenate([long[: 150_000 - k * 6_000], rng.integers(0, 1 << 63, 10, np.uint64)])) for k in range(12)]
    overlaps = simhash.Overlaps(sets)
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i])
        want = [j for j in others if (both := len(np.intersect1d(sets[i], sets[j]))) / max(1, len(sets[i]) + len(sets[j]) - both) >= 0.8]
        assert overlaps.similar(i, others, 0.8).tolist() == want


@pytest.mark.parametrize("heavy", [8192, 40])
def test_simhash_links(spark, heavy):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 5, 6) for _ in range(4)]]))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    lab = np.arange(len(fps))
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(fps))])
        if (new == lab).all():
            break
        lab = new
    from stratalens.llm.common import Workspace
    from stratalens.llm.graph import components

    p = simhash.SimHashParams(heavy_rows=heavy)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.label for r in components(simhash.links(nodes, p), Workspace(spark, "t")).collect()}
    groups = collections.defaultdict(set)
    for x, k in zip(fps.view(np.int64).tolist(), lab.tolist()):
        groups[k].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    i, j = simhash.GrayIndex(fps).near(fps, 4)
    assert len(i) == near.sum()
    assert all(any(not (a ^ b) & m for m in simhash.routes(10**9, p)) for a, b in [(0, 0b1111), (0, 1 | 1 << 20 | 1 << 40 | 1 << 63)])


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    total, out, open_ = share * sum(n for _, n in order), {}, {s: weights[i % 3] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    while open_:
        left, w = total - sum(out.values()), sum(open_.values())
        above = [s for s in open_ if left * open_[s] / w > cap[s]]
        if not above:
            return out | {s: left * x / w for s, x in open_.items()}
        for s in above:
            out[s] = cap[s]
            del open_[s]
    return out


def check_mix(got, least=1.0):
    """Targets as brute force has them; words taken near them; whole copies within bounds. least: words off per source."""
    size = collections.Counter()
    for r in got:
        size[r.source] += r.size
    goal = brute_targets(list(size.items()))
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source] and r.taken == r.copies * r.size <= 2 * r.size
        assert r.copies - math.floor(goal[r.source] / size[r.source] + 1e-12 if r.size else 0) in (0, 1)
        taken[r.source] += r.taken
    for s in size:
        few = min((r.size for r in got if r.source == s and r.size), default=0)
        assert abs(taken[s] - goal[s]) <= max(least, few), (s, taken[s], goal[s])


def test_mixing(spark, some, none):
    got = mixing.mix_sources(some).collect()
    again = mixing.mix_sources(some).collect()
    key = lambda r: (str(r.id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(ROWS)
    assert {str(r.id): r.size for r in got} == {str(i): len(words(t)) for i, t, *_ in ROWS}
    assert brute_targets([("b", 10), (None, 30), ("a", 100)]) == pytest.approx({"a": 158.3333333, "b": 20, None: 31.6666667})
    assert mixing.mix_sources(none).count() == 0
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 400), np.full(400, 0.37)
    out = mixing.pivot(size, p, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 1 and (out * size).sum() == pytest.approx((p * size).sum())
    every = np.mean([mixing.pivot(size, p, np.random.default_rng(k).random(400)) for k in range(300)], axis=0)
    assert every.mean() == pytest.approx(0.37, abs=0.02) and every.std() < 0.05  # no row is preferred
    settled = mixing.settle(np.array([900, 40, 30, 7, 2]), np.array([0.6, 1.0, 0.0, 1.0, 0.0]))
    assert set(settled) <= {0.0, 1.0}


def test_mixing_of_a_table_in_several_levels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_mix(mixing.mix_sources(d, params=mixing.MixParams(bucket_rows=16, fan=4)).collect(), 60)
    check_mix(mixing.mix_sources(d).collect(), 60)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source")).union(spark.sql("select 1L, 'x', 't'"))
    check_mix(mixing.mix_sources(same, params=mixing.MixParams(bucket_rows=16, fan=4)).collect(), 3)


def brute_substring(rows, k=35):
    count = collections.Counter()
    for _, t, *_ in rows:
        w = words(t)
        count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for a in range(len(w) - k + 1) if count[tuple(w[a : a + k])] > 1 for j in range(a, a + k)}
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(want)


def judged(df):
    return sorted((str(r.id), r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_substring(some, none):
    assert judged(substring_dedup.substring_dedup(some)) == brute_substring(ROWS)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_hashes_that_collide(spark):
    """Windows of few hash bits collide; a word and its complement of the kind that polynomials modulo 2**64 can't tell."""
    bit = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    same = " ".join(f"s{i}" for i in range(34))
    rows = [(1, f"{same} {bit}"), (2, f"{same} {bit.translate(str.maketrans('ab', 'ba'))}"), *((10 + i, " ".join(f"w{i * 7 + j * j % 50}" for j in range(90))) for i in range(30)), (99, PASSAGE), (98, f"x {PASSAGE}")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert judged(substring_dedup.substring_dedup(d)) == brute_substring(rows)
    weak = substring_dedup.SubstringParams(first_bits=7)
    assert judged(substring_dedup.substring_dedup(d, params=weak)) == brute_substring(rows)


def test_substring_in_batches_and_reopened(spark, some, tmp_path):
    p = substring_dedup.SubstringParams(fanout=3, bucket_rows=50)
    for k in range(7):  # a new object each time, as a new process would have; the runs are merged twice
        index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), p)
        index.ingest(some.where(F.pmod(F.xxhash64("text"), F.lit(7)) == k))
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), p)
    assert len(index.runs) <= 3 and index.made > 7
    assert judged(substring_dedup.judge(some, index)) == brute_substring(ROWS)


def test_substring_of_a_table(spark):
    d = spark.read.parquet(f"{D}/documents.parquet")
    assert judged(substring_dedup.substring_dedup(d)) == brute_substring([(r.doc_id, r.text) for r in d.collect()])


def test_lm(some, none):
    got = maxent_lm.lm_scores(some).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import zlib

    toks = [(i, [*words((t or "").translate(low)), "\n"]) for i, t, *_ in ROWS]
    c = collections.Counter(w for i, ws in toks if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in toks)
    assert sorted((str(r.id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert maxent_lm.lm_scores(none).count() == 0


def test_lm_head_join_and_held_out(spark):
    small = maxent_lm.LmParams(head=50)
    d = spark.read.parquet(f"{D}/documents.parquet")
    a = {r.id: r for r in maxent_lm.lm_scores(d, params=small).collect()}
    b = {r.id: r for r in maxent_lm.lm_scores(d).collect()}
    assert all(abs(a[k].base_score - b[k].base_score) < 1e-6 * abs(b[k].base_score) and a[k].n_known == b[k].n_known for k in b)
    held = [r for r in b.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    shape = small.shape(1000)
    model = maxent_lm.MaxEnt(shape, np.ones(shape.classes * shape.width))
    every = np.arange(shape.classes * shape.width)
    assert np.power(10, model.score(every, np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64))).sum() == pytest.approx(1, abs=1e-3)


def test_lm_scores_do_not_depend_on_partitions(spark, tmp_path):
    d = spark.read.parquet(f"{D}/documents.parquet")
    got = []
    for n in (1, 24):
        d.repartition(n).write.parquet(str(tmp_path / f"p{n}"))
        got.append({r.id: r.score for r in maxent_lm.lm_scores(spark.read.parquet(str(tmp_path / f"p{n}"))).collect()})
    assert all(got[0][k] == pytest.approx(got[1][k], rel=1e-4) for k in got[0])


def test_lm_grows_with_the_vocabulary():
    p = maxent_lm.LmParams()
    shapes = [p.shape(10**k) for k in range(2, 12)]
    assert all(a.classes < b.classes or b.classes in (p.max_classes, a.classes) for a, b in zip(shapes, shapes[1:])) and shapes[-1].classes > 3 * shapes[2].classes


def test_lm_step_learns_all_kinds_of_features():
    p = maxent_lm.LmParams()
    shape = p.shape(80_000)
    mass = np.ones(shape.classes * shape.width)
    model = maxent_lm.MaxEnt(shape, mass)
    rng = np.random.default_rng(1)
    event = rng.integers(0, len(mass), 300)
    one, two = mix(event.astype(np.uint64)), mix(event.astype(np.uint64) + np.uint64(9))
    sums = model.tables()
    model.gather(event, one, two, sums)
    rows = model.rows(event, one, two)
    for w, r, x, hit in zip(model.w, rows, sums, (event // shape.width, event % shape.width)):
        want = np.zeros((2, *w.shape))
        for t in range(len(event)):
            for row in r[t]:
                want[0, row, hit[t]] += 1
                want[1, row] += 1 / w.shape[1]  # weights are zero and masses equal
        assert np.allclose(x, want, atol=1e-4)
    before = model.score(event, one, two).sum()
    model.step(sums, p)
    assert model.score(event, one, two).sum() > before
    for w, r in zip(model.w, rows):
        assert all(w[r[:, kind]].any(axis=1).all() for kind in range(3))
    rng = np.random.default_rng(2)
    g, rows = rng.normal(size=(500, 4)), np.minimum(rng.zipf(1.3, (500, 3)), 60)
    want = np.zeros((61, 4))
    np.add.at(want, rows.ravel(), np.repeat(g, 3, axis=0))
    own, total = maxent_lm.row_sums(g, rows, most=8)
    assert sorted(own) == sorted(set(rows.ravel())) and np.allclose(want[own], total)


def test_toxicity_and_language(spark, some, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(some, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(some, labels.limit(0)).collect()} == {0.0}
    got = langid.language_id(some).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 9} and all(0 <= r.score <= 1 for r in got)
    assert langid.language_id(none).count() == 0
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = spark.createDataFrame([(1,), (500,), (501,), (10**6,), (10**11,), (10**18,)], "n long")
    below = [r[0] / (1 << 62) * r[1] for r in n.select(langid.chance(F.col("n"), 500), "n").collect()]
    assert below[0] == 1 and below[1:] == pytest.approx([500] * 5, rel=1e-3)
    r = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(7, [float(x) for x in rng.normal(size=8)]), (400, None), (401, [None] * 8), (402, [float("nan")] * 8), (None, [0.0] * 8), (403, [1.0, 2.0]), (420, [])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = collections.defaultdict(list)
    for r in vafile.top_k(v, F.col("vec_id") % 20 == 0, params=vafile.VaParams(cells=8)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = [(i, np.floor(64 * np.float32(e).astype(float)).astype(int)) for i, e in rows if i is not None and e and len(e) == 8 and all(x is not None and x == x for x in e)]
    for i, e in ok:
        if i % 20 == 0:
            s = sorted([(-int(e @ x), j) for j, x in ok if j != i])[:20]
            assert sorted(got[i]) == [(k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert vafile.top_k(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def top_by_hand(rows, k):
    own = [(i, np.floor(64 * np.array(e, float))) for i, e in rows]
    whole = [(i, [int(max(-(2.0**63), min(x, 2.0**63 - 1024)) if abs(x) < 2.0**63 else (2**63 - 1 if x > 0 else -(2**63))) for x in e]) for i, e in own]
    out = []
    for i, e in whole:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, x)), j) for j, x in whole if j != i)[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -x))) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 1e12, 3e17])
def test_top_k_beyond_64_bits_and_ties(spark, size):
    """Scores that doubles don't hold, that longs don't hold, and many that are equal at the kth place; several stripes."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 4)) * size
    rows = [(i, [float(x) for x in base[i % 12]]) for i in range(150)] + [(200 + i, [float(x) for x in rng.normal(size=4) * size]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    p = vafile.VaParams(k=7, stripe_bytes=2000, cells=16)
    got = sorted(map(tuple, vafile.top_k(v, F.col("vec_id") % 20 == 0, params=p).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == top_by_hand(rows, 7)


def test_token_counts(some, none):
    got = token_counts.token_counts(some)
    per = got.groupBy("id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d"), F.count("*").alias("c"))
    assert all(r.n == r.d * (2 if r.id == 2 else 1) for r in per.collect())
    assert token_counts.token_counts(none).count() == 0
    cut, a, b = np.array([0, 4, 5, 10]), np.array([0, 3, 9]), np.array([3, 9, 10])
    assert token_counts.attribute(a, b, cut, "majority")[0].tolist() == [1, 0, 2]
    assert token_counts.attribute(a, b, cut, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(a, b, cut, "split")[0].sum() == pytest.approx(3)
    enc = token_counts.Encoder(open(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    text = "naïve 😀 text"
    ids, start, stop = enc.spans(text)
    assert enc.encoding.decode(ids.tolist()) == text and start[0] == 0 and stop[-1] == len(text)


def test_sentencepiece(some, none):
    got = sp.sample_segmentations(some, params=sp.SampleParams(k=3)).collect()
    assert all(r.round_trip for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.id].add(tuple(r.ids))
    assert len(by[1]) == 3 and len(by[3]) == 1 and len(by[6]) == 3
    again = sp.sample_segmentations(some, params=sp.SampleParams(k=3)).collect()
    assert sorted((str(r.id), r.sample, tuple(r.ids)) for r in got) == sorted((str(r.id), r.sample, tuple(r.ids)) for r in again)
    assert sp.sample_segmentations(none).count() == 0


def test_sentencepiece_is_the_same_with_what_is_kept():
    v, p = sp.Vocabulary(open(sp.MODEL, "rb").read(), 1.0), sp.SampleParams(k=3)
    texts = ["", "a", "ab ab  cd\n", "\U0001d11e\u2581x", "z" * 300, *(f"word{i % 7} other {i}" for i in range(60))]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = sp.segment(keys, pa.array(texts), sp.Lattices(v, 1_000_000), p)
    small = sp.Lattices(v, 50)  # cleared again and again
    apart = [x for i in range(0, len(texts), 4) for x in sp.segment(keys[i : i + 4], pa.array(texts[i : i + 4]), small, p)]
    assert [[(*s[:3], s[3].tolist()) for s in x] for x in whole] == [[(*s[:3], s[3].tolist()) for s in x] for x in apart]


def test_sentencepiece_decodes(spark):
    rows = [(1, "plain text, twice  spaced \n\n x"), (2, "a\u2581b"), (3, ""), (4, None), (5, " lead \U0001d11e \x00 \xa0"), (6, "ab" * 4000), (7, "\u2581")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sp.sample_segmentations(d, params=sp.SampleParams(k=4))
    for r in got.withColumn("back", sp.decoder(spark)("ids")).collect():
        text = dict(rows)[r.id] or ""
        assert r.back == text.replace("\u2581", " ") and r.round_trip == (r.back == text)
        assert r.log_inclusion <= 0 and math.isfinite(r.log_inclusion) and r.n_pieces == len(r.ids)


def test_sentencepiece_inclusion_scores():
    """Weighed by 1 / inclusion, samples add up to the whole distribution."""
    v = sp.Lattices(sp.Vocabulary(open(sp.MODEL, "rb").read(), 0.15), 1000)
    got = sp.segment(mix(np.arange(3000).astype(np.uint64)), pa.array(["abx cd"] * 3000), v, sp.SampleParams(k=3))
    assert np.mean([sum(math.exp(s[0] - s[2]) for s in r) for r in got]) == pytest.approx(1, abs=0.03)
    assert [sp.log_inclusion(x, 0.0) for x in (5, 0, -50)] == pytest.approx([0, math.log(1 - math.exp(-1)), -50], abs=1e-9)


def test_sentencepiece_thins_what_is_kept():
    lat = sp.Lattices(sp.Vocabulary(open(sp.MODEL, "rb").read(), 1.0), 60)
    often = ["the", " word", " again"]
    for k in range(20):
        lat.numbers([*often, f" rare{k}x{k}", f" seldom{k}"])
    assert set(often) <= set(lat.known) and lat.nodes < 200
    own = sp.Lattices(lat.v, 10_000)
    for x in lat.known:
        k = own.numbers([x])[0]
        a, b = lat.start[lat.known[x]], own.start[k]
        assert np.array_equal(lat.prob[lat.first[a] : lat.first[a + len(x)]], own.prob[own.first[b] : own.first[b + len(x)]])


def test_sentencepiece_frequencies():
    v = sp.Lattices(sp.Vocabulary(open(sp.MODEL, "rb").read(), 0.15), 1000)
    n = 4000
    got = sp.segment(mix(np.arange(n).astype(np.uint64)), pa.array(["abx cd"] * n), v, sp.SampleParams(k=2))
    p = {tuple(s[3].tolist()): math.exp(s[0]) for r in sp.segment(np.arange(1, dtype=np.uint64), pa.array(["abx cd"]), v, sp.SampleParams(k=99)) for s in r}
    assert sum(p.values()) == pytest.approx(1)
    second = collections.Counter(tuple(r[1][3].tolist()) for r in got)
    for x, px in p.items():
        want = sum(q * px / (1 - q) for y, q in p.items() if y != x)
        assert second[x] / n == pytest.approx(want, abs=0.03)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, D)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "exact dedup":
            t = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()]
            assert len(set(t)) == len(t) and docs.subtract(before).count() == 0
        if name == "SimHash near-dedup":
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(similar_pairs(shingle_sets(left))) <= 1
    assert 0 < docs.select("doc_id").distinct().count() < n
    out = corpus_pipeline.run(spark, D)
    assert "ids" in out.columns and out.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("stage", ["drop_copies", "encode"])
def test_pipeline_stages_give_back_the_heap_first(spark, some, stage):
    import corpus_pipeline

    jvm = spark.sparkContext._jvm
    left = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    gc.collect()
    getattr(corpus_pipeline, stage)(spark, some.select("doc_id", "text", "lang", "source"), D)
    assert left.get() is None


CLASHING = "f r d id t copies maybe bm_no bm_bits bm_slot __file __row digest spans label node rep fp k y l own p n h".split()


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Null, empty, one very long word, repeats, null ids, extra columns with names that are used inside; no rows at all."""
    import corpus_pipeline

    rows = [*ROWS, (3, None, None, None), (20, "x" * 30_000, "en", "a"), (None, None, None, None), (21, "a\u2581b", "de", "c")]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    d.repartition(3).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, 0), (99, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "d")).limit(0)):
        some = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, some, str(tmp_path))
            if k < 4:
                assert out.columns == d.columns, name
                out.write.parquet(at := str(tmp_path / f"s{k}-{table is some}-{some.count()}"))
                out = spark.read.parquet(at)
            if k < 3 and some.count():
                assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows} and out.count() > 5, name
            some = out
        assert some.columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, D), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(dict(zip(want.columns, x))[c] for c in cols) for x in want.fetchall())


def test_registered(spark):
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 11))

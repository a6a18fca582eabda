"""Operators that SQL can't express, against plain versions of what they compute; ties, refusals and odd cases."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalens.llm import langid, token_counts, toxicity
from stratalens.llm.common import mix

D = "/root/testdata/sf0.01"


def plain_grams(text, bits):
    """2-, 3- and 4-byte grams of the folded text, one by one."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text).encode() + b"    "
    out = collections.Counter()
    for i in range(len(folded) - 3):
        for n, salt in ((2, 2654435761), (3, 2246822519), (4, 3266489917)):
            out[int.from_bytes(folded[i : i + n], "big") * salt % (1 << 32) >> (32 - bits)] += 1
    return out


def test_language_vectors_and_decisions():
    p = langid.LangParams(bits=10, block=7)
    for text in ("", "A", "Hello, Wörld 12!", "ab" * 40):
        want = plain_grams(text, 10)
        idx, v = langid.vector(text.encode(), p)
        assert idx.tolist() == sorted(want) and v == pytest.approx([want[k] / sum(want.values()) * p.scale for k in sorted(want)])
    rng = np.random.default_rng(3)
    langs, fams, pairs = ["de", "en", "es", "fr", "zz"], ["germanic", "only:zz", "romance"], [("de", "en"), ("es", "fr")]
    model = {"langs": langs, "fams": fams, "pairs": pairs, "w": rng.normal(size=(1024, 5)).astype(np.float32), "bias": rng.normal(size=5), "p": p}
    texts = ["".join(rng.choice(list("abcdeé xyz"), 60)) for _ in range(80)]
    m = langid.margins(model, [t.encode() for t in texts])
    pred, score = langid.decide(model, m)
    for t, row, got, s in zip(texts, m, pred, score):
        g = plain_grams(t, 10)
        assert row == pytest.approx(sum(n * model["w"][k].astype(float) for k, n in g.items()) / sum(g.values()) * p.scale + model["bias"], rel=1e-3)
        family = fams[int(np.argmax(row[:3]))]
        want = {"germanic": "de" if row[3] >= 0 else "en", "romance": "es" if row[4] >= 0 else "fr"}.get(family, "zz")
        assert got == want and 0 <= s <= 1
    # of equal votes the larger margin counts, then the smaller code
    three = {"langs": ["de", "en", "nl"], "fams": ["germanic"], "pairs": [("de", "en"), ("de", "nl"), ("en", "nl")]}
    assert langid.decide(three, np.array([[1.0, 0.2, -0.5, 0.9], [1.0, 0.2, -0.2, 0.2], [1.0, 0.0, 0.0, 0.0]]))[0] == ["en", "de", "de"]


def test_svm_separates():
    p = langid.LangParams(bits=8)
    rng = np.random.default_rng(1)
    rows, y = [], np.where(np.arange(60) % 3 == 0, 1.0, -1.0)
    for s in y:
        idx = np.sort(rng.choice(128, 20, replace=False)) + (128 if s > 0 else 0)
        rows.append((idx, np.ones(20)))
    w = langid.svm(rows, y, 256, p, 0)
    assert all(np.sign(w[i] @ v + w[-1]) == s for (i, v), s in zip(rows, y))


def test_toxic_features_and_steps():
    text, bits = "Bad WORDS, badly worded", 20
    words = re.findall(r"[^\W_]+", text.lower())
    h = [xxhash.xxh64_intdigest(w, 5) for w in words]
    fold = lambda x: int(mix(np.array([x % (1 << 64)], np.uint64))[0]) >> (64 - bits)
    want = collections.Counter(fold(x) for x in h)
    for n in toxicity.STEMS:
        want.update(fold(xxhash.xxh64_intdigest(w[:n], 7 + n)) for w in words if len(w) > n)
    for step, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93)):
        want.update(fold(a * salt + b) for a, b in zip(h, h[step:]))
    rows, got = toxicity.features(pa.array(["", text, "!!"]), bits)
    assert set(rows.tolist()) == {1} and collections.Counter(got.tolist()) == want
    p = toxicity.ToxicityParams(bits=6, l1=0.5)
    m, z, n = toxicity.Ftrl(p), np.zeros(65), np.zeros(65)
    rng = np.random.default_rng(2)
    for _ in range(200):
        at, y = np.unique(rng.integers(0, 65, 5)), float(rng.random() < 0.3)
        m.learn(at, y, 2.0)
        w = [0.0 if abs(z[i]) <= p.l1 else -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2) for i in at]
        g = (1 / (1 + np.exp(-sum(w))) - y) * (2.0 if y else 1.0)
        for i, x in zip(at, w):
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha * x
            n[i] += g * g
    assert m.z == pytest.approx(z) and m.n == pytest.approx(n) and (m.weights(slice(None)) == 0).any()


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("toxic", "score", "predicted").collect()
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert bad and np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.9
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9


def plain_counts(text, cut, rule, enc):
    """Each token's characters, one token at a time."""
    n = [0.0] * (len(cut) - 1)
    ids, data, at = enc.encoding.encode_ordinary(text), text.encode(), 0
    for i in ids:
        end = at + len(enc.encoding.decode_single_token_bytes(i))
        a, b = len(data[:at].decode(errors="ignore")), len(data[: end].decode(errors="ignore"))
        a = len((data[:at] + b"").decode(errors="ignore"))
        chars = range(a, max(b, a + 1)) if data[:end].decode(errors="ignore").encode() == data[:end] else range(a, b + 1)
        share = collections.Counter(next(s for s in range(len(n)) if cut[s] <= c < cut[s + 1]) for c in chars)
        first, last = min(share), max(share)
        if rule == "split":
            for s, k in share.items():
                n[s] += k / len(chars)
        else:
            n[{"first": first, "last": last, "majority": max(share, key=lambda s: (share[s], -s))}[rule]] += 1
        at = end
    return n, len(ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_hand(spark, rule):
    texts = ["One. Two!  Three?\nFour", "", "ends with line\n", "naïve 😀😀. Ünï x", "no sections here", "...", "a.b. c"]
    enc = token_counts.Encoder(open(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = collections.defaultdict(list)
    for r in token_counts.token_counts(d, rule=rule).orderBy("id", "section").collect():
        got[r.id].append(r)
    for k, t in enumerate(texts):
        cut = token_counts.sentences(t).tolist()
        assert [(r.start, r.stop) for r in got[k]] == list(zip(cut, cut[1:])) and cut[-1] == len(t)
        want, n = plain_counts(t, cut, rule, enc) if t else ([0], 0)
        assert [r.n_tokens for r in got[k]] == pytest.approx(want) and {r.doc_tokens for r in got[k]} == {n}


def test_token_counts_of_given_sections(spark):
    d = spark.sql("SELECT 1 AS doc_id, 'abc def ghi' AS text, array(named_struct('start', 0, 'stop', 4), named_struct('start', 4, 'stop', 11)) AS s")
    got = token_counts.token_counts(d, sections_col="s", rule="last").orderBy("section").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 4), (4, 11)] and sum(r.n_tokens for r in got) == got[0].doc_tokens
    for bad in ("array(named_struct('start', 0, 'stop', 4), named_struct('start', 3, 'stop', 11))", "array(named_struct('start', 1, 'stop', 11))"):
        with pytest.raises(Exception, match="sections must follow"):
            token_counts.token_counts(d.withColumn("s", F.expr(bad)), sections_col="s").collect()
    assert token_counts.token_counts(d.withColumn("s", F.expr("cast(array() AS array<struct<start: int, stop: int>>)")), sections_col="s").count() == 1
    with pytest.raises(ValueError):
        token_counts.token_counts(d, rule="other")

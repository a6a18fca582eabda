"""Language ID: the family first, then one-versus-one linear support vector machines within it.

Null texts and texts without a letter are `und` with score 0. Ties in votes go to the larger summed margin, then to the
smaller code. Rows without a lang are not learned from; with no such row at all everything is `und`. Extra columns are
not read; repeated rows get equal answers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from stratalens.llm.common import as_text, documents, remainder, slices

# Families of common languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
    "indic": ["hi", "bn", "ur", "mr"],
    "sinitic": ["zh"],
    "semitic": ["ar", "he"],
}


@dataclass(frozen=True)
class LangParams:
    per_lang: int = 500  # expected rows learned from for each language: the bound on the sample
    block: int = 200_000  # bytes of one text whose grams are held at once
    max_langs: int = 1000  # more distinct values than this are an error: they can't be languages
    bits: int = 16
    scale: float = 30.0
    cost: float = 4.0
    epochs: int = 12


def family_of(lang: str) -> str:
    return next((f for f, of in FAMILIES.items() if lang.split("-")[0].lower() in of), f"only:{lang}")


#: ASCII letters in lower case; other ASCII becomes a space; bytes above stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PAD = b"    "


def grams(data: bytes, bits: int) -> np.ndarray:
    """For each byte the hashed 2-, 3- and 4-gram that starts there: shape (n - 3, 3)."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    four = three[:-1] << np.uint32(8) | b[3:]
    n, shift = len(b) - 3, np.uint32(32 - bits)
    out = np.empty((n, 3), np.uint32)
    for k, (g, salt) in enumerate(((two, 2654435761), (three, 2246822519), (four, 3266489917))):
        out[:, k] = (g[:n] * np.uint32(salt)) >> shift
    return out


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, p: LangParams, seed: int) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent; the last weight is the bias."""
    w, a = np.zeros(dims + 1), np.zeros(len(rows))
    weight = len(y) / 2 / np.maximum(1, np.where(y > 0, (y > 0).sum(), (y <= 0).sum()))  # rare sides weigh more
    diag = 1 / (2 * p.cost * weight)
    norm = np.array([v @ v + 1 for _, v in rows]) + diag
    rng = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + w[-1]) - 1 + diag[i] * a[i]
            new = max(0.0, a[i] - g / norm[i])
            if new != a[i]:
                w[idx] += (new - a[i]) * y[i] * v
                w[-1] += (new - a[i]) * y[i]
                a[i] = new
    return w


def vector(text: bytes, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """The hashed grams of a whole text and their shares: 2**bits at most, however long it is."""
    total = np.zeros(1 << p.bits)
    for at in range(0, max(1, len(text)), p.block):
        g = grams(text[at : at + p.block + 3].translate(_FOLD) + (_PAD if at + p.block >= len(text) else b""), p.bits)
        total += np.bincount(g.ravel(), minlength=1 << p.bits)
    idx = np.flatnonzero(total)
    return idx, total[idx] / total.sum() * p.scale


def learn(samples: list[tuple[str, np.ndarray, np.ndarray]], p: LangParams) -> dict:
    """The model: classifiers as columns of one matrix. First one per family, then one per pair within a family."""
    y = np.array([x for x, *_ in samples], dtype=object)
    rows = [(idx, v) for _, idx, v in samples]
    langs = sorted(set(y))
    fams = sorted({family_of(x) for x in langs})
    dims, cols = 1 << p.bits, []
    of = np.array([family_of(x) for x in y], dtype=object)
    for k, f in enumerate(fams):
        cols.append(svm(rows, np.where(of == f, 1.0, -1.0), dims, p, k) if len(fams) > 1 else np.zeros(dims + 1))
    pairs = [(a, b) for a, b in combinations(langs, 2) if family_of(a) == family_of(b)]
    for k, (a, b) in enumerate(pairs):
        take = np.flatnonzero((y == a) | (y == b))
        cols.append(svm([rows[i] for i in take], np.where(y[take] == a, 1.0, -1.0), dims, p, 1000 + k))
    w = np.array(cols).T if cols else np.zeros((dims + 1, 0))
    return {"langs": langs, "fams": fams, "pairs": pairs, "w": w[:-1].astype(np.float32), "bias": w[-1], "p": p}


def margins(model: dict, texts: list[bytes]) -> np.ndarray:
    """Each text's margin for each classifier, from whole texts."""
    p, w, out = model["p"], model["w"], []
    for data in texts:
        total, n = np.zeros(w.shape[1]), 0
        for at in range(0, max(1, len(data)), 100_000):  # a block with the three bytes that follow
            g = grams(data[at : at + 100_003].translate(_FOLD) + (_PAD if at + 100_000 >= len(data) else b""), p.bits)
            total += sum(w[g[:, k]].sum(0, dtype=np.float64) for k in range(3))
            n += g.size
        out.append(total / max(n, 1) * p.scale + model["bias"])
    return np.array(out).reshape(len(texts), w.shape[1])


def decide(model: dict, m: np.ndarray) -> tuple[list[str], np.ndarray]:
    fams, pairs, langs = model["fams"], model["pairs"], model["langs"]
    sure = lambda x: 1 / (1 + np.exp(-4 * np.clip(x, -8, 8)))
    f = m[:, : len(fams)].argmax(1) if len(fams) > 1 else np.zeros(len(m), int)
    score = sure(m[np.arange(len(m)), f]) if len(fams) > 1 else np.ones(len(m))
    pred = np.empty(len(m), dtype=object)
    for k, fam in enumerate(fams):
        own, at = [x for x in langs if family_of(x) == fam], np.flatnonzero(f == k)
        votes, lean = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
        weakest = np.full((len(at), len(own)), np.inf)
        for c, (a, b) in enumerate(pairs):
            if a in own:
                x, i, j = m[at, len(fams) + c], own.index(a), own.index(b)
                votes[:, i] += x >= 0
                votes[:, j] += x < 0
                lean[:, i] += x
                lean[:, j] -= x
                weakest[:, i], weakest[:, j] = np.minimum(weakest[:, i], x), np.minimum(weakest[:, j], -x)
        best = (votes + 1e-3 * np.tanh(lean)).argmax(1)
        pred[at] = np.array(own, dtype=object)[best]
        if len(own) > 1:
            score[at] *= sure(weakest[np.arange(len(at)), best])
    return pred.tolist(), score


_SPACE = 1 << 62


def chance(n: Column, per_lang: int) -> Column:
    """Below which of 2**62 hash values a row of a language with n rows is learned from; at least one for any n."""
    share = F.floor(F.lit(float(per_lang)) / n * float(_SPACE)).cast("long")
    return F.when(n <= per_lang, F.lit(_SPACE)).otherwise(F.greatest(share, F.lit(1).cast("long")))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int, p: LangParams) -> dict | None:
    """The sample: about per_lang rows of each language, as vectors of 2**bits values at most, made before they meet in one task."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(remainder("k", folds) != held_out).where("l IS NOT NULL AND t IS NOT NULL")
    counts = rows.groupBy("l").agg(F.count("*").alias("n"))
    if (many := counts.count()) > p.max_langs:
        raise ValueError(f"{many} languages; the model is built for max_langs = {p.max_langs} at most")
    if not many:
        return None
    share = counts.select(F.col("l").alias("of"), chance(F.col("n"), p.per_lang).alias("below"))
    hashed = F.pmod(F.xxhash64(F.col("k").cast("string"), "t", F.lit(1)), F.lit(_SPACE))
    picked = rows.join(F.broadcast(share), F.col("l") == F.col("of")).where(hashed < F.col("below"))  # max_langs rows at most

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [vector(t.as_buffer().to_pybytes(), p) for t in b.column("t")]
            lists = [pa.array([x[k].astype(t) for x in got], pa.list_(a)) for k, t, a in ((0, np.int32, pa.int32()), (1, np.float32, pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column("l"), b.column("h"), *lists], ["l", "h", "idx", "v"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [(lang, np.asarray(i.values), np.asarray(v.values).astype(float)) for b in batches for lang, i, v in zip(b.column("l").to_pylist(), b.column("idx"), b.column("v"))]
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(samples, p))], pa.binary())], ["model"])

    once = picked.groupBy("l", hashed.alias("h")).agg(F.any_value("t").alias("t"))  # a row that is repeated a million times is one row of the sample
    made = once.mapInArrow(digest, "l string, h long, idx array<int>, v array<float>")
    got = made.repartition(1).sortWithinPartitions("h", "l", "idx").mapInArrow(train, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def language_id(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", folds=4, held_out=2, params=LangParams()) -> DataFrame:
    """Predicts the language of every whole text; learns only outside the held-out fold."""
    model = fit(docs, id_col, text_col, lang_col, folds, held_out, params)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows times families and pairs

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for column in parts:
            texts = as_text(column)
            lettered = np.asarray(pc.match_substring_regex(texts, r"\pL").cast(pa.uint8())).astype(bool) & (m is not None)
            pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for i, j in slices(texts):
                at = i + np.flatnonzero(lettered[i:j])
                if len(at):
                    pred[at], score[at] = decide(m, margins(m, [texts[int(k)].as_buffer().to_pybytes() for k in at]))
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], ["lang_pred", "score"])

    out = docs.select(F.col(id_col), (remainder(id_col, folds) == held_out).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))

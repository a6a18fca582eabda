"""Token counts by offset-mapped attribution.

A whole text is encoded once. Each token has a span of characters; sections have spans too; the two are joined as
intervals. A token that lies in one section counts there. A token that crosses a boundary goes, by rule:
`majority` - to the section that holds most of its characters, the earlier one if equal (the default);
`first` / `last` - to the section of its first / last character;
`split` - to all that it touches, by their share of its characters.
So the sections' counts add up to the tokens of the text. Tokens that are part of one character have that character as
their span.

Sections are sentences and lines, with the white space that ends them, unless a column with spans (start, stop) is
given; spans that overlap or leave gaps are refused. A word's token often starts with the space before it, so many
tokens cross the boundary between two sentences. Null and empty texts have one empty section without tokens. Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import as_text, documents

TOKENIZERS = "/opt/tokenizers"
RULES = ("majority", "first", "last", "split")
#: Fixed value: how this vocabulary's texts are cut before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Byte-level BPE; each token's length in bytes is known, so offsets are sums."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        for k, v in table.items():
            self.length[v] = len(k)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first character, end character) of each token."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.length[ids])
        if len(text) == (ends[-1] if len(ends) else 0):  # one byte per character
            return ids, ends - self.length[ids], ends
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return ids, char[ends - self.length[ids]], char[ends - 1] + 1


#: A section ends with its line feed, or with the white space that follows a full stop, question or exclamation mark.
SECTION_END = re.compile(r"[.!?]+[ \t]+|\n")


def sentences(text: str) -> np.ndarray:
    """Where sentences and lines start, and the end of the text."""
    cut = [0, *(m.end() for m in SECTION_END.finditer(text))]
    if cut[-1] != len(text) or len(cut) == 1:
        cut.append(len(text))
    return np.array(cut)


def attribute(start: np.ndarray, stop: np.ndarray, cut: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, crossing tokens that touch it) by interval join of sorted spans."""
    n = len(cut) - 1
    a, b = (np.searchsorted(cut[1:], x, "right").clip(0, n - 1) for x in (start, stop - 1))
    count, crossing = np.bincount(a[a == b], minlength=n).astype(float), np.zeros(n, np.int64)
    i = np.flatnonzero(a != b)
    if not len(i):
        return count, crossing
    # a row for each crossing token and section that it touches
    width = b[i] - a[i] + 1
    token = np.repeat(np.arange(len(i)), width)
    section = np.arange(len(token)) - np.repeat(np.cumsum(width) - width, width) + a[i][token]
    part = np.minimum(stop[i][token], cut[section + 1]) - np.maximum(start[i][token], cut[section])
    np.add.at(crossing, section, 1)
    if rule == "split":
        np.add.at(count, section, part / np.bincount(token, part)[token])
    elif rule == "majority":
        order = np.lexsort((section, -part, token))
        np.add.at(count, section[order[np.cumsum(width) - width]], 1)
    else:
        np.add.at(count, (a if rule == "first" else b)[i], 1)
    return count, crossing


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "majority", ranks_file: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per section: id, section, start, stop, n_tokens, n_crossing, doc_tokens. sections_col: array<struct<start, stop>>."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(open(ranks_file, "rb").read())  # the vocabulary's file: fixed size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *([F.col(sections_col).alias("s")] if sections_col else []))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            texts, own = as_text(batch.column("t")), batch.column("s").to_pylist() if sections_col else None
            for at in range(0, len(texts), 512):
                row, out = [], [[] for _ in range(6)]
                for k in range(at, min(at + 512, len(texts))):
                    text = texts[k].as_py()
                    cut = sentences(text)
                    if own and own[k]:
                        spans = [(s["start"], s["stop"]) for s in own[k]]
                        cut = np.array([spans[0][0], *(e for _, e in spans)])
                        if cut[0] or cut[-1] != len(text) or any(x[1] != y[0] for x, y in zip(spans, spans[1:])):
                            raise ValueError("sections must follow one another from the start of the text to its end")
                    ids, start, stop = encoder.spans(text)
                    n, crossing = attribute(start, stop, cut, rule)
                    row.append(np.full(len(n), k))
                    for x, y in zip(out, (np.arange(len(n)), cut[:-1], cut[1:], n, crossing, np.full(len(n), len(ids)))):
                        x.append(y)
                cols = [np.concatenate(x) for x in out]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64() if rule == "split" else pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.concatenate(row))), *(pa.array(c).cast(t) for c, t in zip(cols, kinds))], names)

    names = ["id", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"]
    kind = rows.dtypes[0][1]
    return rows.mapInArrow(count, f"id {kind}, section int, start long, stop long, n_tokens {'double' if rule == 'split' else 'long'}, n_crossing long, doc_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")

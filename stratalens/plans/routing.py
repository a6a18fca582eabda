"""What share of code questions went to structural tools: command classes and ratios over transcripts."""

from __future__ import annotations

import os
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import constants as K

_IDENTIFIER, _SOURCE, _NOISE = re.compile(K.IDENTIFIER), re.compile(K.SOURCE_EXTENSION), re.compile(K.NOISE)


def _arguments(cmd: str) -> list[str]:
    """The words of the first simple command, assignments before it left out; none if it can't be read or only counts."""
    if re.search(r"\|\s*wc\b", cmd):
        return []
    try:
        words = shlex.split(cmd)
    except ValueError:
        return []
    stop = next((i for i, w in enumerate(words) if w in K.SHELL_OPERATORS), len(words))
    start = next((i for i, w in enumerate(words[:stop]) if "=" not in w or w[0] == "-"), stop)
    return words[start:stop]


def classify(cmd: str | None) -> tuple[str, str]:
    """("ident", name), ("file", path) or ("none", "")."""
    none, words = ("none", ""), _arguments(cmd or "")
    if not words:
        return none
    verb, rest = os.path.basename(words[0]), words[1:]
    if verb == "git":
        named = [w for w in rest if w[:1] != "-"]
        if named[:1] != ["grep"]:
            return none
        verb, rest = "grep", [w for w in rest if w[:1] == "-"] + named[1:]
    searching = verb in K.SEARCH_COMMANDS
    if not searching and verb not in K.READ_COMMANDS:
        return none
    plain, words = [], iter(rest)
    for w in words:
        if w in K.VALUE_FLAGS:
            next(words, None)
        elif w[:1] != "-":
            plain.append(w)
        elif searching and w[:2] != "--" and w != "-e" and "c" in w[1:]:
            return none
    if not searching:
        return next((("file", w) for w in plain if _SOURCE.search(w) and not _NOISE.search(w)), none)
    if not plain or not _IDENTIFIER.match(plain[0]) or (plain[1:] and all(_NOISE.search(w) for w in plain[1:])):
        return none
    return "ident", plain[0]


def classified(cmd: Column) -> Column:
    """classify as a column function: struct of kind and subject."""

    @F.pandas_udf("struct<kind: string, subject: string>")
    def run(cmds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(c) for c in cmds], columns=["kind", "subject"])

    return run(cmd)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session, ts, tool, input of each tool call in JSON-lines files; lines that can't be read are left out."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), F.from_json("value", "timestamp string, message struct<content: array<struct<type: string, name: string, input: map<string, string>>>>").alias("r"))
    calls = raw.select("session", F.to_timestamp("r.timestamp").alias("ts"), F.explode("r.message.content").alias("c"))
    return calls.where("c.type = 'tool_use'").select("session", "ts", F.col("c.name").alias("tool"), F.col("c.input").alias("input"))


def by_session(calls: DataFrame) -> DataFrame:
    """session, structural, scanned, hinted, routed_pct. calls: session, kind (structural, scanned, hint, other)."""
    g = calls.groupBy("session").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("structural", "structural"), ("scanned", "scanned"), ("hint", "hints"))])
    total = F.col("structural") + F.col("scanned")
    return g.select("session", "structural", "scanned", (F.col("hints") > 0).alias("hinted"), F.when(total == 0, 0.0).otherwise(F.round(F.col("structural") * 100 / total, 4)).alias("routed_pct"))


def by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("kind") == "structural").alias("structural"), F.count_if(F.col("kind") == "scanned").alias("scanned"))


def by_hint(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("hinted").agg(F.count("*").alias("sessions"), F.sum("structural").alias("structural"), F.sum("scanned").alias("scanned"))

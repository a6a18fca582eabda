"""What a dashboard shows: churn out of a version log, findings and plans rolled up, tables and a page as sinks."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.plans.analyses import smallest


def version_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, body, files of each commit, from files with the output of `git log --name-only --format=%x01%H%x02%B%x03`."""
    parts = F.split("value", "[\x02\x03]")
    rows = spark.read.option("lineSep", "\x01").text(path).where(F.btrim("value", F.lit(" \n\r")) != "")
    names = F.filter(F.transform(F.split(F.try_element_at(parts, F.lit(3)), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    return rows.select(F.btrim(parts[0], F.lit(" \n\r")).alias("hash"), F.btrim(F.try_element_at(parts, F.lit(2)), F.lit(" \n\r")).alias("body"), F.coalesce(names, F.array().cast("array<string>")).alias("files"))


def churn(commits: DataFrame) -> DataFrame:
    """path, churn: how many commits touch it."""
    return commits.select(F.explode("files").alias("path")).groupBy("path").agg(F.count("*").alias("churn"))


def marked(commits: DataFrame, marker: str) -> DataFrame:
    """One row: commits whose body matches the marker (a regular expression), all commits, the share in per cent, files touched by marked ones."""
    hit = F.coalesce(F.col("body").rlike(marker), F.lit(False))
    n = commits.agg(F.count_if(hit).alias("marked"), F.count("*").alias("total"))
    touched = commits.where(hit).select(F.explode("files").alias("f")).agg(F.count_distinct("f").alias("files"))
    return n.crossJoin(touched).select("marked", "total", F.round(100 * F.col("marked") / F.greatest("total", F.lit(1)), 1).alias("pct"), "files")  # single rows


def findings_by_rule(findings: DataFrame, most: int = 4) -> DataFrame:
    """rule, n, severity (the highest), places: the first few."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    g = findings.groupBy("rule").agg(F.count("*").alias("n"), F.min_by("severity", rank).alias("severity"))
    first = smallest(findings.select("rule", F.struct("file", "line").alias("at")), ["rule"], "at", most)
    places = F.array_join(F.transform("first", lambda x: F.concat_ws(":", x["file"], x["line"].cast("string"))), ",")
    return g.join(first, "rule").select("rule", "n", "severity", places.alias("places"))


def priorities(plan: DataFrame) -> DataFrame:
    """One row: how many entries of a plan have each priority."""
    names = ["critical", "high", "medium", "low"]
    return plan.agg(*[F.count_if(F.col("priority") == k + 1).alias(n) for k, n in enumerate(names)], F.count("*").alias("total"))


def by_language(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """language, files, symbols."""
    s = symbols.groupBy("language").agg(F.count("*").alias("symbols"))
    return files.groupBy("language").agg(F.count("*").alias("files")).join(s, "language", "left").select("language", "files", F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"))


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as a folder of Parquet; what was there goes."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; nulls are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><div id="out"></div>
<script type="application/json" id="data">{data}</script>
<script>
for (const [name, rows] of Object.entries(JSON.parse(document.getElementById("data").textContent))) {{
  const head = document.createElement("h2"), table = document.createElement("table");
  head.textContent = name;
  rows.forEach((row, i) => {{
    if (!i) table.insertRow().append(...Object.keys(row).map(k => Object.assign(document.createElement("th"), {{textContent: k}})));
    const tr = table.insertRow();
    Object.values(row).forEach(v => tr.insertCell().textContent = v);
  }});
  document.getElementById("out").append(head, table);
}}
</script>
"""


def page(title: str, tables: dict[str, DataFrame], most: int = 300) -> str:
    """A page with the first rows of each table, as they are ordered: `most` rows is what a reader can look through."""
    data = {name: [json.loads(r["json"]) for r in as_json(df.limit(most)).collect()] for name, df in tables.items()}
    return _PAGE.format(title=html.escape(title), data=json.dumps(data).replace("<", "\\u003c"))

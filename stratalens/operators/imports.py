"""Import specifiers of 26 languages, and what files they mean.

Specifiers become candidate path ends in order of preference; files are joined by all ends of their paths that follow a
slash. So resolution is an equi-join. Ends bind at a slash, never inside a name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens import constants as K
from stratalens.functions import paths

Q = r"""["']([^"']+)["']"""
#: language: patterns whose only group is the specifier; all matches in a line count.
SPECS = {
    "rust": [r"^\s*(?:pub(?:\([a-z]+\))?\s+)?use\s+([\w:]+?)(?:::)?(?:\{.*|\s+as\s.*)?;?\s*$", r"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+(\w+)\s*;"],
    "go": [r'^\s*import\s+(?:\w+\s+)?"([^"]+)"', r'^\s+(?:[\w.]+\s+)?"([^"]+)"\s*$'],
    "typescript": [rf"\bfrom\s+{Q}", rf"^\s*import\s+{Q}", rf"\brequire\(\s*{Q}"], "javascript": [rf"\bfrom\s+{Q}", rf"^\s*import\s+{Q}", rf"\brequire\(\s*{Q}"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;"], "kotlin": [r"^\s*import\s+([\w.]+)"], "scala": [r"^\s*import\s+([\w.]+?)\.?(?:\{.*)?\s*$"], "lua": [rf"\brequire\s*\(?\s*{Q}"],
    "c": [r"^\s*#\s*include\s+[\"<]([^\">]+)"], "cpp": [r"^\s*#\s*include\s+[\"<]([^\">]+)"], "zig": [r'@import\("([^"]+)"\)'], "ruby": [rf"^\s*require(?:_relative)?\s*\(?\s*{Q}"],
    "dart": [rf"^\s*(?:import|export|part)\s+{Q}"], "nix": [r"\bimport\s+([./][^\s;)]*)"], "css": [rf"@import\s+(?:url\()?{Q}"], "scss": [rf"@(?:use|import|forward)\s+{Q}"], "bash": [r"^\s*(?:source|\.)\s+(\S+)"],
    "make": [r"^\s*(?:-include|sinclude|include)\s+([^#\n]+)"], "html": [r"""(?:src|href)\s*=\s*["'](?!http|//)([^"']+)["']"""], "hcl": [r'^\s*source\s*=\s*"(\.[^"]*)"'], "r": [rf"\bsource\(\s*{Q}"],
    "protobuf": [r'^\s*import\s+(?:public\s+|weak\s+)?"([^"]+)"'], "solidity": [r'^\s*import\b[^"]*"([^"]+)"'], "yaml": [r"^\s*-?\s*(?:include_tasks|import_tasks|import_playbook|include_playbook|include)\s*:\s*(\S+\.ya?ml)"],
    "jinja2": [rf"\{{%-?\s*(?:extends|include|import|from)\s+{Q}"],
}
#: Where each language's extra ends come from: a relative specifier with these endings, the first that exists.
RELATIVE = {
    "typescript": ["", ".ts", ".tsx", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"], "css": ["", ".css"], "bash": ["", ".sh", ".bash"], "make": ["", ".mk"], "html": [""], "r": ["", ".R", ".r"],
    "yaml": ["", ".yml", ".yaml"], "jinja2": ["", ".html", ".j2", ".jinja", ".jinja2"], "zig": [""], "dart": [""], "nix": ["", ".nix", "/default.nix"], "ruby": [".rb"], "protobuf": [""], "solidity": [""],
}
RELATIVE["javascript"] = RELATIVE["typescript"]
DOTTED = {"java": ".java", "kotlin": ".kt", "scala": ".scala", "lua": ".lua"}
ALL_MATCHES = ["python", "go", "c", "cpp"]


@cache
def _compiled(language: str) -> list[re.Pattern]:
    return [re.compile(p, re.M) for p in SPECS.get(language, [])]


def found_in(language: str, content: str) -> list[str]:
    """Specifiers in order, each once."""
    if language == "python":
        hits = [(m.start(), 0, m[1]) for m in re.finditer(r"^\s*from\s+(\.*[\w.]*)\s+import\b", content, re.M)]
        for m in re.finditer(r"^\s*import\s+(.+)$", content, re.M):
            hits += [(m.start(), k, x.split()[0]) for k, x in enumerate(m[1].split(",")) if x.split()]
    else:
        hits = [(m.start(1), 0, m[1]) for p in _compiled(language) for m in p.finditer(content)]
        if language == "make":  # one directive may name several files
            hits = [(at, k, x) for at, _, names in hits for k, x in enumerate(names.split())]
    tidy = [x.strip(" \t\r;,") for *_, x in sorted(hits)]
    return list(dict.fromkeys(x for x in tidy if x and len(x.encode()) <= 256))


def in_brackets(spec: str, content: str) -> bool:
    """Whether all includes of it are in angle brackets."""
    return not re.search(rf'^\s*#\s*include\s+"{re.escape(spec)}', content, re.M)


def specs(files: DataFrame) -> DataFrame:
    """file_id, path, language, ord, spec, system (an include in angle brackets): distinct per file, in order. Files are
    read where they are: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, p, lang, k, x, lang in ("c", "cpp") and in_brackets(x, c)) for f, p, lang, c in zip(b["file_id"], b["path"], b["language"], b["content"]) for k, x in enumerate(found_in(lang, c))]
            yield pd.DataFrame(rows, columns=["file_id", "path", "language", "ord", "spec", "system"])

    known = files.where(F.col("language").isin("python", *SPECS)).select("file_id", "path", "language", "content")
    return known.mapInPandas(run, "file_id long, path string, language string, ord int, spec string, system boolean")


def _join(d: Column, spec: Column) -> Column:
    return paths.normalised(F.concat_ws("/", d, spec))


def candidates() -> Column:
    """Path ends that a specifier may mean, best first. Columns: language, path (the importer's), spec, system."""
    s, lang, d = F.col("spec"), F.col("language"), paths.dirname(F.col("path"))
    none = F.array().cast("array<string>")

    def with_each(base: Column, ends: list[str]) -> Column:
        return F.array(*[F.concat(base, F.lit(e)) for e in ends])

    def shorter(base: Column, ends: list[str]) -> Column:
        """base with its last parts dropped one after the other, each with the endings."""
        parts = F.split(base, "/")
        return F.flatten(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: with_each(F.array_join(F.slice(parts, 1, n), "/"), ends)))

    rust = F.replace(F.regexp_replace(s, r"^(crate|super|self)::", ""), F.lit("::"), F.lit("/"))
    rust_all = F.when(s.rlike(r"^(std|core|alloc)\b"), none).when(~s.contains("::"), F.array(_join(d, F.concat(s, F.lit(".rs"))), _join(d, F.concat(s, F.lit("/mod.rs"))))).otherwise(
        F.concat(shorter(F.concat(F.lit("src/"), rust), [".rs", "/mod.rs"]), F.when(rust.rlike("^[A-Z][^/]*$"), F.array(F.lit("src/lib.rs"))).otherwise(none)))
    python = F.replace(F.regexp_replace(s, r"^\.+", ""), F.lit("."), F.lit("/"))
    python_all = F.when(F.regexp_extract(s, r"^([^.]*)", 1).isin(K.PYTHON_STDLIB) | (python == ""), none).otherwise(with_each(python, [".py", "/__init__.py"]))
    ts = F.regexp_replace(F.regexp_replace(s, r"^[@~]/", ""), r"\.(js|jsx|mjs|cjs)$", "")
    ts_base = F.when(s.startswith("."), _join(d, ts)).otherwise(ts)
    ts_all = F.when(s.rlike(r"^(\.|@/|~/)"), F.concat(with_each(ts_base, RELATIVE["typescript"]), F.array(F.when(s.startswith("."), _join(d, s)).otherwise(F.regexp_replace(s, r"^[@~]/", ""))))).otherwise(none)
    c_all = F.when(F.col("system"), none).otherwise(F.array(_join(d, s), s))
    out = F.when(lang == "rust", rust_all).when(lang == "python", python_all).when(lang.isin("typescript", "javascript"), ts_all).when(lang.isin("c", "cpp"), c_all)
    for k, ext in DOTTED.items():
        dotted = F.replace(s, F.lit("."), F.lit("/"))
        out = out.when((lang == k) & ~s.endswith("*"), shorter(dotted, [ext]) if k != "lua" else with_each(dotted, [ext]))
    package = F.regexp_replace(s, r"^package:[^/]*/", "")
    base = s.substr(F.lit(1), F.length(s) - F.length(F.element_at(F.split(s, "/"), -1)))
    scss = _join(d, s)
    out = out.when(lang == "scss", F.array(F.concat(scss, F.lit(".scss")), _join(d, F.concat(base, F.lit("_"), paths.basename(s), F.lit(".scss"))), F.concat(scss, F.lit("/_index.scss"))))
    out = out.when((lang == "zig") & ~s.endswith(".zig"), none).when((lang == "dart") & (s.startswith("dart:") | ~s.endswith(".dart")), none).when((lang == "dart") & s.startswith("package:"), F.array(package))
    out = out.when((lang == "protobuf") & s.endswith(".proto"), F.array(_join(d, s), s)).when((lang == "solidity") & s.endswith(".sol"), F.array(F.when(s.startswith("."), _join(d, s)).otherwise(paths.basename(s))))
    out = out.when(lang == "ruby", F.array(_join(d, F.concat(s, F.lit(".rb"))), F.concat(F.regexp_replace(s, r"^(\.\.?/)+", ""), F.lit(".rb"))))
    for k, ends in RELATIVE.items():
        out = out.when(lang == k, with_each(_join(d, s), ends))
    return out.otherwise(none)


def edges(files: DataFrame, found: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """(src, dst), distinct, without loops."""
    found = specs(files) if found is None else found
    ends = files.select(F.col("file_id").alias("dst"), F.col("path").alias("target"), F.explode(paths.suffixes(F.col("path"))).alias("end"))
    found = found if "system" in found.columns else found.withColumn("system", F.lit(False))
    asked = found.select("file_id", "language", "path", "ord", "spec", F.posexplode(candidates()).alias("rank", "end"))
    hits = asked.join(ends, "end")
    first = F.row_number().over(W.partitionBy("file_id", "ord").orderBy("rank", "target"))
    hits = hits.withColumn("n", first).where((F.col("n") == 1) | F.col("language").isin(ALL_MATCHES)).select("file_id", "ord", "dst")
    # a Go package is the directory that the specifier's last part names; a Terraform module the first file in it
    folder = files.select(F.col("file_id").alias("dst"), F.col("path").alias("target"), F.col("language").alias("tl"), paths.basename(paths.dirname(F.col("path"))).alias("dir"), paths.dirname(F.col("path")).alias("whole"))
    go = found.where((F.col("language") == "go") & F.col("spec").contains(".")).withColumn("pkg", paths.basename(F.col("spec")))
    go = go.join(folder.where((F.col("tl") == "go") & ~F.col("target").endswith("_test.go")), F.col("pkg") == F.col("dir")).select("file_id", "ord", "dst")
    hcl = found.where("language = 'hcl'").withColumn("pkg", _join(paths.dirname(F.col("path")), F.col("spec")))
    hcl = hcl.join(folder.where(F.col("target").endswith(".tf")), F.col("pkg") == F.col("whole")).groupBy("file_id", "ord").agg(F.min_by("dst", "target").alias("dst"))
    hits = hits.unionByName(go).unionByName(hcl)
    if fallback:
        rest = found.where((F.octet_length("spec") >= 6) & ~F.col("system")).join(hits.select("file_id", "ord"), ["file_id", "ord"], "left_anti").withColumn("end", F.regexp_replace("spec", r'^["<./]+', ""))
        hits = hits.unionByName(rest.join(ends, "end").select("file_id", "ord", "dst"))
    return hits.where("file_id <> dst").select(F.col("file_id").alias("src"), "dst").distinct()

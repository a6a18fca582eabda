"""Symbols by declaration patterns, with ranges by braces or indentation.

Heuristic where a grammar would be exact: braces inside strings and comments count. Python may be read exactly with the
standard library's parser (`python_symbols`).
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens import constants as K

# language: (pattern with the name as its only group, kind)
_ID = r"([A-Za-z_$][\w$]*)"
_C = [(rf"^\s*(?:typedef\s+)?struct\s+{_ID}\s*\{{?", "struct"), (rf"^\s*enum\s+{_ID}", "enum"), (rf"^\s*union\s+{_ID}", "union"), (rf"^#define\s+{_ID}", "macro"), (rf"^[A-Za-z_][\w\s*]*?\b{_ID}\s*\([^;]*\)\s*\{{", "function")]
_TS = [
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}", "function"), (rf"^\s*(?:export\s+)?(?:abstract\s+)?class\s+{_ID}", "class"), (rf"^\s*(?:export\s+)?interface\s+{_ID}", "class"),
    (rf"^\s*(?:export\s+)?type\s+{_ID}\s*=", "type_alias"), (rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_ID}", "enum"), (rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_ID}\s*=\s*(?:async\s*)?(?:\(|function)", "function"),
    (rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}\s*[:=]", "constant"), (rf"^\s+(?:public\s+|private\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b){_ID}\s*\([^)]*\)\s*(?::\s*[^{{]+)?\{{\s*$", "method"),
]
_JVM = [(rf"^\s*(?:[a-z]+\s+)*class\s+{_ID}", "class"), (rf"^\s*(?:[a-z]+\s+)*interface\s+{_ID}", "class"), (rf"^\s*(?:[a-z]+\s+)*enum\s+{_ID}", "enum")]
PATTERNS = {
    "rust": [(rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_ID}", "function"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+{_ID}", "struct"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+{_ID}", "enum"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?union\s+{_ID}", "union"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+{_ID}", "trait"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+{_ID}", "module"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?type\s+{_ID}", "type_alias"), (rf"^\s*macro_rules!\s+{_ID}", "macro"), (rf"^\s*impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?{_ID}", "class"), (rf"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const|static)\s+(?:mut\s+)?{_ID}\s*:", "constant")],
    "python": [(rf"^(?:async\s+)?def\s+{_ID}", "function"), (rf"^\s+(?:async\s+)?def\s+{_ID}", "method"), (rf"^\s*class\s+{_ID}", "class"), (r"^([A-Z][A-Z0-9_]*)\s*=", "constant")],
    "go": [(rf"^func\s+{_ID}\s*\(", "function"), (rf"^func\s+\([^)]*\)\s*{_ID}", "method"), (rf"^type\s+{_ID}\s+struct", "struct"), (rf"^type\s+{_ID}\s+interface", "class"), (rf"^type\s+{_ID}\s", "type_alias"), (rf"^const\s+{_ID}", "constant"), (rf"^var\s+{_ID}", "variable")],
    "typescript": _TS, "javascript": _TS,
    "java": [*_JVM, (rf"^\s+(?:public|private|protected|static|final|synchronized|\s)+[\w<>\[\], ]+\s+{_ID}\s*\(", "method")],
    "c_sharp": [*_JVM, (rf"^\s*(?:[a-z]+\s+)*struct\s+{_ID}", "struct"), (r"^\s*namespace\s+([\w.]+)", "module"), (rf"^\s+(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\], ]+\s+{_ID}\s*\(", "method")],
    "kotlin": [*_JVM, (rf"^\s*(?:[a-z]+\s+)*object\s+{_ID}", "class"), (rf"^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?{_ID}", "function")],
    "scala": [*_JVM, (rf"^\s*(?:case\s+)?object\s+{_ID}", "module"), (rf"^\s*trait\s+{_ID}", "trait"), (rf"^\s*(?:[a-z]+\s+)*def\s+{_ID}", "function")],
    "swift": [*_JVM, (rf"^\s*(?:[a-z]+\s+)*struct\s+{_ID}", "struct"), (rf"^\s*protocol\s+{_ID}", "class"), (rf"^\s*(?:[a-z]+\s+)*func\s+{_ID}", "function")],
    "dart": [*_JVM, (rf"^(?:[\w<>?]+\s+)?{_ID}\s*\([^;]*\)\s*(?:async\s*)?\{{", "function")],
    "c": _C, "cpp": [(rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{_ID}", "class"), (rf"^\s*namespace\s+{_ID}", "module"), *_C],
    "zig": [(rf"^\s*(?:pub\s+)?(?:inline\s+|export\s+)?fn\s+{_ID}", "function"), (rf"^\s*(?:pub\s+)?const\s+{_ID}\s*=\s*(?:packed\s+|extern\s+)?struct", "struct"), (rf"^\s*(?:pub\s+)?const\s+{_ID}\s*=\s*enum", "enum"), (rf"^\s*(?:pub\s+)?const\s+{_ID}\s*=\s*union", "union"), (rf"^\s*(?:pub\s+)?const\s+{_ID}", "constant"), (r'^\s*test\s+"([^"]+)"', "test")],
    "ruby": [(r"^\s*def\s+(?:self\.)?([\w?!]+)", "method"), (rf"^\s*class\s+{_ID}", "class"), (rf"^\s*module\s+{_ID}", "module")],
    "lua": [(r"^\s*(?:local\s+)?function\s+([\w.:]+)", "function")],
    "bash": [(r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?", "function")],
    "r": [(r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b", "function")],
    "elixir": [(r"^\s*defmodule\s+([\w.]+)", "module"), (r"^\s*defp?\s+([\w?!]+)", "function")],
    "solidity": [(rf"^\s*(?:abstract\s+)?contract\s+{_ID}", "class"), (rf"^\s*interface\s+{_ID}", "class"), (rf"^\s*library\s+{_ID}", "module"), (rf"^\s*struct\s+{_ID}", "struct"), (rf"^\s*enum\s+{_ID}", "enum"), (rf"^\s*function\s+{_ID}", "function"), (rf"^\s*modifier\s+{_ID}", "function"), (rf"^\s*event\s+{_ID}", "function"), (rf"^\s*error\s+{_ID}", "function")],
    "protobuf": [(rf"^\s*message\s+{_ID}", "struct"), (rf"^\s*enum\s+{_ID}", "enum"), (rf"^\s*service\s+{_ID}", "class"), (rf"^\s*rpc\s+{_ID}", "method")],
    "sql": [(rf"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", "struct"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+[\"`]?([\w.]+)", "struct"), (r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", "constant"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`]?([\w.]+)", "function"), (r"(?i)^\s*create\s+type\s+[\"`]?([\w.]+)", "type_alias"), (r"(?i)^\s*create\s+schema\s+[\"`]?([\w.]+)", "module"), (r"(?i)^\s*create\s+trigger\s+[\"`]?([\w.]+)", "function")],
    "markdown": [(r"^#{1,6}\s+(.+?)\s*#*\s*$", "module")], "make": [(r"^([\w./-]+)\s*:(?!=)", "function")], "dockerfile": [(r"(?i)^FROM\s+\S+\s+AS\s+(\S+)", "module")],
    "toml": [(r"^\s*\[\[?([^\]]+)\]\]?", "module"), (r"^([\w.-]+)\s*=", "constant")], "ini": [(r"^\s*\[([^\]]+)\]", "module"), (r"^\s*([\w.-]+)\s*=", "constant")], "yaml": [(r"^([\w.-]+)\s*:", "constant")],
    "json": [(r'^(?: {2}|\t)"([^"]+)"\s*:', "constant")], "css": [(r"^\s*\.([\w-]+)[^;]*\{", "class"), (r"^\s*#([\w-]+)[^;]*\{", "constant"), (r"^\s*@keyframes\s+([\w-]+)", "function")],
    "scss": [(r"^\s*@mixin\s+([\w-]+)", "function"), (r"^\s*\$([\w-]+)\s*:", "variable"), (r"^\s*\.([\w-]+)[^;]*\{", "class")], "hcl": [(r'^\s*(?:resource|data)\s+"[^"]+"\s+"([^"]+)"', "struct"), (r'^\s*(?:variable|output|module|provider)\s+"([^"]+)"', "variable")],
    "html": [(r"<(script|style)\b", "module"), (r'\bid="([^"]+)"', "constant")], "nix": [(r"^\s*([\w.-]+)\s*=", "variable")],
}
_INDENTED = ["python"]
_ENDED = ["ruby", "lua", "elixir"]


def declared(language: str, content: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, first line, last line) of each declaration; of several patterns on one line the first counts."""
    lines = content.split("\n")
    hits = [next(((m[1], kind) for p, kind in _compiled(language) if (m := p.search(x))), None) for x in lines]
    if not any(hits):
        return []
    n, braces, indent = len(lines), [0], []
    for x in lines:
        braces.append(braces[-1] + x.count("{") - x.count("}"))
        indent.append(len(x) - len(x.lstrip()) if x.strip() else -1)
    closed = _next_not_above(braces)  # where the depth of braces is back at what it was before the line
    filled = [i for i in range(n) if indent[i] >= 0]
    dedent = dict(zip(filled, (filled[k] if k < len(filled) else n for k in _next_not_above([indent[i] for i in filled]))))
    place = {i: k for k, i in enumerate(filled)}
    ends: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.strip() == "end":
            ends.setdefault(indent[i], []).append(i)
    out = []
    for i, hit in enumerate(hits):
        if hit is None:
            continue
        if language in _INDENTED and hit[1] in ("function", "method", "class"):
            stop = dedent.get(i, n)
            end = filled[(place[stop] if stop < n else len(filled)) - 1]
        elif language in _ENDED:
            own = ends.get(indent[i], [])
            k = bisect.bisect_right(own, i)
            end = own[k] if k < len(own) else i
        else:
            end = closed[i] - 1 if braces[i + 1] > braces[i] and closed[i] <= n else i
        out.append((*hit, i + 1, end + 1))
    return out


def _next_not_above(values: list[int]) -> list[int]:
    """For each place the next one with a value that is not larger; the length if there is none. One pass with a stack."""
    out, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and v <= values[open_[-1]]:
            out[open_.pop()] = i
        open_.append(i)
    return out


@cache
def _compiled(language: str) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p), k) for p, k in PATTERNS.get(language, [])]


def extract(files: DataFrame) -> DataFrame:
    """file_id, path, language, ord, name, kind, line_start, line_end, detail. Files are read where they are: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, p, lang, *d) for f, p, lang, c in zip(b["file_id"], b["path"], b["language"], b["content"]) for d in declared(lang, c)]
            yield pd.DataFrame(rows, columns=["file_id", "path", "language", "name", "kind", "line_start", "line_end"])

    kinds = "file_id long, path string, language string, name string, kind string, line_start int, line_end int"
    known = files.where(F.col("language").isin(*PATTERNS)).select("file_id", "path", "language", "content")
    out = without_locals(known.mapInPandas(run, kinds).dropDuplicates(["file_id", "line_start", "name"]))
    ord_ = F.row_number().over(W.partitionBy("file_id").orderBy("line_start", "name")) - 1
    return out.select("file_id", "path", "language", ord_.alias("ord"), "name", "kind", "line_start", "line_end", F.lit(None).cast("string").alias("detail"))


def tag_kind(tag: Column) -> Column:
    """The kind that a tag of a grammar's query stands for; `unknown` if none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in K.TAG_KINDS.items() for x in kv]), tag), F.lit("unknown"))


def unquoted(name: Column) -> Column:
    """A captured name without the one pair of double quotes round it."""
    return F.regexp_replace(name, r'^"(.*)"$', "$1")


def without_locals(symbols: DataFrame) -> DataFrame:
    """Drops constants and variables inside a function's body, unless they hold a symbol of another kind."""
    s = symbols.alias("s")
    outer = symbols.where(F.col("kind").isin("function", "method", "test")).select(F.col("file_id").alias("of"), F.col("line_start").alias("os"), F.col("line_end").alias("oe"))
    inner = symbols.select(F.col("file_id").alias("if_"), F.col("kind").alias("ik"), F.col("line_start").alias("is_"), F.col("line_end").alias("ie"))
    local = s.where(F.col("kind").isin("constant", "variable")).join(outer, (F.col("file_id") == F.col("of")) & (F.col("os") < F.col("line_start")) & (F.col("line_end") <= F.col("oe")), "left_semi")
    local = local.join(inner, (F.col("file_id") == F.col("if_")) & (F.col("ik") != F.col("kind")) & (F.col("is_") >= F.col("line_start")) & (F.col("ie") <= F.col("line_end")), "left_anti")
    return symbols.join(local.select("file_id", "line_start", "name"), ["file_id", "line_start", "name"], "left_anti").select(*symbols.columns)


def python_symbols(files: DataFrame) -> DataFrame:
    """Exact ranges of Python definitions; a file that doesn't parse has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, path, content in zip(b["file_id"], b["path"], b["content"]):
                try:
                    todo = [(n, False) for n in ast.parse(content).body]
                except (SyntaxError, ValueError):
                    continue
                while todo:
                    n, member = todo.pop(0)
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        cls = isinstance(n, ast.ClassDef)
                        rows.append((f, path, n.name, "class" if cls else "method" if member else "function", n.lineno, n.end_lineno))
                        todo += [(x, cls) for x in n.body]
            yield pd.DataFrame(rows, columns=["file_id", "path", "name", "kind", "line_start", "line_end"])

    return files.where("language = 'python'").select("file_id", "path", "content").mapInPandas(parse, "file_id long, path string, name string, kind string, line_start int, line_end int")

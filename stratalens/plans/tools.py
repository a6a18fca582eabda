"""The tools by name, as a caller over a wire would ask for them, and indexing a whole tree."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import constants as K
from stratalens.operators import graph, imports, search, symbols
from stratalens.plans import analyses, reports
from stratalens.sources import corpus, snapshot


def _file(t: dict[str, DataFrame], path: str) -> DataFrame:
    return search.resolve_path(t["files"], path).select(F.col("file_id").alias("node"), "path")


def _paths(t: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    return nodes.join(t["files"].select(F.col("file_id").alias("node"), "path"), "node").drop("node").orderBy("path")


def _step(t: dict[str, DataFrame], path: str, here: str, there: str) -> DataFrame:
    """The files one edge away from a path."""
    return _paths(t, t["edges"].join(_file(t, path), F.col(here) == F.col("node")).select(F.col(there).alias("node")))


#: name: (parameters, the tool over the tables files, symbols, edges, changes)
TOOLS: dict[str, tuple[list[str], Callable[..., DataFrame]]] = {
    "status": ([], lambda t: search.status(t["files"], t["symbols"])),
    "search": (["query", "limit"], lambda t, query, limit=50: search.search(t["files"], query, t["symbols"], limit)),
    "find_symbol": (["name"], lambda t, name: search.find_symbol(t["symbols"], name)),
    "find_word": (["word"], lambda t, word: search.find_word(t["files"], word)),
    "find_callers": (["name"], lambda t, name: search.find_callers(t["files"], t["symbols"], name)),
    "get_outline": (["path"], lambda t, path: search.outline(t["files"], t["symbols"], path)),
    "get_tree": ([], lambda t: search.tree(t["files"], t["symbols"]).orderBy("path")),
    "get_imports": (["path"], lambda t, path: _step(t, path, "src", "dst")),
    "get_imported_by": (["path"], lambda t, path: _step(t, path, "dst", "src")),
    "get_change_impact": (["path", "max_depth"], lambda t, path, max_depth=10: _paths(t, graph.change_impact(t["edges"], _file(t, path).select("node"), max_depth))),
    "plan_change": (["target"], lambda t, target: analyses.plan_change(t["files"], t["symbols"], t["edges"], target)),
    "get_hot_files": (["limit"], lambda t, limit=20: search.hot_files(t["changes"], limit)),
    "read_file": (["path", "start", "end"], lambda t, path, start=1, end=2**31 - 1: search.read_file(t["files"], path, start, end)),
    "read_symbol": (["name", "path", "context"], lambda t, name, path=None, context=0: search.read_symbol(t["files"], t["symbols"], name, path, context)),
    "changes_since": (["since"], lambda t, since: search.changes_since(t["changes"], since)),
    "analyze": (["analysis"], lambda t, analysis: analyses.analyze(analysis, **t)),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """name, parameters."""
    return spark.createDataFrame([(n, ",".join(p)) for n, (p, _) in TOOLS.items()], "name string, parameters string")


def call(tables: dict[str, DataFrame], tool: str, /, **arguments) -> DataFrame:
    """A tool's answer; an unknown tool or argument is an error."""
    if tool not in TOOLS:
        raise ValueError(f"no such tool: {tool}")
    known, run = TOOLS[tool]
    if extra := set(arguments) - set(known):
        raise ValueError(f"{tool} takes no {', '.join(sorted(extra))}")
    return run(tables, **arguments)


def answer(tables: dict[str, DataFrame], request: dict) -> dict:
    """A JSON-RPC request {id, method, params: {name, arguments}} answered; tool answers are bounded by their own limits."""
    out = {"jsonrpc": "2.0", "id": request.get("id")}
    try:
        if request.get("method") == "tools/list":
            return out | {"result": {"tools": [{"name": n, "parameters": p} for n, (p, _) in TOOLS.items()]}}
        if request.get("method") != "tools/call":
            return out | {"error": {"code": -32601, "message": "no such method"}}
        p = request.get("params") or {}
        rows = reports.as_json(call(tables, p.get("name", ""), **(p.get("arguments") or {}))).limit(K.ANSWER_ROWS).collect()
        return out | {"result": {"content": [r["json"] for r in rows]}}
    except (TypeError, ValueError, KeyError) as e:
        return out | {"error": {"code": -32602, "message": str(e)}}


def index_workspace(spark: SparkSession, root: str, target: str) -> dict[str, DataFrame]:
    """Scans a tree anew and saves files, symbols and edges as the newest snapshot. The root folder and a home are refused."""
    at = os.path.normpath(root)
    if at in ("/", os.path.expanduser("~")) or os.path.dirname(at) in ("/home", "/Users"):
        raise ValueError(f"{root} is no workspace")
    files, _ = corpus.directory(spark, root, corpus.ignore_patterns(spark, root))
    snapshot.save(target, root, {"files": files, "symbols": symbols.extract(files), "edges": imports.edges(files)})
    return snapshot.load(spark, target, root)


def content(spark: SparkSession, files: DataFrame, root: str, path: str) -> DataFrame:
    """path, content: what the index holds; else the file itself, if it has no more bytes than a scan takes."""
    held = files.where(F.col("path") == path).select("path", "content")
    if held.limit(1).count():
        return held
    raw = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").where(F.col("length") <= K.MAX_FILE)
    return raw.select(F.lit(path).alias("path"), F.decode("content", "UTF-8").alias("content"))

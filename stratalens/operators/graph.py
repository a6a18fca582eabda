"""Queries over the file graph: edges (src, dst)."""

from __future__ import annotations

import array
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens import constants as K
from stratalens.functions import paths


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder; where none is set: on one machine in a temporary one, on a cluster an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or f"{tempfile.gettempdir()}/stratalens-{uuid.uuid4().hex}")
    return df.checkpoint()


def imports(edges: DataFrame, file_id: int) -> DataFrame:
    return edges.where(F.col("src") == file_id).select("dst")


def imported_by(edges: DataFrame, file_id: int) -> DataFrame:
    return edges.where(F.col("dst") == file_id).select("src")


def change_impact(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth): who depends on `start` (one column, node), directly or not. The start may come back by a cycle.

    Direct dependents are at depth 1, also for max_depth 0; each round joins the frontier with the reversed edges.
    """
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    front = _cut(start.join(back, "node").select(F.col("next").alias("node")).distinct().withColumn("depth", F.lit(1)))
    seen, depth = front, 1
    while depth < max_depth and front.limit(1).count():
        depth += 1
        new = front.join(back, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = _cut(new.withColumn("depth", F.lit(depth)))
        seen = _cut(seen.union(front))
    return seen


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, instability, role. nodes: node, path."""
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    zero = F.lit(0).cast("long")
    out = nodes.join(i, "node", "left").join(o, "node", "left").withColumn("fan_in", F.coalesce("fan_in", zero)).withColumn("fan_out", F.coalesce("fan_out", zero))
    total = F.col("fan_in") + F.col("fan_out")
    entry = paths.any_of([F.col("path").endswith(s) for s in K.ENTRY_SUFFIXES]) | F.col("path").contains("/tests/")
    role = (
        F.when((F.col("fan_in") >= 5) & (F.col("fan_out") >= 10), "god").when((F.col("fan_in") >= 5) & (F.col("fan_out") <= 2), "core")
        .when((F.col("fan_out") >= 10) & (F.col("fan_in") <= 1), "driver").when((total == 0) & ~entry, "island").otherwise("normal")
    )
    return out.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.round(F.col("fan_out") / total, 4))).withColumn("role", role)


def strong(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A number for each node, the same within a strongly connected component. Node v's edges lead to to[first[v]:first[v+1]].

    Pearce's algorithm without recursion: each edge is looked at once and a node costs a few integers, however long the paths.
    """
    n = len(first) - 1
    number, at, way, kept = (array.array(kind, bytes(array.array(kind).itemsize * n)) for kind in "iqii")  # way: from the start to the node at hand
    is_root, ends, out, numbers = bytearray(b"\1") * n, memoryview(first), memoryview(to), np.frombuffer(number, np.int32)
    clock, name, waiting = 1, n, 0
    for start in range(n):
        if number[start]:
            continue
        v, depth = start, 0
        number[v], at[v] = clock, ends[v]
        clock += 1
        while True:
            low, k, end, next_ = number[v], at[v], ends[v + 1], -1
            while end - k > 64 and next_ < 0:  # many edges: some at a time
                x = numbers[to[k : min(k + 512, end)]]
                j = int(x.argmin())
                if not x[j]:
                    next_, x = out[k + j], x[:j]
                if len(x) and (least := int(x.min())) < low:
                    low, is_root[v] = least, 0
                k += len(x) + (next_ >= 0)
            if next_ < 0:
                for w in out[k:end]:
                    k += 1
                    x = number[w]
                    if x < low:
                        if not x:
                            next_ = w
                            break
                        low, is_root[v] = x, 0
            number[v], at[v] = low, k
            if next_ >= 0:  # one that was not seen before
                way[depth], depth, v = v, depth + 1, next_
                number[v], at[v] = clock, ends[v]
                clock += 1
                continue
            if is_root[v]:
                clock -= 1
                while waiting and low <= number[kept[waiting - 1]]:
                    waiting -= 1
                    number[kept[waiting]] = name
                    clock -= 1
                number[v] = name
                name -= 1
            else:
                kept[waiting] = v
                waiting += 1
            if not depth:
                break
            depth -= 1
            done, v = v, way[depth]
            if number[done] < number[v]:
                number[v], is_root[v] = number[done], 0
    return numbers


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a whole graph whose edges arrive sorted by src."""
    nodes, counts, ahead = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for b in batches:
        src, n = np.unique(np.asarray(b.column("src")), return_counts=True)
        nodes.append(src)
        counts.append(n)
        ahead.append(np.array(b.column("dst")))
    names, place = np.unique(np.concatenate(nodes), return_inverse=True)
    fan = np.zeros(len(names), np.int64)
    np.add.at(fan, place, np.concatenate(counts))
    to, end = np.empty(int(fan.sum()), np.int32), 0
    for k, dst in enumerate(ahead):
        at = np.searchsorted(names, dst).clip(max=len(names) - 1)
        to[end : end + len(dst)] = np.where(names[at] == dst, at, -1)
        ahead[k], end = None, end + len(dst)
    has = to >= 0  # what has no way out is in no cycle
    first = np.concatenate([[0], np.cumsum(fan)])
    for v in np.array_split(np.arange(len(names)), max(1, len(names) // 1_000_000)):
        if len(v) and len(to):
            fan[v] = np.add.reduceat(has[: first[v[-1] + 1]], first[v], dtype=np.int64)
    to = to[has]
    del has
    _, least, own, size = np.unique(strong(np.concatenate([[0], np.cumsum(fan)]), to), return_index=True, return_inverse=True, return_counts=True)
    found = np.flatnonzero(size[own] > 1)
    for at in range(0, len(found), 100_000):
        some = found[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[least[own[some]]])], ["node", "component"])


def components(edges: DataFrame, room: int = 600_000_000) -> DataFrame:
    """(node, component): strongly connected components of two and more; component is the smallest node.

    Edges that need up to `room` bytes (8 an edge, 64 a node) go to one task, which looks at each once: rounds over a deep
    graph without cycles would be as many as its longest path has nodes. Of more, nodes without a way in or out are trimmed and the rest is coloured, forward
    and backward: the largest colour that reaches a node by forward propagation names a candidate set; those that the
    colour's own node can be reached from make up its component. Components found leave the graph, and so do edges
    between colours, which are in no cycle; the rest goes on until there are few enough.
    """
    kind = edges.select("src").dtypes[0][1]
    rest, found = _cut(edges.where("src <> dst").distinct()), None
    while n := rest.count():
        if kind in ("tinyint", "smallint", "int", "bigint") and 8 * n + 64 * rest.select("src").distinct().count() <= room:
            long = [F.col(c).cast("long").alias(c) for c in ("src", "dst")]
            own = rest.select(*long).coalesce(1).sortWithinPartitions("src").mapInArrow(_strong, "node long, component long")
            got, rest = _cut(own.select(F.col("node").cast(kind), F.col("component").cast(kind))), rest.limit(0)
        else:
            got, rest = _round(rest)
        found = got if found is None else found.union(got)
    spark = edges.sparkSession
    return found if found is not None else spark.createDataFrame([], "node long, component long")


def _round(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One component of each colour, and the edges among what is left."""
    rest = _cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    color = _spread(rest, rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().withColumn("color", F.col("node")), "src", "dst", "color")
    inside = _cut(rest.join(color.withColumnRenamed("node", "src").withColumnRenamed("color", "a"), "src").join(color.withColumnRenamed("node", "dst").withColumnRenamed("color", "b"), "dst").where("a = b").select("src", "dst"))
    mine = color.withColumn("hit", (F.col("node") == F.col("color")).cast("int"))
    hit = _spread(inside, mine.select("node", "hit"), "dst", "src", "hit").where("hit = 1").select("node")
    got = hit.join(color, "node")
    named = got.groupBy("color").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    got = _cut(got.join(named, "color").select("node", "component"))
    left = inside.join(hit.withColumnRenamed("node", "src"), "src", "left_anti").join(hit.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return got, _cut(left.select("src", "dst"))


def cycle_groups(edges: DataFrame, files: DataFrame, limit: int | None = 25, names: int = 8) -> DataFrame:
    """component, size, files (the first few by path), of the largest cycles. files: file_id, path."""
    own = components(edges).join(files.select(F.col("file_id").alias("node"), "path"), "node")
    rank = F.row_number().over(W.partitionBy("component").orderBy("path"))
    own = own.withColumn("rank", rank)
    out = own.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank") <= names, F.col("path")))), ",").alias("files"))
    return out.orderBy(F.desc("size"), "component").limit(limit) if limit else out


def coupling_top(metrics: DataFrame, most: int = 15) -> DataFrame:
    """role, place, path, fan_in, fan_out: of each telling role those with most edges. metrics: as `coupling` gives them."""
    place = F.row_number().over(W.partitionBy("role").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "path"))
    return metrics.where(F.col("role") != "normal").withColumn("place", place).where(F.col("place") <= most).select("role", "place", "path", "fan_in", "fan_out")


def _spread(edges: DataFrame, values: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Passes the largest value on along edges from a to b until nothing changes."""
    values = _cut(values)
    while True:
        come = edges.join(values, edges[a] == F.col("node")).groupBy(F.col(b).alias("to")).agg(F.max(name).alias("come"))
        new = values.join(come, F.col("node") == F.col("to"), "left").select("node", F.greatest(name, F.coalesce("come", name)).alias(name), (F.coalesce("come", name) > F.col(name)).alias("moved"))
        new = _cut(new)
        if not new.where("moved").limit(1).count():
            return new.select("node", name)
        values = new.select("node", name)


def package(path, depth: int = 2):
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).when(F.size(parts) > 1, paths.dirname(path)).otherwise(path)


def package_edges(edges: DataFrame, files: DataFrame, least: int = 1) -> DataFrame:
    f = files.select("file_id", package(F.col("path")).alias("pkg"))
    out = edges.join(f.withColumnsRenamed({"file_id": "src", "pkg": "from_pkg"}), "src").join(f.withColumnsRenamed({"file_id": "dst", "pkg": "to_pkg"}), "dst")
    return out.where("from_pkg <> to_pkg").groupBy("from_pkg", "to_pkg").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def mermaid(package_edges: DataFrame) -> str:
    """The package graph as text: package pairs only, which the reader of a chart can still see."""
    rows = package_edges.orderBy("from_pkg", "to_pkg").collect()
    return "\n".join(["graph LR", *[f'  "{r["from_pkg"]}" -->|{r["weight"]}| "{r["to_pkg"]}"' for r in rows]])

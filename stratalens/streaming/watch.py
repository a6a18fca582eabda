"""File changes as a stream: a source that lists a folder, and a sink that applies the changes.

The source's offset is the listing's number; listings themselves are kept in a side folder, so offsets stay small. The
first listing is silent. Per path and micro-batch only the last event is applied, which stands for a debounce.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class ListingSource(DataSource):
    """spark.readStream.format("listing").option("path", ...).option("state", a folder for listings)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, op string, version long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return ListingReader(self.options["path"], self.options["state"])


def listing(root: str) -> dict[str, list[int]]:
    out = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        for n in names:
            s = os.stat(p := os.path.join(folder, n))
            out[os.path.relpath(p, root)] = [s.st_mtime_ns, s.st_size]
    return out


def difference(old: dict, new: dict) -> list[tuple[str, str]]:
    gone = [(p, "delete") for p in sorted(old.keys() - new.keys())]
    return gone + [(p, "create" if p not in old else "modify") for p in sorted(new) if old.get(p) != new[p]]


class ListingReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, state
        os.makedirs(state, exist_ok=True)

    def _keep(self, version: int, found: dict) -> None:
        at = os.path.join(self.state, f"{version}.json")
        with open(f"{at}.tmp", "w") as f:
            json.dump(found, f)
        os.replace(f"{at}.tmp", at)

    def _kept(self, version: int) -> dict:
        with open(os.path.join(self.state, f"{version}.json")) as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        self._keep(0, listing(self.root))
        return {"version": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = self._kept(start["version"]), listing(self.root)
        events = difference(old, new)
        if not events:
            return iter([]), start
        version = start["version"] + 1
        self._keep(version, new)
        return iter([(p, op, version) for p, op in events]), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for v in range(start["version"] + 1, end["version"] + 1):
            yield from ((p, op, v) for p, op in difference(self._kept(v - 1), self._kept(v)))

    def commit(self, end: dict) -> None:
        for v in range(end["version"] - 2, -1, -1):
            try:
                os.remove(os.path.join(self.state, f"{v}.json"))
            except FileNotFoundError:
                break


def last_events(batch: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("path").orderBy(F.desc("version"), F.desc("op")))
    return batch.withColumn("n", n).where("n = 1").drop("n")


def apply_changes(files: DataFrame, events: DataFrame, read) -> DataFrame:
    """files with events applied: `read` makes rows of files from the paths that were created or modified."""
    last = last_events(events)
    fresh = read(last.where("op <> 'delete'").select("path"))
    return files.join(last.select("path"), "path", "left_anti").unionByName(fresh)


def watch(spark: SparkSession, root: str, state: str, checkpoint: str, on_batch):
    """Starts the stream; on_batch gets each micro-batch's last events."""
    spark.dataSource.register(ListingSource)
    events = spark.readStream.format("listing").option("path", root).option("state", state).load()
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: on_batch(last_events(df), n)).start()

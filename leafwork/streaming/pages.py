"""Page results as streams: upserts of single pages, and debounced writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import latest, patched


class PageTable:
    """The newest result of each page, as numbered snapshots under one folder.

    A batch writes the next snapshot and only then an empty file ``done/<number>``; the largest number is current. So a replayed
    batch changes nothing, and a crash at any point leaves the last whole snapshot. All but the last two snapshots are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order

    def _files(self, name: str):
        """The file system and the path of a name under the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _done(self) -> list[int]:
        files, path = self._files("done")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []

    def _current(self) -> int | None:
        return max(self._done(), default=None)

    def read(self) -> DataFrame | None:
        now = self._current()
        return None if now is None else self.spark.read.parquet(f"{self.path}/v{now}")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Puts the newest row of each page of the batch in place of the page's older one."""
        now = self._current()
        if now is not None and now >= number:
            return
        changes = latest(batch, self.keys, self.order)
        if now is not None:
            base = self.spark.read.parquet(f"{self.path}/v{now}")
            changes = latest(base.unionByName(changes), self.keys, self.order)
        changes.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        files, path = self._files(f"done/{number}")
        files.create(path, True).close()
        for old in self._done()[:-2]:
            for name in (f"done/{old}", f"v{old}"):
                files, path = self._files(name)
                files.delete(path, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def debounced(stream: DataFrame, key: str, content: str, quiet_ms: int = 200) -> DataFrame:
    """The last content of each burst of edits: key, content, edits. A burst ends once the key has been quiet for quiet_ms of processing time."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, edits = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], content: [value], "edits": [edits]})
            return
        value, edits = state.get if state.exists else (None, 0)
        for frame in frames:
            if len(frame):
                value, edits = frame[content].iloc[-1], edits + len(frame)
        state.update((value, edits))
        state.setTimeoutDuration(quiet_ms)

    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {fields[key]}, {content} {fields[content]}, edits long"
    return stream.select(key, content).groupBy(key).applyInPandasWithState(run, out, f"value {fields[content]}, edits long", "append", "ProcessingTimeTimeout")


def bursts(events: DataFrame, key: str, ts: str, content: str, gap: str = "200 milliseconds") -> DataFrame:
    """The same over event time, for streams (with a watermark) and tables alike: key, start, content, edits of each session."""
    session = F.session_window(F.col(ts), gap)
    out = events.groupBy(key, session.alias("s")).agg(F.max_by(content, F.struct(ts, content)).alias(content), F.count("*").alias("edits"))
    return out.select(key, F.col("s.start").alias("start"), content, "edits")


def patched_pages(base: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """One re-extracted page in place of the old one; the others stay."""
    return patched(base, change, keys)

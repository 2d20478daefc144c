"""Folder changes and log records as streams."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SNAPSHOT = "snapshot long, path string, mtime long, size long"
EVENT = "path string, change string, snapshot long"
#: Rows of path, snapshot, mtime, size and whether it is live, as JSON.
STATE = "known string"
#: Groups of paths; a stream that is taken up again has to have as many.
GROUPS = 2048


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A stream of folder snapshots: one row per file and snapshot, written by a poller as JSON files."""
    return spark.readStream.schema(SNAPSHOT + ", deleted boolean").json(path)


def _changes(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = {path: last for path, *last in json.loads(state.get[0])} if state.exists else {}
    whole = lambda values: [None if v != v or v is None else int(v) for v in values.tolist()]
    seen = [r for f in rows for r in zip(whole(f["snapshot"]), f["path"].tolist(), whole(f["mtime"]), whole(f["size"]), f["deleted"].tolist())]
    out = []
    for snapshot, path, mtime, size, deleted in sorted(seen, key=itemgetter(0)):
        last = known.get(path)
        was_live = bool(last and last[3])
        if deleted:
            change = "deleted" if was_live else None
        elif not was_live:
            change = None if snapshot == 0 else "created"  # the first snapshot is silent
        else:
            change = "modified" if [mtime, size] != last[1:3] else None
        known[path] = [snapshot, mtime, size, not deleted]
        if change:
            out.append((path, change, snapshot))
    state.update((json.dumps([[path, *last] for path, last in known.items()]),))
    yield pd.DataFrame(out, columns=["path", "change", "snapshot"])


def changes(stream: DataFrame) -> DataFrame:
    """path, change, snapshot: created, modified, deleted. Nothing is dropped when many come.

    What is known of a path is held with that of others in one of GROUPS states: Python is called for a group, not for a path,
    and a snapshot names every path in any case. A state has some 60 bytes a path.
    """
    group = F.pmod(F.xxhash64("path"), F.lit(GROUPS))
    return stream.withColumn("group", group).groupBy("group").applyInPandasWithState(_changes, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


class EventBuffer:
    """Holds a bounded number of events between a watcher and its reader; while it is full, new ones are dropped and counted."""

    def __init__(self, most: int = 64):
        self.most, self.dropped, self._events, self._lock = most, 0, deque(), threading.Lock()

    def put(self, event) -> bool:
        with self._lock:
            if len(self._events) >= self.most:
                self.dropped += 1
                return False
            self._events.append(event)
            return True

    def drain(self) -> list:
        with self._lock:
            out, self._events = list(self._events), deque()
        return out


class Watcher:
    """Polls a folder; each poll is a snapshot difference. A failed scan keeps the last snapshot and is counted.

    A snapshot is a table in ``state``, by default below spark.checkpoint.dir.
    """

    def __init__(self, spark: SparkSession, root: str, warn_after: int = 3, state: str | None = None):
        self.spark, self.root, self.warn_after = spark, root, warn_after
        base = state or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tidewater-watch-")
        self.state = f"{base.rstrip('/')}/watch-{uuid.uuid4().hex}"
        self.last: DataFrame | None = None
        self.failures = self.polls = 0

    def poll(self) -> tuple[DataFrame | None, str | None]:
        from ..operators.merge import snapshot_diff
        from ..sources.files import raw_files

        try:
            rows = raw_files(self.spark, self.root).select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))
            self.polls += 1
            rows.write.parquet(f"{self.state}/{self.polls:09d}")
            held = self.spark.read.schema("path string, mtime long, size long").parquet(f"{self.state}/{self.polls:09d}")
        except Exception as e:
            self.failures += 1
            return None, f"{self.failures} scans failed: {e}" if self.failures >= self.warn_after else None
        self.failures = 0
        before, self.last = self.last, held
        return (snapshot_diff(before, held) if before is not None else None), None

    def run(self, scan: Callable[[], object], buffer: EventBuffer, stop: threading.Event, network: bool = False, every: float | None = None) -> None:
        """Polls until ``stop`` is set. Changes go to the buffer, and any change calls ``scan`` for a whole new scan."""
        while not stop.is_set():
            found, _ = self.poll()
            events = found.limit(buffer.most + 1).collect() if found is not None else []  # no more than the buffer can take
            for e in events:
                buffer.put((e.path, e.change))
            if events:
                scan()
            stop.wait(INTERVALS[network] if every is None else every)


#: Seconds between polls: shares over a network are polled less often.
INTERVALS = {False: 2.0, True: 5.0}


def interval(network: bool) -> str:
    """The trigger of a stream over polled snapshots."""
    return f"{INTERVALS[network]:.0f} seconds"

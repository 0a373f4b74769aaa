"""Read models kept up to date from a log store, exactly once.

A runner folds the events since its checkpoint and merges them into the last model version. The new version and the
checkpoint become visible together, by one manifest created without overwriting; a batch that was already committed
is skipped, so a retried micro-batch changes nothing. An error marks the runner failed and leaves the batch unapplied.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.errors import FailedPrecondition, NotFound, Unavailable
from tidemark.sources.atomic import newest, publish, read
from tidemark.sources.store import SCHEMA, LogStore, parse_token, token


#: Seconds that a read waits for the position of its token, unless told otherwise, and at most.
WAIT, LONGEST_WAIT = 5.0, 30.0


@dataclass
class Projection:
    """``fold`` turns events into rows by key, ``merge`` an old and a new set of rows into one."""

    name: str
    families: list[str]
    schema: str
    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame, DataFrame], DataFrame]


class Runner:
    def __init__(self, store: LogStore, projection: Projection, path: str) -> None:
        self.store, self.projection = store, projection
        self.path = f"{path.rstrip('/')}/{projection.name}"
        self.spark, self.fs, self._jpath = store.spark, store.fs, store._jpath
        self.status, self.error = "STARTING", None

    def checkpoint(self) -> dict:
        found = newest(self.spark, f"{self.path}/checkpoints")
        return found or {"n": -1, "next": 0, "last_event_id": None, "generation": self.store.manifest()["generation"], "dir": None}

    def _commit(self, c: dict) -> None:
        try:
            publish(self.spark, f"{self.path}/checkpoints/{c['n']:012d}.json", json.dumps(c).encode())
        except FileExistsError as e:
            raise FailedPrecondition("another runner committed first", code="CONFLICT") from e

    def table(self) -> DataFrame:
        c = self.checkpoint()
        return self.spark.read.schema(self.projection.schema).parquet(f"{self.path}/{c['dir']}") if c["dir"] else self.spark.createDataFrame([], self.projection.schema)

    def _stale(self, c: dict) -> bool:
        """Whether the log no longer holds the last event that a checkpoint has seen."""
        if c["next"] > self.store.head:
            return True
        if not c["next"] or not c["last_event_id"]:
            return False
        own = self.store.events(c["next"] - 1, c["next"]).select("event_id").first()
        return own is None or own[0] != c["last_event_id"]

    def resume(self) -> dict:
        """The checkpoint to go on from: reset if a cut or another log took away what it has seen."""
        c, m = self.checkpoint(), self.store.manifest()
        if self._stale(c):
            c = {"n": c["n"] + 1, "next": 0, "last_event_id": None, "generation": m["generation"], "dir": None}
            self._commit(c)
        return c

    def rebuild(self, snapshot: str | None = None) -> int:
        """Fold the log again, from the start or from a snapshot that still holds; returns the next position."""
        c = self.checkpoint()
        base = {"next": 0, "last_event_id": None, "dir": None}
        if snapshot is not None:
            base = next((s for s in self.snapshots() if s["name"] == snapshot), None)
            if base is None:
                raise NotFound(f"no snapshot {snapshot}")
            if self._stale(base):
                raise FailedPrecondition("the snapshot has seen events that the log no longer holds")
        self.status, self.error = "REBUILDING", None
        self._commit({**c, "n": c["n"] + 1, **{k: base[k] for k in ("next", "last_event_id", "dir")}})
        return self.catch_up()

    # ---- snapshots: versions of the model that are kept by name

    def _names(self, folder: str) -> list[str]:
        at = self._jpath(f"{self.path}/{folder}")
        return sorted(n for n in (f.getPath().getName() for f in self.fs.listStatus(at)) if not n.startswith(".")) if self.fs.exists(at) else []

    def snapshots(self) -> list[dict]:
        """The snapshots, oldest position first."""
        out = []
        for name in self._names("snapshots"):
            out.append(json.loads(read(self.spark, f"{self.path}/snapshots/{name}")))
        return sorted(out, key=lambda s: (s["next"], s["n"]))

    def snapshot(self) -> dict:
        """Keep the present version; it costs a small file, as versions are never written again."""
        c = self.checkpoint()
        about = {**c, "name": f"{c['next']:012d}-{c['n']:012d}"}
        if all(s["name"] != about["name"] for s in self.snapshots()):
            publish(self.spark, f"{self.path}/snapshots/{about['name']}.json", json.dumps(about).encode())
        return about

    def drop_snapshot(self, name: str) -> None:
        if all(s["name"] != name for s in self.snapshots()):
            raise NotFound(f"no snapshot {name}")
        self.fs.delete(self._jpath(f"{self.path}/snapshots/{name}.json"), False)

    def vacuum(self) -> int:
        """Delete the versions that neither the checkpoint nor a snapshot names, and older checkpoints; no query may
        be reading them, and no batch may be running. Returns how many versions went."""
        c = self.checkpoint()
        kept = {s["dir"] for s in [c, *self.snapshots()]}
        gone = [n for n in self._names("versions") if f"versions/{n}" not in kept]
        for n in gone:
            self.fs.delete(self._jpath(f"{self.path}/versions/{n}"), True)
        for n in self._names("checkpoints")[:-1]:
            self.fs.delete(self._jpath(f"{self.path}/checkpoints/{n}"), False)
        return len(gone)

    def drop(self) -> None:
        """Delete the read model with its checkpoint and snapshots."""
        self.fs.delete(self._jpath(self.path), True)
        self.status, self.error = "STARTING", None

    def health(self) -> dict:
        c, head = self.checkpoint(), self.store.head
        return {"name": self.projection.name, "status": self.status, "error": self.error, "next": c["next"], "head": head, "behind": max(head - c["next"], 0), "snapshots": len(self.snapshots())}

    def apply(self, events: DataFrame, end: int) -> bool:
        """Fold the events from the checkpoint up to ``end``; False if that was done before."""
        c = self.checkpoint()
        if c["next"] >= end:
            return False
        batch = events.where((F.col("position") >= c["next"]) & (F.col("position") < end))
        try:
            new = self.projection.fold(batch.where(F.col("family").isin(self.projection.families)))
            name = f"versions/{uuid.uuid4().hex}"
            self.projection.merge(self.table(), new).write.parquet(f"{self.path}/{name}")
            last = batch.where(F.col("position") == end - 1).select("event_id").first()
            self._commit({"n": c["n"] + 1, "next": end, "last_event_id": last and last[0], "generation": self.store.manifest()["generation"], "dir": name})
        except Exception as e:
            self.status, self.error = "FAILED", str(e)
            raise
        return True

    def catch_up(self, batch: int | None = None) -> int:
        """All events up to the head, ``batch`` positions at a time; returns the next position."""
        c, head = self.resume(), self.store.head
        self.status = "CATCHING_UP"
        start = c["next"]
        while start < head:
            end = min(head, start + (batch or head))
            self.apply(self.store.events(start, end), end)
            start = end
        self.status = "LIVE"
        return start

    def stream(self, checkpoint: str):
        """A structured streaming query over the log's data that applies what is committed; run it to the end."""
        source = self.spark.readStream.schema(SCHEMA).parquet(f"{self.store.path}/data/*")

        def each(batch: DataFrame, _: int) -> None:
            self.resume()
            head = self.store.head  # what no manifest lists yet is left for a later batch
            top = batch.agg(F.max("position")).first()[0]
            if top is not None and head > self.checkpoint()["next"]:
                self.apply(self.store.events(self.checkpoint()["next"], head), head)

        return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # ---- reads

    def _wait(self, min_token: str | None, seconds: float = WAIT) -> None:
        if self.status == "FAILED":
            raise FailedPrecondition(self.error or "the projection failed")
        if min_token:
            log_id, _, position = parse_token(min_token)
            if log_id != self.store.manifest()["log_id"]:
                raise FailedPrecondition("the token is of another log")
            until = time.monotonic() + min(seconds, LONGEST_WAIT)
            while self.checkpoint()["next"] <= position:
                if self.store.head > position:
                    self.catch_up()
                elif time.monotonic() >= until:
                    raise Unavailable("the projection is behind the token")
                else:
                    time.sleep(0.1)

    def get(self, min_token: str | None = None, **key: object) -> tuple[dict | None, str]:
        """The row with a key (None if absent) and a token for reads that must not be older."""
        from tidemark.operators.log import get

        self._wait(min_token)
        row = get(self.table(), **key).first()
        return row and row.asDict(True), self._token()

    def scan(self, keys: list[str], prefix: dict[str, object] | None = None, limit: int = 0, min_token: str | None = None) -> tuple[DataFrame, str]:
        """Rows whose leading key fields equal ``prefix``, in key order, and a token; limit 0 means 100."""
        from tidemark.operators.log import scan

        self._wait(min_token)
        return scan(self.table(), keys, prefix, limit), self._token()

    def _token(self) -> str:
        m = self.store.manifest()
        return token(m["log_id"], m["epoch"], max(self.checkpoint()["next"] - 1, 0))

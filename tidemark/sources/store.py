"""An append-only event log in a folder that Spark can reach: Parquet data, one manifest file per commit.

A commit writes its events as Parquet first and then creates manifest ``n+1`` without overwriting: of two writers one
fails, and data without a manifest is invisible. The manifest lists the visible folders with their position ranges,
so reads prune by position, and holds head, epoch, generation and cut. Each event row carries its batch end flag.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, PermissionDenied
from tidemark.schema.model import Schema
from tidemark.sources.atomic import newest, publish, read

SCHEMA = "position bigint, batch_id bigint, last_in_batch boolean, event_id string, stream_id string, stream_version bigint, family string, type_version int, recorded_at_nanos bigint, payload string, metadata string"
KEYS = "key string, position bigint"
#: The largest record, in bytes, and the context that clients may not write.
RECORD_BYTES, RESERVED = 16 << 20, "System."


@dataclass
class Event:
    family: str
    payload: dict
    version: int = 1
    metadata: dict | None = None


def token(log_id: str, epoch: int, position: int) -> str:
    return f"tm1:{log_id}:{epoch}:{position}"


def parse_token(text: str) -> tuple[str, int, int]:
    parts = text.split(":")
    if len(parts) != 4 or parts[0] != "tm1" or not parts[2].isdigit() or not parts[3].isdigit():
        raise InvalidArgument("malformed token")
    return parts[1], int(parts[2]), int(parts[3])


class LogStore:
    def __init__(self, spark: SparkSession, path: str, domain: Schema | None = None) -> None:
        """``domain``: what ``append`` holds events against; without it payloads are written as they come."""
        self.spark, self.path, self.domain = spark, path.rstrip("/"), domain
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    @classmethod
    def create(cls, spark: SparkSession, path: str, log_id: str | None = None, domain: Schema | None = None) -> LogStore:
        store = cls(spark, path, domain)
        if store.fs.exists(store._jpath(f"{store.path}/manifests")):
            raise FailedPrecondition("a log exists there")
        store._commit({"n": 0, "log_id": log_id or str(uuid.uuid4()), "head": 0, "epoch": 1, "generation": 0, "cut": None, "fenced": False, "files": [], "keys": []})
        return store

    def _commit(self, manifest: dict) -> None:
        try:
            publish(self.spark, f"{self.path}/manifests/{manifest['n']:012d}.json", json.dumps(manifest).encode())
        except FileExistsError as e:
            raise FailedPrecondition("another writer committed first", code="CONFLICT") from e

    def manifest(self) -> dict:
        found = newest(self.spark, f"{self.path}/manifests")
        if found is None:
            raise NotFound("no log there")
        return found

    @property
    def head(self) -> int:
        return self.manifest()["head"]

    # ---- reads

    def events(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Visible events of [start, end); folders outside the range are not opened."""
        files = [f for f in self.manifest()["files"] if f["until"] > start and (end is None or f["first"] < end)]
        out = self.spark.createDataFrame([], SCHEMA)
        if files:
            # what a cut hides of a folder lies at its end; later folders start at the cut again
            parts = [self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{f['dir']}" for f in files if f["until"] == f["stop"]])] if any(f["until"] == f["stop"] for f in files) else []
            parts += [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{f['dir']}").where(F.col("position") < f["until"]) for f in files if f["until"] != f["stop"]]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
        out = out.where(F.col("position") >= start) if start else out
        return out.where(F.col("position") < end) if end is not None else out

    def stream_version(self, stream: str) -> int | None:
        return self.events().where(F.col("stream_id") == stream).agg(F.max("stream_version")).first()[0]

    def lookup_key(self, key: str) -> int | None:
        if not key:
            raise InvalidArgument("empty idempotency key")
        m = self.manifest()
        if not m["keys"]:
            return None
        keys = self.spark.read.schema(KEYS).parquet(*[f"{self.path}/keys/{k}" for k in m["keys"]])
        return keys.where((F.col("key") == key) & (F.col("position") < m["head"])).agg(F.min("position")).first()[0]

    def divergence(self, start: int, last_event_id: str | None) -> None:
        """A subscriber at ``start`` must not be past the head, and its last event must be ours."""
        if start > self.head:
            raise FailedPrecondition("the subscriber is past the head")
        if start and last_event_id is not None:
            own = self.events(start - 1, start).select("event_id").first()
            if own is None or own[0] != last_event_id:
                raise FailedPrecondition("the subscriber's last event is not in this log")

    # ---- writes

    def append(self, stream: str, expected: str | int, events: list[Event], key: str | None = None, epoch: int | None = None, system: bool = False, now: int | None = None, at: dict | None = None) -> int:
        """Append a batch to a stream and return its last position.

        expected: any, no_stream, stream_exists or the exact last version. A key already written raises. ``at``: a
        manifest that must still be the newest, whatever stream a later commit wrote.
        """
        if not events:
            raise InvalidArgument("empty batch")
        if not 1 <= len(stream.encode()) <= 255 or any(ord(c) < 32 or ord(c) == 127 for c in stream):
            raise InvalidArgument("bad stream id")
        if not system and any(e.family.startswith(RESERVED) for e in events):
            raise PermissionDenied("reserved context")
        payloads = [json.dumps(e.payload, ensure_ascii=False, separators=(",", ":")) for e in events]
        if self.domain is not None:
            payloads = self._prepared(stream, events, payloads)
        if any(len(p.encode()) > RECORD_BYTES for p in payloads):
            raise InvalidArgument("oversized record")
        m = self.manifest() if at is None else at
        self._writable(m, epoch)
        if key is not None and (before := self.lookup_key(key)) is not None:
            raise AlreadyExists(before)
        actual = self.stream_version(stream)
        ok = {"any": True, "no_stream": actual is None, "stream_exists": actual is not None}.get(expected, actual == expected)
        if not ok:
            raise FailedPrecondition("wrong expected version", actual=actual)
        first, version = m["head"], -1 if actual is None else actual
        nanos = time.time_ns() if now is None else now
        rows = [(first + i, m["n"] + 1, i == len(events) - 1, str(uuid.uuid4()), stream, version + 1 + i, e.family, e.version, nanos, p, json.dumps(e.metadata or {})) for i, (e, p) in enumerate(zip(events, payloads))]
        self._add(m, self.spark.createDataFrame(rows, SCHEMA).coalesce(1), len(rows), [(key, first)] if key is not None else [])
        return first + len(rows) - 1

    def _prepared(self, stream: str, events: list[Event], payloads: list[str]) -> list[str]:
        """Canonical payloads of events that fit the domain and the stream; system events pass as they are."""
        from tidemark.functions.validate import prepared

        own = [i for i, e in enumerate(events) if not e.family.startswith(RESERVED)]
        rows = [(i, stream, f"{events[i].family}@v{events[i].version}", payloads[i], json.dumps(events[i].metadata or {})) for i in own]
        frame = self.spark.createDataFrame(rows, "i int, stream_id string, type_ref string, payload string, metadata string")
        for r in prepared(self.domain, frame, sorted({events[i].family for i in own})).select("i", "canonical", "errors").collect():
            if r["errors"]:
                kind = NotFound if r["errors"] == ["unknown event type"] else InvalidArgument
                raise kind(f"{events[r['i']].family}: {'; '.join(r['errors'])}")
            payloads[r["i"]] = r["canonical"]
        return payloads

    def append_frame(self, rows: DataFrame, epoch: int | None = None) -> int:
        """Append many events as one batch each: ``rows(ord, stream_id, family, type_version, recorded_at_nanos, payload)``.

        The rows are staged in ranges of ``ord``; positions and versions then follow from counts per range, so that no
        task sorts more than a range.
        """
        from tidemark.operators.running import running
        from tidemark.sources.events import dense_positions

        m = self.manifest()
        self._writable(m, epoch)
        heads = self.events().groupBy("stream_id").agg(F.max("stream_version").alias("_v"))
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(ranges, "ord").withColumn("_range", F.spark_partition_id()).write.parquet(staged)
        ranged = self.spark.read.parquet(staged)
        own = running(ranged, ["stream_id"], ["ord"], F.col("_range"), sums={"_o": F.lit(1).cast("long")})
        out = dense_positions(own, F.col("_range"), "ord").withColumn("position", F.col("position") + F.lit(m["head"])).join(heads, "stream_id", "left")
        out = out.select(F.col("position").cast("long").alias("position"), F.col("position").cast("long").alias("batch_id"), F.lit(True).alias("last_in_batch"), F.expr("uuid()").alias("event_id"), "stream_id", (F.coalesce("_v", F.lit(-1)) + F.col("_o")).cast("long").alias("stream_version"), "family", "type_version", "recorded_at_nanos", "payload", F.lit("{}").alias("metadata"))
        try:
            return self._add(m, out, None, [])
        finally:
            self.fs.delete(self._jpath(staged), True)

    def _writable(self, m: dict, epoch: int | None) -> None:
        if m["fenced"]:
            raise FailedPrecondition("the log is fenced")
        if epoch is not None and epoch != m["epoch"]:
            raise FailedPrecondition("stale or newer fencing token")

    def _add(self, m: dict, rows: DataFrame, n: int | None, keys: list[tuple[str, int]]) -> int:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        if n is None:
            n = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{name}").count()
        if keys:
            self.spark.createDataFrame(keys, KEYS).coalesce(1).write.parquet(f"{self.path}/keys/{name}")
        stop = m["head"] + n
        files = [*m["files"], {"dir": name, "first": m["head"], "stop": stop, "until": stop}] if n else m["files"]
        self._commit({**m, "n": m["n"] + 1, "head": stop, "files": files, "keys": [*m["keys"], *([name] if keys else [])]})
        return stop - 1

    # ---- administration

    def fence(self) -> int:
        """Take a new epoch; writers with an older token are refused."""
        m = self.manifest()
        self._commit({**m, "n": m["n"] + 1, "epoch": m["epoch"] + 1})
        return m["epoch"] + 1

    def position_after(self, nanos: int) -> int:
        """The first position recorded after a time, back to its batch's start; the head if there is none."""
        at = self.events().where(F.col("recorded_at_nanos") > nanos).agg(F.min("position")).first()[0]
        if at is None:
            return self.head
        batch = self.events(at, at + 1).select("batch_id").first()[0]
        return self.events().where(F.col("batch_id") == batch).agg(F.min("position")).first()[0]

    def truncate(self, cut: int) -> None:
        """Hide all events from ``cut`` on; a cut inside a batch is refused."""
        m = self.manifest()
        if not 0 <= cut <= m["head"]:
            raise InvalidArgument("position out of range")
        if 0 < cut < m["head"] and not self.events(cut - 1, cut).select("last_in_batch").first()[0]:
            batch = self.events(cut, cut + 1).select("batch_id").first()[0]
            lo, hi = self.events().where(F.col("batch_id") == batch).agg(F.min("position"), F.max("position")).first()
            raise InvalidArgument(f"{cut} lies inside the batch of {lo} to {hi}")
        files = [{**f, "until": min(f["until"], cut)} for f in m["files"] if f["first"] < cut]
        keys = m["keys"]
        if keys:
            left = self.spark.read.schema(KEYS).parquet(*[f"{self.path}/keys/{k}" for k in keys]).where(F.col("position") < cut)
            name = uuid.uuid4().hex
            left.write.parquet(f"{self.path}/keys/{name}")
            keys = [name]
        self._commit({**m, "n": m["n"] + 1, "head": cut, "files": files, "keys": keys, "generation": m["generation"] + 1, "cut": cut})

    def replication_chunk(self, start: int, last_event_id: str | None = None, records: int = 1024) -> dict:
        """About ``records`` events from ``start``, to the end of a batch, with the keys they wrote."""
        self.divergence(start, last_event_id)
        m = self.manifest()
        near = self.events(start, start + records)
        end = near.where("last_in_batch").agg(F.max("position")).first()[0]
        if end is None:  # one batch is longer than the chunk
            end = self.events(start).where("last_in_batch").agg(F.min("position")).first()[0]
        stop = start if end is None else end + 1
        keys = self.spark.read.schema(KEYS).parquet(*[f"{self.path}/keys/{k}" for k in m["keys"]]) if m["keys"] else self.spark.createDataFrame([], KEYS)
        return {"log_id": m["log_id"], "start": start, "stop": stop, "events": self.events(start, stop), "keys": keys.where((F.col("position") >= start) & (F.col("position") < stop))}

    def apply_chunk(self, chunk: dict) -> int:
        """Append a chunk of the same log that starts at this log's head; returns the new head."""
        m = self.manifest()
        if chunk["log_id"] != m["log_id"] or chunk["start"] != m["head"]:
            raise FailedPrecondition("the chunk does not continue this log")
        if chunk["stop"] > chunk["start"]:
            self._add(m, chunk["events"], chunk["stop"] - chunk["start"], [tuple(r) for r in chunk["keys"].collect()])
        return self.head

    def health(self) -> DataFrame:
        """One row: what the manifest says."""
        m = self.manifest()
        row = (m["log_id"], m["head"], m["epoch"], m["generation"], m["cut"], len(m["files"]), m["fenced"])
        return self.spark.createDataFrame([row], "log_id string, head bigint, epoch bigint, generation bigint, cut bigint, folders bigint, fenced boolean")

    def backup(self, dest: str, base_head: int = 0) -> dict:
        """Copy events [base_head, head) and all keys; with base_head 0 a full backup."""
        m = self.manifest()
        if base_head > m["head"]:
            raise InvalidArgument("the base is past the head")
        self.events(base_head, m["head"]).write.parquet(f"{dest}/events")
        keys = self.spark.read.schema(KEYS).parquet(*[f"{self.path}/keys/{k}" for k in m["keys"]]) if m["keys"] else self.spark.createDataFrame([], KEYS)
        keys.where((F.col("position") >= base_head) & (F.col("position") < m["head"])).write.parquet(f"{dest}/keys")
        about = {"log_id": m["log_id"], "base_head": base_head, "head": m["head"]}
        publish(self.spark, f"{dest}/backup.json", json.dumps(about).encode())
        return about

    def _about(self, source: str) -> dict:
        return json.loads(read(self.spark, f"{source}/backup.json"))

    def apply(self, source: str) -> None:
        """Apply a backup whose base is this log's head, of the same log."""
        m, about = self.manifest(), self._about(source)
        if about["log_id"] != m["log_id"] or about["base_head"] != m["head"]:
            raise FailedPrecondition("the backup does not continue this log")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{source}/events")
        if rows.count() != about["head"] - about["base_head"]:
            raise FailedPrecondition("the backup is damaged")
        keys = [tuple(r) for r in self.spark.read.schema(KEYS).parquet(f"{source}/keys").collect()]
        self._add(m, rows, about["head"] - about["base_head"], keys)

    @classmethod
    def restore(cls, spark: SparkSession, source: str, path: str) -> LogStore:
        probe = cls(spark, path)
        store = cls.create(spark, path, probe._about(source)["log_id"])
        store.apply(source)
        return store

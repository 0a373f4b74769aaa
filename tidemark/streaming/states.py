"""The states of all instances of an aggregate as a table: snapshots by position, kept up to date by replaying the rest.

A refresh reads the last snapshot that still holds (same evolve code, its last event still in the log) and folds only
the events since. Each stream's events come sorted behind its snapshot row; only one state is held at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.functions.errors import FailedPrecondition, InvalidArgument, NotFound, Unavailable
from tidemark.functions.workers import reach
from tidemark.operators.mutations import sorted_by
from tidemark.sources.atomic import names, publish, read
from tidemark.sources.store import LogStore, token
from tidemark.streaming.app import Aggregate

STATE = "stream_id string, stream_version bigint, state string"


def code_of(f) -> str:
    """Identity of a function's code: its bytecode, constants and names, nested functions included."""

    def parts(c) -> Iterator[bytes]:
        yield c.co_code
        yield repr(c.co_names).encode()
        for x in c.co_consts:
            yield from parts(x) if hasattr(x, "co_code") else [repr(x).encode()]

    return hashlib.sha256(b"\0".join(parts(f.__code__))).hexdigest()


class States:
    def __init__(self, store: LogStore, aggregate: Aggregate, path: str, kind: str = "string") -> None:
        """``kind`` is the scalar type of the aggregate's key: only streams of canonical keys are instances."""
        self.store, self.aggregate, self.kind = store, aggregate, kind
        self.path = f"{path.rstrip('/')}/{aggregate.name}"
        self.spark, self.fs, self._jpath = store.spark, store.fs, store._jpath

    # ---- snapshots

    def snapshots(self) -> list[dict]:
        """The snapshots taken, oldest first: name, next position, last event, code."""
        folder = f"{self.path}/snapshots"
        out = [json.loads(read(self.spark, f"{folder}/{n}")) for n in names(self.spark, folder)]
        return sorted(out, key=lambda s: (s["next"], s["taken"]))

    def _holds(self, s: dict) -> bool:
        if s["code"] != code_of(self.aggregate.evolve) or s["log_id"] != self.store.manifest()["log_id"] or s["next"] > self.store.head:
            return False
        own = self.store.events(s["next"] - 1, s["next"]).select("event_id").first() if s["next"] else None
        return not s["next"] or own is not None and own[0] == s["last_event_id"]

    def last(self) -> dict | None:
        return next((s for s in reversed(self.snapshots()) if self._holds(s)), None)

    def drop(self, name: str) -> None:
        if all(s["name"] != name for s in self.snapshots()):
            raise NotFound(f"no snapshot {name}")
        self.fs.delete(self._jpath(f"{self.path}/snapshots/{name}.json"), False)
        self.fs.delete(self._jpath(f"{self.path}/states/{name}"), True)

    def clear(self) -> None:
        for s in self.snapshots():
            self.drop(s["name"])

    def _table(self, s: dict | None) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/states/{s['name']}") if s else self.spark.createDataFrame([], STATE)

    # ---- folds

    def states(self, end: int | None = None, base: dict | None = None) -> DataFrame:
        """(stream_id, stream_version, state) of every instance at position ``end``, from the snapshot ``base`` on."""
        reach(self.spark)
        evolve = self.aggregate.evolve
        events = self.store.events(base["next"] if base else 0, end).where(F.col("family").isin(self.aggregate.families))
        events = events.where(values.match(self.aggregate.template, F.col("stream_id"), self.kind).isNotNull())
        old = self._table(base)
        both = events.select(F.col("stream_id").alias("_scope"), "stream_version", "family", "payload").unionByName(old.select(F.col("stream_id").alias("_scope"), "stream_version", F.lit(None).cast("string").alias("family"), F.col("state").alias("payload")))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fields = pa.schema([("stream_id", pa.string()), ("stream_version", pa.int64()), ("state", pa.string())])
            out = []
            for stream, rows in sorted_by(batches):
                version, state = None, None
                for r in rows:
                    version, known = r["stream_version"], json.loads(r["payload"])
                    state = known if r["family"] is None else evolve(state, r["family"], known)
                out.append({"stream_id": stream, "stream_version": version, "state": json.dumps(state, default=str)})
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)

        # a stream without new events passes by Python
        fresh = both.where("family is not null").select("_scope").distinct()
        still = old.join(fresh, old["stream_id"] == fresh["_scope"], "left_anti") if base else old
        moved = both.join(fresh, "_scope", "left_semi") if base else both
        folded = moved.repartition("_scope").sortWithinPartitions("_scope", "stream_version").mapInArrow(fold, STATE)
        return folded.unionByName(still)

    def refresh(self, full: bool = False) -> dict:
        """Take a snapshot at the head; ``full``: replay everything, whatever snapshots there are."""
        m = self.store.manifest()
        base = None if full else self.last()
        if base and base["next"] == m["head"]:
            return base
        name = uuid.uuid4().hex
        self.states(m["head"], base).write.parquet(f"{self.path}/states/{name}")
        end = self.store.events(m["head"] - 1, m["head"]).select("event_id").first() if m["head"] else None
        about = {"name": name, "taken": m["n"], "next": m["head"], "last_event_id": end and end[0], "code": code_of(self.aggregate.evolve), "log_id": m["log_id"]}
        publish(self.spark, f"{self.path}/snapshots/{name}.json", json.dumps(about).encode())
        return about

    def get(self, key: str, min_version: int | None = None) -> tuple[dict | None, int | None, str]:
        """State, version and a token of one instance: its snapshot row and the events since, of its stream only."""
        stream = self.aggregate.stream(key)
        if not values_match(self.aggregate.template, stream, key):
            raise InvalidArgument("the key does not render to a stream of the aggregate")
        base, m = self.last(), self.store.manifest()
        row = self._table(base).where(F.col("stream_id") == stream).first()
        version, state = (row["stream_version"], json.loads(row["state"])) if row else (None, None)
        rest = self.store.events(base["next"] if base else 0, m["head"]).where((F.col("stream_id") == stream) & F.col("family").isin(self.aggregate.families))
        for r in rest.select("stream_version", "family", "payload").orderBy("stream_version").toLocalIterator():
            version, state = r["stream_version"], self.aggregate.evolve(state, r["family"], json.loads(r["payload"]))
        if min_version is not None and (version is None or version < min_version):
            raise Unavailable("the stream has not reached that version")
        return state, version, token(m["log_id"], m["epoch"], max(m["head"] - 1, 0))

    def check(self) -> None:
        """Streams that hold families of the aggregate without being rendered from its template are an error."""
        odd = self.store.events().where(F.col("family").isin(self.aggregate.families) & values.match(self.aggregate.template, F.col("stream_id"), self.kind).isNull())
        first = odd.select("stream_id").first()
        if first is not None:
            raise FailedPrecondition(f"stream {first[0]} does not fit {self.aggregate.template}")


def values_match(template: str, stream: str, key: str) -> bool:
    start, _, rest = template.partition("{")
    return bool(key) and stream == f"{start}{key}{rest.partition('}')[2]}"

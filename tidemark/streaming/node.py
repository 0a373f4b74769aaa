"""A node: a log store with its application, projections, aggregate states and processes under one set of verbs.

The command line loads a node from ``file.py:function``, a function of (spark, path) that returns one.
"""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.errors import InvalidArgument, NotFound
from tidemark.sources.store import Event, LogStore
from tidemark.streaming.app import App, ProcessRunner
from tidemark.streaming.runner import Runner
from tidemark.streaming.states import States


@dataclass
class Node:
    store: LogStore
    app: App
    projections: dict[str, Runner] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    states: dict[str, States] = field(default_factory=dict)
    processes: dict[str, ProcessRunner] = field(default_factory=dict)

    @staticmethod
    def _named(things: dict, name: str, what: str):
        if name not in things:
            raise NotFound(f"unknown {what} {name}")
        return things[name]

    # ---- commands

    def exec(self, command: str, key: str, payload: dict, idempotency: str | None = None) -> str:
        return self.app.execute(command, key, payload, idempotency)

    def append(self, aggregate: str, key: str, events: list[Event], idempotency: str | None = None) -> str:
        return self.app.append(aggregate, key, events, idempotency)

    # ---- reads

    def get(self, projection: str, key: dict[str, object], min_token: str | None = None) -> tuple[dict | None, str]:
        """One row; ``key`` names every key field and nothing else."""
        run = self._named(self.projections, projection, "projection")
        if set(key) != set(self.keys[projection]):
            raise InvalidArgument(f"the key of {projection} is {', '.join(self.keys[projection])}")
        return run.get(min_token, **key)

    def scan(self, projection: str, prefix: dict[str, object] | None = None, limit: int = 0, min_token: str | None = None) -> tuple[DataFrame, str]:
        return self._named(self.projections, projection, "projection").scan(self.keys[projection], prefix, limit, min_token)

    def aggregate(self, name: str, key: str, min_version: int | None = None) -> tuple[dict | None, int | None, str]:
        return self._named(self.states, name, "aggregate").get(key, min_version)

    def process(self, name: str) -> DataFrame:
        return self._named(self.processes, name, "process").instances()

    # ---- upkeep

    def catch_up(self) -> dict[str, int]:
        """Every projection up to the head; the next position of each."""
        return {n: r.catch_up() for n, r in self.projections.items()}

    def rebuild(self, name: str, snapshot: str | None = None) -> int:
        """A projection, from a snapshot if one is named, or the states of an aggregate."""
        if name in self.states:
            return self.states[name].refresh(full=True)["next"]
        return self._named(self.projections, name, "projection").rebuild(snapshot)

    def snapshot(self, name: str) -> dict:
        return self.states[name].refresh() if name in self.states else self._named(self.projections, name, "projection").snapshot()

    def snapshots(self, name: str) -> list[dict]:
        return (self.states[name] if name in self.states else self._named(self.projections, name, "projection")).snapshots()

    def drop_snapshot(self, name: str, snapshot: str) -> None:
        if name in self.states:
            self.states[name].drop(snapshot)
        else:
            self._named(self.projections, name, "projection").drop_snapshot(snapshot)

    def health(self) -> list[dict]:
        """The log, then every projection and aggregate."""
        log = self.store.health().first().asDict()
        rows = [{"layer": "log", "name": log["log_id"], **log}]
        rows += [{"layer": "projection", **r.health()} for r in self.projections.values()]
        for n, s in self.states.items():
            last = s.last()
            rows.append({"layer": "aggregate", "name": n, "next": last["next"] if last else 0, "snapshots": len(s.snapshots())})
        return rows


def load(spark: SparkSession, where: str, path: str) -> Node:
    """The node of ``file.py:function``."""
    file, _, name = where.rpartition(":")
    if not file:
        raise InvalidArgument("a node is named as file.py:function")
    spec = importlib.util.spec_from_file_location(Path(file).stem, file)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    make: Callable[[SparkSession, str], Node] = getattr(module, name)
    # the workers cannot import that file, so its functions travel by value
    sys.modules.setdefault(module.__name__, module)
    cloudpickle.register_pickle_by_value(module)
    return make(spark, path)

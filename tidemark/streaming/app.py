"""The write side: commands on aggregates, invariants, and process managers with timers.

A command loads its aggregate's state, its handler returns events or rejects, the candidate state and the invariants
are checked, and the events are appended at the version that was loaded. If another writer came first, the command is
tried once more. An idempotency key makes a repeated command succeed without a second append.

A process manager is a state machine per correlation key. Its reactions run in Spark, one key's triggers in order,
many keys in parallel; states, outbox and timers of a round become visible together with the checkpoint. An outbox
stays pending until all of it is sent, whatever happens in between. Commands carry keys made of the trigger's position,
so nothing is sent twice. A rejected command is a trigger of its instance in the next round, not an event of the log.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.errors import AlreadyExists, FailedPrecondition, Failure, InvalidArgument, NotFound, Unavailable
from tidemark.functions.workers import reach
from tidemark.sources.atomic import newest, publish
from tidemark.sources.store import Event, LogStore, token
from tidemark.streaming.cluster import backoff
from tidemark.streaming.runner import Runner

TIMER_FIRED = "System.TimerFired"
#: Aggregate states that an application keeps.
CACHED = 10_000
#: Tries of a command that other writers come before: one more at its version, more if only the log has moved.
ATTEMPTS = 8


class Rejected(FailedPrecondition):
    """A business rejection: a code, and the invariant that spoke if one did."""

    def __init__(self, code: str, message: str = "", invariant: str | None = None) -> None:
        super().__init__(message or code, code, invariant)


@dataclass
class Aggregate:
    name: str
    template: str  # prefix{key}suffix
    families: list[str]
    evolve: Callable[[dict | None, str, dict], dict]
    invariants: list[tuple[str, str, Callable[[dict], bool]]] = field(default_factory=list)

    def stream(self, key: str) -> str:
        start, _, rest = self.template.partition("{")
        return f"{start}{key}{rest.partition('}')[2]}"


@dataclass
class ContextInvariant:
    """A check over a read-model row: ``scope`` names the row an event touches, ``holds`` sees it with the new events."""

    name: str
    code: str
    runner: Runner
    families: list[str]
    scope: Callable[[dict], dict]
    holds: Callable[[dict | None, list[Event]], bool]


class App:
    def __init__(self, store: LogStore) -> None:
        self.store = store
        self.aggregates: dict[str, Aggregate] = {}
        self.commands: dict[str, tuple[str, Callable]] = {}
        self.context: list[ContextInvariant] = []
        self.cache: OrderedDict[str, tuple[int, int | None, dict | None]] = OrderedDict()

    def aggregate(self, a: Aggregate) -> None:
        self.aggregates[a.name] = a

    def command(self, name: str, aggregate: str):
        def add(handler: Callable[[dict | None, dict], list[Event]]):
            self.commands[name] = (aggregate, handler)
            return handler

        return add

    def load(self, a: Aggregate, stream: str) -> tuple[int | None, dict | None]:
        """Version and state: what is kept, plus the events since."""
        generation = self.store.manifest()["generation"]
        kept = self.cache.get(stream)
        version, state = (kept[1], kept[2]) if kept and kept[0] == generation else (None, None)
        rows = self.store.events().where((F.col("stream_id") == stream) & (F.col("stream_version") > (-1 if version is None else version)))
        for r in rows.select("stream_version", "family", "payload").orderBy("stream_version").toLocalIterator():
            version, state = r["stream_version"], a.evolve(state, r["family"], json.loads(r["payload"]))
        self.cache[stream] = (generation, version, state)
        self.cache.move_to_end(stream)
        while len(self.cache) > CACHED:
            self.cache.popitem(last=False)
        return version, state

    def execute(self, command: str, key: str, payload: dict, idempotency: str | None = None) -> str:
        """Run a command; a token of the last event (or of the head if it made none)."""
        if command not in self.commands:
            raise NotFound(f"unknown command {command}")
        name, handler = self.commands[command]
        return self._guarded(self.aggregates[name], key, lambda state: handler(state, payload), idempotency)

    def append(self, aggregate: str, key: str, events: list[Event], idempotency: str | None = None) -> str:
        """Events of the caller, under the same invariants as a command's."""
        if aggregate not in self.aggregates:
            raise NotFound(f"unknown aggregate {aggregate}")
        if not events:
            raise InvalidArgument("empty batch")
        return self._guarded(self.aggregates[aggregate], key, lambda _: events, idempotency)

    def _token(self, position: int) -> str:
        m = self.store.manifest()
        return token(m["log_id"], m["epoch"], position)

    def _guarded(self, a: Aggregate, key: str, decide: Callable, idempotency: str | None) -> str:
        stream = a.stream(key)
        for attempt in range(1, ATTEMPTS + 1):
            if idempotency is not None and (at := self.store.lookup_key(idempotency)) is not None:
                return self._token(at)
            seen = self.store.manifest()
            version, state = self.load(a, stream)
            try:
                events = decide(state)
            except Failure:
                raise
            except Exception as e:
                raise Failure(f"the handler failed: {e}") from e
            if not events:
                return self._token(max(self.store.head - 1, 0))
            for e in events:
                if e.family not in a.families:
                    raise Failure(f"{e.family} does not belong to {a.name}")
                state = a.evolve(state, e.family, e.payload)
            for name, code, holds in a.invariants:
                if not holds(state):
                    raise Rejected(code, invariant=name)
            # what was checked over several streams must hold when the events are written: no commit may come between
            pinned = seen if self._context_invariants(events) else None
            try:
                return self._token(self.store.append(stream, "no_stream" if version is None else version, events, idempotency, at=pinned))
            except AlreadyExists as e:
                return self._token(e.position)
            except FailedPrecondition as e:
                lost = e.code == "CONFLICT"
                if attempt >= (ATTEMPTS if lost else 2) or not lost and e.actual is None and version is None:
                    raise
        raise AssertionError

    def _context_invariants(self, events: list[Event]) -> bool:
        """Whether any invariant looked at the events; raises if one does not hold."""
        looked = False
        for c in self.context:
            scopes: dict[str, list[Event]] = {}
            for e in events:
                if e.family in c.families:
                    scopes.setdefault(json.dumps(c.scope(e.payload), sort_keys=True), []).append(e)
            for scope, own in sorted(scopes.items()):
                looked = True
                c.runner.catch_up()  # the read model is as new as the log
                row, _ = c.runner.get(**json.loads(scope))
                if not c.holds(row, own):
                    raise Rejected(c.code, invariant=c.name)
        return looked


@dataclass
class Reaction:
    state: dict | None
    commands: list[tuple[str, str, dict]] = field(default_factory=list)  # command, key, payload
    timers: list[tuple[str, int]] = field(default_factory=list)  # name, milliseconds after the trigger
    at: list[tuple[str, int]] = field(default_factory=list)  # timers by absolute time: name, milliseconds since 1970
    cancel: list[str] = field(default_factory=list)  # dropped before the new ones are set


@dataclass
class Process:
    """``sources``: family -> the payload field that correlates; ``react(state, trigger)`` gives a Reaction.

    A trigger is {kind: event, rejected or timer, family, position, payload}. The payload of a rejected one holds the
    command, its key, the code and the invariant. A state of None ends the instance and drops its timers.
    """

    name: str
    sources: dict[str, str]
    react: Callable[[dict | None, dict], Reaction]
    timers: tuple[str, ...] = ()


_STATE = "pkey string, state string, timers string"
_OUT = "kind string, pkey string, id string, body string, timers string"
_TRIGGER = "pkey string, position bigint, id string, kind string, family string, payload string, at bigint"
#: Commands between two notes of how far the outbox is sent, tries of a command that fails without being rejected.
NOTE, TRIES = 64, 4


class ProcessRunner:
    """Runs a process in rounds. A checkpoint names the instances, the outboxes not yet sent and how far the first of
    them is, and the rejections that no round has seen; commands carry ids made from their trigger, under which the
    log knows them, so whatever stops a run, the next one goes on and sends each command once."""

    def __init__(self, app: App, process: Process, path: str, sleep: Callable[[float], None] = time.sleep) -> None:
        self.app, self.store, self.process, self.sleep = app, app.store, process, sleep
        self.path = f"{path.rstrip('/')}/{process.name}"
        self.spark, self.fs, self._jpath = self.store.spark, self.store.fs, self.store._jpath

    def checkpoint(self) -> dict:
        return newest(self.spark, f"{self.path}/checkpoints") or {"n": -1, "next": 0, "dir": None, "last_event_id": None, "log_id": self.store.manifest()["log_id"], "pending": [], "sent": None, "rejections": []}

    def _commit(self, c: dict) -> dict:
        c = {**c, "n": c["n"] + 1}
        try:
            publish(self.spark, f"{self.path}/checkpoints/{c['n']:012d}.json", json.dumps(c).encode())
        except FileExistsError as e:
            raise FailedPrecondition("another runner committed first", code="CONFLICT") from e
        return c

    def resume(self) -> dict:
        """The checkpoint to go on from; anew if a cut or another log took away what it has seen."""
        c = self.checkpoint()
        stale = c["log_id"] != self.store.manifest()["log_id"] or c["next"] > self.store.head
        if not stale and c["next"] and c["last_event_id"]:
            own = self.store.events(c["next"] - 1, c["next"]).select("event_id").first()
            stale = own is None or own[0] != c["last_event_id"]
        if stale:
            # commands sent before the cut are known to the log by their ids; those after it are sent again
            c = self._commit({**c, "next": 0, "dir": None, "last_event_id": None, "log_id": self.store.manifest()["log_id"], "pending": [], "sent": None, "rejections": []})
        return c

    def instances(self):
        c = self.checkpoint()
        return self.spark.read.parquet(f"{self.path}/{c['dir']}/states") if c["dir"] else self.spark.createDataFrame([], _STATE)

    def triggers(self, start: int, end: int):
        """The log's events and fired timers of this process."""
        e = self.store.events(start, end).where(F.col("family").isin(*self.process.sources, TIMER_FIRED))
        key = F.lit(None).cast("string")
        for family, name in self.process.sources.items():
            key = F.when(F.col("family") == family, F.get_json_object("payload", f"$.{name}")).otherwise(key)
        fired = F.col("family") == TIMER_FIRED
        key = F.when(fired & (F.get_json_object("payload", "$.process") == self.process.name), F.get_json_object("payload", "$.key")).otherwise(key)
        kind = F.when(fired, "timer").otherwise("event")
        name = F.lpad(F.col("position").cast("string"), 20, "0")
        return e.select(key.alias("pkey"), "position", name.alias("id"), kind.alias("kind"), "family", "payload", (F.col("recorded_at_nanos") / 1_000_000).cast("long").alias("at")).where("pkey is not null")

    def run(self) -> int:
        """Send what an earlier run left, react to everything up to the head, send the commands of that; returns how many were sent."""
        self.resume()
        sent = self.dispatch()
        c, head = self.checkpoint(), self.store.head
        if head > c["next"] or c["rejections"]:
            self._round(c, head)
        return sent + self.dispatch()

    def _round(self, c: dict, head: int) -> None:
        process = self.process

        def react(key, states: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            state = json.loads(states["state"].iloc[0]) if len(states) else None
            timers = json.loads(states["timers"].iloc[0]) if len(states) else {}
            out = []
            for r in rows.sort_values(["position", "id"]).itertuples():
                payload = json.loads(r.payload)
                if r.kind == "timer":
                    if timers.get(payload["name"]) != payload["due"]:
                        continue  # cancelled, set anew or of an ended instance
                    del timers[payload["name"]]
                if r.kind == "rejected" and state is None:
                    continue  # the instance has ended
                done = process.react(state, {"kind": r.kind, "family": r.family, "position": r.position, "payload": payload})
                state = done.state
                for name in done.cancel:
                    timers.pop(name, None)
                for name, due in [*((n, int(r.at) + after) for n, after in done.timers), *done.at]:
                    if name not in process.timers:
                        raise ValueError(f"timer {name} is not declared")
                    timers[name] = due
                for i, (command, target, body) in enumerate(done.commands):
                    out.append(("command", key[0], f"{r.id}-{i:04d}", json.dumps([command, target, body]), None))
                if state is None:
                    timers = {}
            if state is not None:
                out.append(("state", key[0], None, json.dumps(state), json.dumps(timers)))
            return pd.DataFrame(out, columns=["kind", "pkey", "id", "body", "timers"])

        reach(self.spark)
        name = f"rounds/{uuid.uuid4().hex}"
        triggers = self.triggers(c["next"], head)
        if c["rejections"]:
            # what a command met comes before the events that followed
            triggers = triggers.unionByName(self.spark.read.schema(_TRIGGER).parquet(*[f"{self.path}/{d}" for d in c["rejections"]]))
        new = self.instances().groupBy("pkey").cogroup(triggers.groupBy("pkey")).applyInPandas(react, _OUT)
        new.write.parquet(f"{self.path}/{name}/all")
        made = self.spark.read.schema(_OUT).parquet(f"{self.path}/{name}/all")
        made.where("kind = 'state'").select("pkey", F.col("body").alias("state"), "timers").write.parquet(f"{self.path}/{name}/states")
        made.where("kind = 'command'").select("pkey", "id", "body").write.parquet(f"{self.path}/{name}/outbox")
        last = self.store.events(head - 1, head).select("event_id").first() if head else None
        self._commit({**c, "next": head, "dir": name, "last_event_id": last and last[0], "pending": [*c["pending"], name], "rejections": []})

    def dispatch(self) -> int:
        """Send the commands of all pending outboxes in the order of their ids; rejections wait for the next round."""
        c, count = self.checkpoint(), 0
        while c["pending"]:
            rejected: list[tuple] = []
            box = self.spark.read.schema("pkey string, id string, body string").parquet(f"{self.path}/{c['pending'][0]}/outbox")
            if c["sent"] is not None:
                box = box.where(F.col("id") > c["sent"])
            last = c["sent"]
            for i, r in enumerate(box.orderBy("id").toLocalIterator(), 1):
                command, target, body = json.loads(r["body"])
                key = f"pm:{self.process.name}:{r['id']}"
                if self.store.lookup_key(key) is None:
                    try:
                        self._send(command, target, body, key)
                        count += 1
                    except Rejected as e:
                        about = {"command": command, "key": target, "code": e.code, "invariant": e.invariant}
                        rejected.append((r["pkey"], int(r["id"][:20]), f"{r['id']}-r", "rejected", None, json.dumps(about), int(time.time() * 1000)))
                    except Exception:
                        self._note(c, last, rejected)
                        raise
                last = r["id"]
                if i % NOTE == 0:
                    c, rejected = self._note(c, last, rejected), []
            c = self._note({**c, "pending": c["pending"][1:]}, None, rejected)
        return count

    def _send(self, command: str, target: str, body: dict, key: str) -> None:
        """Execute a command; one that fails without being rejected is tried again after a while, and stays pending."""
        for attempt in range(1, TRIES + 1):
            try:
                self.app.execute(command, target, body, key)
                return
            except Rejected:
                raise
            except (FailedPrecondition, Unavailable):
                if attempt == TRIES:
                    raise
                self.sleep(backoff(attempt))

    def _note(self, c: dict, sent: str | None, rejected: list[tuple]) -> dict:
        """Record how far the outbox is sent, and what was rejected on the way."""
        dirs = c["rejections"]
        if rejected:
            name = f"rejections/{uuid.uuid4().hex}"
            self.spark.createDataFrame(rejected, _TRIGGER).coalesce(1).write.parquet(f"{self.path}/{name}")
            dirs = [*dirs, name]
        return self._commit({**c, "sent": sent, "rejections": dirs})

    def fire(self, now_ms: int) -> int:
        """Append a fired event for every timer due; one that was fired before is skipped by its key."""
        due = F.from_json("timers", "map<string,bigint>")
        rows = self.instances().select("pkey", F.explode(due).alias("name", "due")).where(F.col("due") <= now_ms).orderBy("due", "pkey", "name")
        n = 0
        for r in rows.toLocalIterator():
            body = {"process": self.process.name, "key": r["pkey"], "name": r["name"], "due": r["due"]}
            try:
                self.store.append(f"timer-{self.process.name}-{r['pkey']}", "any", [Event(TIMER_FIRED, body)], f"timer:{self.process.name}:{r['pkey']}:{r['name']}:{r['due']}", system=True)
                n += 1
            except AlreadyExists:
                pass
        return n

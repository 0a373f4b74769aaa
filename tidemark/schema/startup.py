"""What happens when a node starts with a schema: it is compared with the stored text, and changes take effect.

A breaking change of the domain is refused unless forced. A change of the derivation runs the actions it asks for:
rebuild a projection, drop its tables, clear snapshots. The text is stored once all of that has worked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from tidemark.functions.errors import FailedPrecondition
from tidemark.schema.diff import BREAKING, Change, diff_derivation, diff_domain
from tidemark.schema.parser import parse
from tidemark.sources.atomic import publish
from tidemark.sources.store import LogStore


def log_facts(store: LogStore) -> Callable[[str], bool]:
    """Whether the log holds a family or ``family@vN``: one aggregate, as many rows as the schema has versions."""
    seen = store.events().select("family", "type_version").distinct().collect()
    held = {r["family"] for r in seen} | {f"{r['family']}@v{r['type_version']}" for r in seen}
    return held.__contains__


class Texts:
    """Schema texts kept beside a log or its read models, one file per change."""

    def __init__(self, store: LogStore, path: str) -> None:
        self.spark, self.path, self.fs, self._jpath = store.spark, path.rstrip("/"), store.fs, store._jpath

    def _files(self) -> list:
        folder = self._jpath(self.path)
        return sorted((f.getPath() for f in self.fs.listStatus(folder) if not f.getPath().getName().startswith(".")), key=lambda p: p.getName()) if self.fs.exists(folder) else []

    def last(self) -> str | None:
        files = [p for p in self._files() if p.getName().endswith(".schema")]
        if not files:
            return None
        stream = self.fs.open(files[-1])
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, text: str) -> str:
        """Store a text; returns its SHA-256."""
        digest = hashlib.sha256(text.encode()).hexdigest()
        if text != self.last():
            publish(self.spark, f"{self.path}/{len(self._files()):06d}.schema", text.encode())
        return digest


@dataclass
class Start:
    changes: list[Change]
    digest: str
    done: list[str] = field(default_factory=list)


def start_domain(store: LogStore, text: str, force: bool = False, assume_data: bool = False) -> Start:
    """``assume_data``: take every family as held instead of asking the log."""
    texts = Texts(store, f"{store.path}/schema")
    old, new = texts.last(), parse(text)
    changes = [] if old is None else diff_domain(parse(old), new, (lambda _: True) if assume_data else log_facts(store))
    broken = [c for c in changes if c.effect == BREAKING]
    if broken and not force:
        raise FailedPrecondition("breaking changes: " + ", ".join(f"{c.path} {c.kind}" for c in broken))
    return Start(changes, texts.put(text))


def start_derivation(store: LogStore, text: str, path: str, rebuild: Callable[[str], None], drop: Callable[[str], None], clear: Callable[[str], None]) -> Start:
    """Runs the actions of the changes, each once per projection or state, then stores the text below ``path``."""
    texts = Texts(store, f"{path.rstrip('/')}/schema")
    old, new = texts.last(), parse(text)
    start = Start([] if old is None else diff_derivation(parse(old), new), "")
    known = {*new.projections, *new.states, *(parse(old).projections if old else {}), *(parse(old).states if old else {})}
    for c in start.changes:
        owner = next(n for n in sorted(known, key=len, reverse=True) if c.path == n or c.path.startswith(f"{n}."))
        # a table that is gone is dropped by rebuilding its projection without it
        action = "rebuild" if c.kind == "table_removed" else c.action
        if action and f"{action} {owner}" not in start.done:
            {"rebuild": rebuild, "drop": drop, "clear_snapshots": clear}[action](owner)
            start.done.append(f"{action} {owner}")
    start.digest = texts.put(text)
    return start


def check_registrations(domain_text: str, commands: dict[str, str], reactions: dict[str, list[str]]) -> list[str]:
    """Errors of an application against a domain: commands on unknown aggregates, reactions to unknown families."""
    domain = parse(domain_text)
    aggregates = {a for c in domain.contexts.values() for a in c.aggregates} | {f"{c.name}.{a}" for c in domain.contexts.values() for a in c.aggregates}
    families = {f"{c.name}.{e}" for c in domain.contexts.values() for e in c.events}
    wrong = [f"command {n}: no aggregate {a}" for n, a in sorted(commands.items()) if a not in aggregates]
    return wrong + [f"process {p}: no event {f}" for p, fs in sorted(reactions.items()) for f in fs if f not in families]

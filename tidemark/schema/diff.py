"""What a schema change means: compatible, rebuild (of read models or snapshots) or breaking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidemark.schema.model import Field, Schema

COMPATIBLE, REBUILD, BREAKING = "compatible", "rebuild", "breaking"


@dataclass(frozen=True, order=True)
class Change:
    path: str
    kind: str
    effect: str
    action: str | None = None


def _fields(path: str, old: list[Field], new: list[Field], out: list[Change]) -> None:
    """Fields of stored records: a removed one must have been optional, a new one must fill itself."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    for name, f in a.items():
        at = f"{path}.{name}"
        if name not in b:
            out.append(Change(at, "field_removed", COMPATIBLE if f.type.optional else BREAKING))
        elif f.type != b[name].type:
            widened = not f.type.optional and b[name].type.optional and f.type == b[name].type.required()
            out.append(Change(at, "type_changed", COMPATIBLE if widened else BREAKING))
        elif f.default != b[name].default:
            out.append(Change(at, "default_changed", COMPATIBLE if f.default is None or b[name].default is not None else BREAKING))
    out += [Change(f"{path}.{n}", "field_added", COMPATIBLE if f.fills_itself else BREAKING) for n, f in b.items() if n not in a]


def diff_domain(old: Schema, new: Schema, has_events: Callable[[str], bool] = lambda family: True) -> list[Change]:
    """Changes sorted by path and kind; ``has_events`` tells whether the log holds a family (or ``family@vN``)."""
    out: list[Change] = []
    for name, c in old.contexts.items():
        d = new.contexts.get(name)
        if d is None:
            held = any(has_events(f"{name}.{e}") for e in c.events)
            out.append(Change(name, "context_removed", BREAKING if held else COMPATIBLE))
            continue
        _types(name, c, d, out)
        for event, versions in c.events.items():
            family = f"{name}.{event}"
            if event not in d.events:
                out.append(Change(family, "event_removed", BREAKING if has_events(family) else COMPATIBLE))
                continue
            for n, e in versions.items():
                at, other = f"{family}@v{n}", d.events[event].get(n)
                if other is None:
                    out.append(Change(at, "version_removed", BREAKING if has_events(at) else COMPATIBLE))
                    continue
                _fields(at, e.fields, other.fields, out)
                if e.upcast != other.upcast:
                    out.append(Change(at, "upcast_changed", BREAKING if has_events(f"{family}@v{n - 1}") else COMPATIBLE))
            out += [Change(f"{family}@v{n}", "version_added", COMPATIBLE) for n in d.events[event] if n not in versions]
        out += [Change(f"{name}.{e}", "event_added", COMPATIBLE) for e in d.events if e not in c.events]
        for a in c.aggregates.values():
            at, b = f"{name}.{a.name}", d.aggregates.get(a.name)
            if b is None:
                out.append(Change(at, "aggregate_removed", BREAKING if any(has_events(f"{name}.{e}") for e in a.events) else COMPATIBLE))
                continue
            if (a.key.name, a.key.type) != (b.key.name, b.key.type):
                out.append(Change(at, "key_changed", BREAKING))
            if a.stream != b.stream:
                out.append(Change(at, "stream_changed", BREAKING))
            _types(at, a, b, out)
            for e in a.entities.values():
                if e.name in b.entities:
                    if e.id != b.entities[e.name].id:
                        out.append(Change(f"{at}.{e.name}", "entity_id_changed", BREAKING))
                    _fields(f"{at}.{e.name}", e.fields, b.entities[e.name].fields, out)
                else:
                    out.append(Change(f"{at}.{e.name}", "type_removed", BREAKING))
        out += [Change(f"{name}.{a}", "aggregate_added", COMPATIBLE) for a in d.aggregates if a not in c.aggregates]
    out += [Change(n, "context_added", COMPATIBLE) for n in new.contexts if n not in old.contexts]
    return sorted(out)


def _types(path: str, c, d, out: list[Change]) -> None:
    for v in c.values.values():
        at = f"{path}.{v.name}"
        if v.name not in d.values:
            out.append(Change(at, "type_removed", BREAKING))
            continue
        _fields(at, v.fields, d.values[v.name].fields, out)
        if v.rules != d.values[v.name].rules:
            out.append(Change(at, "rules_changed", COMPATIBLE))  # they hold for new writes
    for e in c.enums.values():
        at = f"{path}.{e.name}"
        if e.name not in d.enums:
            out.append(Change(at, "type_removed", BREAKING))
            continue
        for variant, fields in e.variants.items():
            if variant not in d.enums[e.name].variants:
                out.append(Change(f"{at}.{variant}", "variant_removed", BREAKING))
            else:
                _fields(f"{at}.{variant}", fields, d.enums[e.name].variants[variant], out)
        out += [Change(f"{at}.{v}", "variant_added", COMPATIBLE) for v in d.enums[e.name].variants if v not in e.variants]
    out += [Change(f"{path}.{n}", "type_added", COMPATIBLE) for n in [*d.values, *d.enums] if n not in c.values and n not in c.enums]


def diff_derivation(old: Schema, new: Schema) -> list[Change]:
    out: list[Change] = []
    for name, s in old.states.items():
        t = new.states.get(name)
        if t is None:
            out.append(Change(name, "state_removed", REBUILD, "clear_snapshots"))
        elif [(f.name, f.type) for f in s.fields] != [(f.name, f.type) for f in t.fields]:
            out.append(Change(name, "state_changed", REBUILD, "clear_snapshots"))
        elif s.evolve != t.evolve:
            out.append(Change(name, "code_changed", COMPATIBLE))
    out += [Change(n, "state_added", COMPATIBLE) for n in new.states if n not in old.states]
    for name, p in old.projections.items():
        q = new.projections.get(name)
        if q is None:
            out.append(Change(name, "projection_removed", REBUILD, "drop"))
            continue
        if set(p.sources) != set(q.sources):
            out.append(Change(name, "sources_changed", REBUILD, "rebuild"))
        if p.code != q.code:
            out.append(Change(name, "code_changed", COMPATIBLE))
        for table, t in p.tables.items():
            at, u = f"{name}.{table}", q.tables.get(table)
            if u is None:
                out.append(Change(at, "table_removed", REBUILD, "drop"))
                continue
            if [(k.name, k.type) for k in t.keys] != [(k.name, k.type) for k in u.keys]:
                out.append(Change(at, "key_changed", REBUILD, "rebuild"))
            a, b = {f.name: f for f in t.columns}, {f.name: f for f in u.columns}
            for c, f in a.items():
                if c not in b:
                    out.append(Change(f"{at}.{c}", "column_removed", REBUILD, "rebuild"))
                elif f.type != b[c].type:
                    out.append(Change(f"{at}.{c}", "column_retyped", REBUILD, "rebuild"))
            out += [Change(f"{at}.{c}", "column_added", COMPATIBLE, None) if f.fills_itself else Change(f"{at}.{c}", "column_added", REBUILD, "rebuild") for c, f in b.items() if c not in a]
        out += [Change(f"{name}.{t}", "table_added", REBUILD, "rebuild") for t in q.tables if t not in p.tables]
    out += [Change(n, "projection_added", COMPATIBLE) for n in new.projections if n not in old.projections]
    return sorted(out, key=lambda c: (c.path, c.kind))

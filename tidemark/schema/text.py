"""Canonical text of a schema; parsing it gives the same schema."""

from __future__ import annotations

import json
from decimal import Decimal

from tidemark.schema.model import SCALARS, Field, Schema


def _literal(x: object, field: Field | None = None) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, Decimal)):
        return str(x)
    if x is None:
        return "null"
    # the default of an enum field is a variant's name
    return json.dumps(x, ensure_ascii=False) if field is None or field.type.name in SCALARS else str(x)


def _field(f: Field) -> str:
    return f"{'key ' if f.key else ''}{f.name}: {f.type}{'' if f.default is None else ' = ' + _literal(f.default, f)}"


def _block(fields: list[Field], pad: str) -> str:
    return "{\n" + "".join(f"{pad}  {_field(f)},\n" for f in fields) + pad + "}" if fields else "{}"


def format_schema(s: Schema) -> str:
    out = [f"layer {s.layer}"]
    out += [f"import {json.dumps(i)}" for i in s.imports]

    def values(items: dict, pad: str) -> None:
        for v in items.values():
            rules = "" if not v.rules else " rules {\n" + "".join(f"{pad}  {n}: {r},\n" for n, r in v.rules.items()) + pad + "}"
            out.append(f"{pad}value {v.name} {_block(v.fields, pad)}{rules}")

    def enums(items: dict, pad: str) -> None:
        for e in items.values():
            out.append(f"{pad}enum {e.name} {{ " + ", ".join(n + (f" {{ {', '.join(map(_field, fs))} }}" if fs else "") for n, fs in e.variants.items()) + " }")

    for c in s.contexts.values():
        out.append(f"\ncontext {c.name} {{")
        values(c.values, "  ")
        enums(c.enums, "  ")
        for name, versions in c.events.items():
            for e in versions.values():
                up = ""
                if e.upcast is not None and e.upcast.code is not None:
                    path, _, export = e.upcast.code.partition("#")
                    up = f" upcast from v{e.upcast.source} wasm {json.dumps(path)}" + (f" export {json.dumps(export)}" if export else "")
                elif e.upcast is not None:
                    ops = [f"set {k}: {_literal(v)}" for k, v in e.upcast.sets.items()] + [f"rename {a} as {b}" for a, b in e.upcast.renames.items()]
                    up = f" upcast from v{e.upcast.source} {{ {', '.join(ops)} }}"
                out.append(f"  event {name} v{e.version} {_block(e.fields, '  ')}{up}")
        for a in c.aggregates.values():
            out.append(f"  aggregate {a.name} {{\n    key {_field(a.key).removeprefix('key ')}\n    stream {json.dumps(a.stream)}")
            values(a.values, "    ")
            enums(a.enums, "    ")
            for e in a.entities.values():
                out.append(f"    entity {e.name} {{\n" + "".join(f"      {'id ' * (i == 0)}{_field(f)},\n" for i, f in enumerate(e.fields)) + "    }")
            out.append(f"    events {', '.join(a.events)}\n  }}")
        out.append("}")
    for st in s.states.values():
        out.append(f"\nstate {st.aggregate} {_block(st.fields, '')}" + _code("evolve", st.evolve) + f" snapshot every {st.snapshot_every}")
    for p in s.projections.values():
        out.append(f"\nprojection {p.name} {{\n  from {', '.join(p.sources)}" + _code("fold", p.code) + (f" snapshot every {p.snapshot_every}" if p.snapshot_every else ""))
        out += [f"  table {t.name} {_block(t.fields, '  ')}" for t in p.tables.values()]
        out.append("}")
    return "\n".join(out) + "\n"


def _code(word: str, code: str | None) -> str:
    if code is None:
        return ""
    path, _, export = code.partition("#")
    return f" {word} wasm {json.dumps(path)}" + (f" export {json.dumps(export)}" if export else "")

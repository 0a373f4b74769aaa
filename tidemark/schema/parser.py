"""Lexer, recursive-descent parser and checks of the schema language."""

from __future__ import annotations

import re
from decimal import Decimal

from tidemark.functions import rules as rule_language
from tidemark.schema.model import COLLECTIONS, SCALARS, Aggregate, Context, Entity, Enum, EventVersion, Field, Projection, Schema, State, Table, Type, Upcast, Value

_LEX = re.compile(r'(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<num>-?\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|==|!=|[{}\[\]()<>:,.=?])')


class SchemaError(ValueError):
    def __init__(self, message: str, line: int = 0) -> None:
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


def lex(text: str) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SchemaError(f"unexpected character {text[at]!r}", line)
        if m.lastgroup not in ("space", "comment"):
            out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = lex(text), 0

    # ---- tokens

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) else None

    @property
    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][2] if self.tokens else 0

    def take(self, *want: str) -> str:
        if self.at >= len(self.tokens) or want and self.peek() not in want:
            raise SchemaError(f"expected {' or '.join(want) or 'more'}, found {self.peek()!r}", self.line)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def kind(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise SchemaError(f"expected a {kind}, found {self.peek()!r}", self.line)
        return self.take()

    def has(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def word(self) -> str:
        return self.kind("word")

    def string(self) -> str:
        return re.sub(r"\\(.)", r"\1", self.kind("str")[1:-1])

    def version(self) -> int:
        word = self.word()
        if not re.fullmatch(r"v[1-9]\d*", word):
            raise SchemaError(f"expected a version, found {word}", self.line)
        return int(word[1:])

    def dotted(self) -> str:
        name = self.word()
        while self.has("."):
            name += "." + self.word()
        return name

    def separated(self, close: str, item) -> list:
        out = []
        while not self.has(close):
            out.append(item())
            if not self.has(",") and self.peek() != close:
                raise SchemaError(f"expected , or {close}", self.line)
        return out

    # ---- declarations

    def schema(self) -> Schema:
        out = Schema()
        self.take("layer")
        out.layer = self.take("domain", "derivation")
        while self.has("import"):
            out.imports.append(self.string())
        while self.peek() is not None:
            what = self.take("context", "state", "projection")
            line = self.line
            if what == "context":
                c = self.context()
                if c.name in out.contexts:
                    raise SchemaError(f"{c.name} is declared twice", line)
                out.contexts[c.name] = c
            elif what == "state":
                s = self.state()
                out.states[s.aggregate] = s
            else:
                p = self.projection()
                if p.name in out.projections:
                    raise SchemaError(f"{p.name} is declared twice", line)
                out.projections[p.name] = p
        return out

    def context(self) -> Context:
        c = Context(self.word())
        self.take("{")
        while not self.has("}"):
            what = self.take("value", "enum", "event", "aggregate")
            line = self.line
            if what == "event":
                name = self.word()
                e = self.event()
                if e.version in c.events.setdefault(name, {}):
                    raise SchemaError(f"{name} v{e.version} is declared twice", line)
                c.events[name][e.version] = e
                continue
            item = {"value": self.value, "enum": self.enum, "aggregate": self.aggregate}[what]()
            if item.name in c.values or item.name in c.enums or item.name in c.aggregates:
                raise SchemaError(f"{item.name} is declared twice", line)
            {"value": c.values, "enum": c.enums, "aggregate": c.aggregates}[what][item.name] = item
        return c

    def type(self) -> Type:
        if self.has("["):
            inner = self.type()
            self.take("]")
            t = Type("list", (inner,))
        else:
            name = self.dotted()
            args: tuple[Type, ...] = ()
            if name in COLLECTIONS:
                self.take("<")
                args = (self.type(),)
                if name == "map":
                    self.take(",")
                    args += (self.type(),)
                self.take(">")
            t = Type(name, args)
        if self.has("?"):
            if t.name in COLLECTIONS:
                raise SchemaError("a collection is never optional", self.line)
            t = Type(t.name, t.args, True)
        return t

    def literal(self) -> object:
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
        if kind == "str":
            return self.string()
        if kind == "num":
            text = self.take()
            return Decimal(text) if "." in text else int(text)
        word = self.word()
        return {"true": True, "false": False, "null": None}.get(word, word)

    def field(self, key: bool = False) -> Field:
        line = self.line
        name = self.word()
        self.take(":")
        f = Field(name, self.type(), key=key, line=line)
        if self.has("="):
            f.default = self.literal()
            if f.type.optional or f.type.name in COLLECTIONS:
                raise SchemaError(f"{name} can't have a default", line)
        return f

    def fields(self, item=None) -> list[Field]:
        self.take("{")
        out = self.separated("}", item or self.field)
        names = [f.name for f in out]
        for f in out:
            if names.count(f.name) > 1:
                raise SchemaError(f"field {f.name} is declared twice", f.line)
        return out

    def value(self) -> Value:
        v = Value(self.word(), self.fields())
        if self.has("rules"):
            self.take("{")

            def rule() -> tuple[str, str]:
                name = self.word()
                self.take(":")
                parts, depth, last = [], 0, None
                while depth or self.peek() not in (",", "}"):
                    depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(self.peek() or "", 0)
                    word = self.take()
                    glue = "" if not parts or word == "." or last == "." else " "
                    parts.append(glue + word)
                    last = word
                text = re.sub(r"\blen \( (\S+) \)", r"len(\1)", "".join(parts))
                rule_language.parse(text)
                return name, text

            v.rules = dict(self.separated("}", rule))
        return v

    def enum(self) -> Enum:
        e = Enum(self.word(), {})
        self.take("{")

        def variant() -> tuple[str, list[Field]]:
            name = self.word()
            return name, self.fields() if self.peek() == "{" else []

        for name, fields in self.separated("}", variant):
            if name in e.variants:
                raise SchemaError(f"variant {name} is declared twice", self.line)
            e.variants[name] = fields
        return e

    def event(self) -> EventVersion:
        e = EventVersion(self.version(), self.fields())
        if self.has("upcast"):
            self.take("from")
            up = e.upcast = Upcast(self.version())
            if self.has("wasm"):
                up.code = self.string()
                if self.has("export"):
                    up.code += "#" + self.string()
            else:
                self.take("{")

                def op() -> None:
                    if self.take("set", "rename") == "set":
                        name = self.word()
                        self.take(":")
                        up.sets[name] = self.literal()
                    else:
                        old = self.word()
                        self.take("as")
                        up.renames[old] = self.word()

                self.separated("}", op)
        return e

    def event_ref(self) -> str:
        return self.dotted()

    def event_refs(self) -> list[str]:
        out = [self.event_ref()]
        while self.has(","):
            out.append(self.event_ref())
        return out

    def aggregate(self) -> Aggregate:
        name = self.word()
        self.take("{")
        self.take("key")
        key = self.field(True)
        self.take("stream")
        a = Aggregate(name, key, self.string(), [])
        while not self.has("}"):
            what = self.take("value", "enum", "entity", "events")
            if what == "events":
                a.events = self.event_refs()
            elif what == "entity":
                entity = self.word()
                self.take("{")
                self.take("id")
                first = self.field()
                self.has(",")
                a.entities[entity] = Entity(entity, first.name, [first, *self.separated("}", self.field)])
            elif what == "value":
                v = self.value()
                a.values[v.name] = v
            else:
                e = self.enum()
                a.enums[e.name] = e
        return a

    def code(self, word: str) -> str | None:
        if not self.has(word):
            return None
        self.take("wasm")
        out = self.string()
        return out + "#" + self.string() if self.has("export") else out

    def every(self, default: int) -> int:
        if not self.has("snapshot"):
            return default
        self.take("every")
        return int(self.kind("num"))

    def state(self) -> State:
        s = State(self.dotted(), self.fields())
        s.evolve = self.code("evolve")
        s.snapshot_every = self.every(100)
        return s

    def projection(self) -> Projection:
        p = Projection(self.dotted(), [], {})
        self.take("{")
        self.take("from")
        p.sources = self.event_refs()
        p.code = self.code("fold")
        p.snapshot_every = self.every(0)
        while not self.has("}"):
            self.take("table")
            name = self.word()

            def column() -> Field:
                key = self.peek() == "key" and self.peek(1) != ":"
                if key:
                    self.take()
                return self.field(key)

            p.tables[name] = Table(name, self.fields(column))
        return p


def parse(text: str) -> Schema:
    return _Parser(text).schema()


def check(domain: Schema, derivation: Schema | None = None) -> list[str]:
    """Everything that is wrong with a schema, as text; empty if it is sound."""
    wrong: list[str] = []

    def known(t: Type, c: Context, a: Aggregate | None) -> bool:
        if t.name in SCALARS:
            return True
        context, _, name = t.name.rpartition(".")
        home = domain.contexts.get(context) if context else c
        if a is not None and not context and name in {**a.values, **a.enums, **a.entities}:
            return True
        if home is not None and name in a_types(home):
            return True
        owner = c.aggregates.get(context)
        return owner is not None and name in {**owner.values, **owner.enums, **owner.entities}

    def a_types(c: Context) -> dict:
        return {**c.values, **c.enums}

    def fields(fs: list[Field], where: str, c: Context, a: Aggregate | None = None) -> None:
        for f in fs:
            todo = [f.type]
            while todo:
                t = todo.pop()
                todo += t.args
                if t.name in COLLECTIONS:
                    if t.name in ("set", "map") and t.args[0].name not in SCALARS:
                        wrong.append(f"{where}.{f.name}: elements of a set and keys of a map are scalars")
                    if t.name in ("set", "map") and t.args[0].name == "bytes":
                        wrong.append(f"{where}.{f.name}: bytes can't be a key")
                elif not known(t, c, a):
                    wrong.append(f"{where}.{f.name}: unknown type {t.name}")

    for c in domain.contexts.values():
        for v in c.values.values():
            fields(v.fields, f"{c.name}.{v.name}", c)
        for e in c.enums.values():
            for variant, fs in e.variants.items():
                fields(fs, f"{c.name}.{e.name}.{variant}", c)
        owners: dict[str, str] = {}
        for a in c.aggregates.values():
            where = f"{c.name}.{a.name}"
            if a.key.type.name not in SCALARS or a.key.type.optional or a.key.type.name == "bytes":
                wrong.append(f"{where}: the key is a required scalar")
            if a.stream.count("{" + a.key.name + "}") != 1:
                wrong.append(f"{where}: the stream names its key once")
            for part in a.entities.values():
                fields(part.fields, f"{where}.{part.name}", c, a)
            for v in a.values.values():
                fields(v.fields, f"{where}.{v.name}", c, a)
            for name in a.events:
                if name not in c.events:
                    wrong.append(f"{where}: unknown event {name}")
                elif name in owners:
                    wrong.append(f"{where}: event {name} belongs to {owners[name]}")
                owners[name] = a.name
                for version in c.events.get(name, {}).values():
                    fields(version.fields, f"{c.name}.{name}@v{version.version}", c, a)
                    key = next((f for f in version.fields if f.name == a.key.name), None)
                    if key is None or key.type != a.key.type:
                        wrong.append(f"{c.name}.{name}@v{version.version}: the key field {a.key.name} is missing")
        for name, versions in c.events.items():
            if name not in owners:
                wrong.append(f"{c.name}.{name}: no aggregate owns it")
            if sorted(versions) != list(range(1, len(versions) + 1)):
                wrong.append(f"{c.name}.{name}: versions are numbered from 1 without gaps")
                continue
            for n, e in versions.items():
                if e.upcast is not None and e.upcast.source != n - 1:
                    wrong.append(f"{c.name}.{name}@v{n}: upcasts come from the version before")
                if n > 1 and (e.upcast is None or e.upcast.code is None):
                    old = {f.name: f for f in versions[n - 1].fields}
                    up = e.upcast or Upcast(n - 1)
                    back = {new: o for o, new in up.renames.items()}
                    for f in e.fields:
                        source = old.get(back.get(f.name, f.name))
                        carried = source is not None and (source.type == f.type or f.type.optional and source.type.required() == f.type.required())
                        if not (f.name in up.sets or carried or f.fills_itself or f.type.name in COLLECTIONS and source is None):
                            wrong.append(f"{c.name}.{name}@v{n}.{f.name}: nothing fills it when v{n - 1} is read")
    for p in (derivation.projections if derivation else {}).values():
        if not p.tables:
            wrong.append(f"{p.name}: no table")
        for ref in p.sources:
            home, _, name = ref.rpartition(".")
            c = domain.contexts.get(home or p.name.split(".")[0])
            if c is None or name not in c.events:
                wrong.append(f"{p.name}: unknown event {ref}")
        for t in p.tables.values():
            if not t.keys:
                wrong.append(f"{p.name}.{t.name}: no key")
            if any(k.type.name not in SCALARS or k.type.optional for k in t.keys):
                wrong.append(f"{p.name}.{t.name}: keys are required scalars")
    for s in (derivation.states if derivation else {}).values():
        home, _, name = s.aggregate.rpartition(".")
        if home not in domain.contexts or name not in domain.contexts[home].aggregates:
            wrong.append(f"state {s.aggregate}: unknown aggregate")
    return wrong

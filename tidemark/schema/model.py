"""What a schema declares."""

from __future__ import annotations

from dataclasses import dataclass, field

SCALARS = ("string", "int", "uint", "decimal", "bool", "uuid", "timestamp", "bytes")
COLLECTIONS = ("list", "set", "map")


@dataclass(frozen=True)
class Type:
    """A scalar, a reference, or list/set/map of ``args``."""

    name: str
    args: tuple[Type, ...] = ()
    optional: bool = False

    def __str__(self) -> str:
        text = f"[{self.args[0]}]" if self.name == "list" else f"{self.name}<{', '.join(map(str, self.args))}>" if self.args else self.name
        return text + "?" * self.optional

    def required(self) -> Type:
        return Type(self.name, self.args)


@dataclass
class Field:
    name: str
    type: Type
    default: object = None
    key: bool = False
    line: int = 0

    @property
    def fills_itself(self) -> bool:
        return self.type.optional or self.default is not None


@dataclass
class Upcast:
    source: int
    sets: dict[str, object] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)
    code: str | None = None


@dataclass
class Value:
    name: str
    fields: list[Field]
    rules: dict[str, str] = field(default_factory=dict)


@dataclass
class Enum:
    name: str
    variants: dict[str, list[Field]]


@dataclass
class EventVersion:
    version: int
    fields: list[Field]
    upcast: Upcast | None = None


@dataclass
class Entity:
    name: str
    id: str
    fields: list[Field]


@dataclass
class Aggregate:
    name: str
    key: Field
    stream: str
    events: list[str]
    values: dict[str, Value] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)


@dataclass
class Context:
    name: str
    values: dict[str, Value] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)
    events: dict[str, dict[int, EventVersion]] = field(default_factory=dict)
    aggregates: dict[str, Aggregate] = field(default_factory=dict)


@dataclass
class State:
    aggregate: str
    fields: list[Field]
    evolve: str | None = None
    snapshot_every: int = 100


@dataclass
class Table:
    name: str
    fields: list[Field]

    @property
    def keys(self) -> list[Field]:
        return [f for f in self.fields if f.key]

    @property
    def columns(self) -> list[Field]:
        return [f for f in self.fields if not f.key]


@dataclass
class Projection:
    name: str
    sources: list[str]
    tables: dict[str, Table]
    code: str | None = None
    snapshot_every: int = 0


@dataclass
class Schema:
    layer: str = "domain"
    imports: list[str] = field(default_factory=list)
    contexts: dict[str, Context] = field(default_factory=dict)
    states: dict[str, State] = field(default_factory=dict)
    projections: dict[str, Projection] = field(default_factory=dict)

"""Payloads against the schema, as variants and in native expressions: validation, canonical text, events to append.

Every error is reported as ``path: kind``: missing, unknown field, wrong type, wrong key, duplicate element, unknown
variant, key is not the id (an entity in a map), violates a rule. Rules of a value are looked at once its fields are
fine, with the defaults of absent fields. Numbers in rules compare as decimals of 38 digits, 18 after the point; an
enum compares by the name of its variant, with or without a payload.

The canonical text of a valid payload has the declared fields in their order, defaults and nulls for absent ones,
sets sorted without duplicates, maps sorted by key (numbers by value, timestamps by instant, text by bytes), timestamps
in UTC, decimals as written, no white space.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules, values
from tidemark.schema.model import SCALARS, Aggregate, Context, Entity, Enum, Field, Schema, Type, Value

_MOST = {"int": 2**63 - 1, "uint": 2**64 - 1}


class Resolver:
    """Finds the value, enum or entity that a name stands for."""

    def __init__(self, domain: Schema, context: Context) -> None:
        self.domain, self.context = domain, context

    def find(self, name: str) -> Value | Enum:
        home, _, short = name.rpartition(".")
        places = [self.domain.contexts[home]] if home in self.domain.contexts else [self.context, *self.context.aggregates.values()]
        for p in places:
            for items in (p.values, p.enums, getattr(p, "entities", {})):
                if short in items:
                    return items[short]
        raise KeyError(name)


def _error(path: Column, kind: str) -> Column:
    return F.array(F.concat(path, F.lit(f": {kind}")))


_NONE = lambda: F.array().cast("array<string>")


def _scalar(kind: str, v: Column) -> Column:
    """Whether a variant that is not null is a scalar of the kind."""
    name = F.schema_of_variant(v)
    if kind == "bool":
        return name == "BOOLEAN"
    if kind in ("int", "uint"):
        # whole numbers beyond 64 bits come as decimals of scale 0
        number = F.try_variant_get(v, "$", "decimal(38,0)")
        whole = (name == "BIGINT") | name.rlike(r"^DECIMAL\(\d+,\s*0\)$")
        low = 0 if kind == "uint" else -(2**63)
        return F.coalesce(whole & (number >= F.lit(str(low)).cast("decimal(38,0)")) & (number <= F.lit(str(_MOST[kind])).cast("decimal(38,0)")), F.lit(False))
    text = name == "STRING"
    return text if kind == "string" else text & values.accepts(kind, F.try_variant_get(v, "$", "string"))


def _check(t: Type, v: Column, path: Column, r: Resolver) -> Column:
    """Errors of a variant that is present and not null."""
    name = F.schema_of_variant(v)
    if t.name in SCALARS:
        return F.when(_scalar(t.name, v), _NONE()).otherwise(_error(path, "wrong type"))
    if t.name in ("list", "set"):
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda x, i: _check(t.args[0], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), r)))
        if t.name == "set":
            text = F.try_variant_get(v, "$", "array<string>")
            each = F.concat(each, F.when(F.size(F.array_distinct(text)) < F.size(text), _error(path, "duplicate element")).otherwise(_NONE()))
        return F.when(name.startswith("ARRAY"), each).otherwise(_error(path, "wrong type"))
    if t.name == "map":
        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        key_ok = lambda k: F.lit(True) if t.args[0].name == "string" else values.accepts(t.args[0].name, k)
        entity = r.find(t.args[1].name) if t.args[1].name not in SCALARS and not t.args[1].args else None

        def pair(e: Column) -> Column:
            at = F.concat(path, F.lit("."), e["key"])
            out = F.concat(F.when(key_ok(e["key"]), _NONE()).otherwise(_error(at, "wrong key")), _check(t.args[1], e["value"], at, r))
            if isinstance(entity, Entity):
                own = F.try_variant_get(e["value"], f"$.{entity.id}", "string")
                out = F.when((F.size(out) == 0) & (own != e["key"]), _error(at, "key is not the id")).otherwise(out)
            return out

        each = F.flatten(F.transform(pairs, pair))
        return F.when(name.startswith("OBJECT"), each).otherwise(_error(path, "wrong type"))
    found = r.find(t.name)
    if isinstance(found, Enum):
        units = [n for n, fields in found.variants.items() if not fields]
        text = F.try_variant_get(v, "$", "string")
        out = F.when((name == "STRING") & text.isin(*units), _NONE()) if units else F.when(F.lit(False), _NONE())
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        for n, fields in found.variants.items():
            if fields:
                one = name.startswith("OBJECT") & (F.size(keys) == 1) & (keys[0] == n)
                out = out.when(one, record_errors(fields, F.try_variant_get(v, f"$.{n}", "variant"), F.concat(path, F.lit(f".{n}")), r))
        return out.otherwise(_error(path, "unknown variant"))
    errors = record_errors(found.fields, v, path, r)
    broken = getattr(found, "rules", {})
    if not broken:
        return errors
    each = F.flatten(F.array(*[F.when(rule_holds(rule, found.fields, v, r), _NONE()).otherwise(_error(path, f"violates {name}")) for name, rule in broken.items()]))
    # the array of one binds the fields' errors, so that they are found once
    return F.get(F.transform(F.array(errors), lambda e: F.when(F.size(e) == 0, each).otherwise(e)), F.lit(0))


def rule_holds(rule: str, fields: list[Field], v: Column, r: Resolver) -> Column:
    """Whether a rule holds of a variant whose fields are valid."""

    def operand(x: object) -> tuple[Column, str, bool | None]:
        if isinstance(x, rules.Literal):
            return (F.lit(x.value).cast("decimal(38,18)") if x.kind == "number" else F.lit(x.value)), x.kind, None
        at, own, optional, first = f"$.{x.name}", fields, False, None
        for part in x.name.split("."):
            f = next((f for f in own if f.name == part), None)
            if f is None:
                raise rules.RuleError(f"no field {x.name}")
            first, optional, t = first or f, optional or f.type.optional, f.type.required()
            found = r.find(t.name) if t.name not in SCALARS and not t.args else None
            own = getattr(found, "fields", [])
        get = lambda kind: F.try_variant_get(v, at, kind)
        if x.length:
            size = F.char_length(get("string")) if t.name == "string" else F.size(get("array<variant>")) if t.name in ("list", "set") else F.size(get("map<string,variant>"))
            return F.when(get("variant").isNotNull() & ~F.is_variant_null(get("variant")), size).cast("decimal(38,18)"), "number", optional
        if t.name in ("int", "uint", "decimal"):
            c, kind = (get("string") if t.name == "decimal" else get("decimal(38,0)")).try_cast("decimal(38,18)"), "number"
        elif t.name == "bool":
            c, kind = get("boolean"), "bool"
        elif isinstance(found, Enum):
            name = F.schema_of_variant(get("variant"))
            c, kind = F.when(name == "STRING", get("string")).otherwise(F.get(F.map_keys(get("map<string,variant>")), F.lit(0))), "text"
        elif t.name in SCALARS:
            c, kind = get("string"), "text"
        else:
            raise rules.RuleError(f"{x.name} is compared through len() or one of its fields")
        if "." not in x.name and first.default is not None:
            c = F.coalesce(c, F.lit(str(first.default)).cast("decimal(38,18)") if kind == "number" else F.lit(first.default))
        return c, kind, optional

    return rules.build(rules.parse(rule), operand)


def record_errors(fields: list[Field], v: Column, path: Column, r: Resolver) -> Column:
    """All errors of a record: of its fields in declared order, then unknown fields by name."""
    parts = []
    for f in fields:
        x = F.try_variant_get(v, f"$.{f.name}", "variant")
        at = F.concat(path, F.lit(f".{f.name}"))
        absent = x.isNull() | F.is_variant_null(x)
        parts.append(F.when(absent, _NONE() if f.fills_itself else _error(at, "missing")).otherwise(_check(f.type.required(), x, at, r)))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f.name) for f in fields]))), lambda k: F.concat(path, F.lit("."), k, F.lit(": unknown field")))
    inner = F.concat(*parts, unknown) if parts else unknown
    return F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), inner).otherwise(_error(path, "wrong type"))


def event_errors(domain: Schema, family: str, version: int, payload: Column) -> Column:
    """Errors of a JSON payload of ``family@vN``; text that is no JSON is one error."""
    home, _, name = family.rpartition(".")
    context = domain.contexts[home]
    return errors_of(context.events[name][version].fields, payload, Resolver(domain, context))


def errors_of(fields: list[Field], text: Column, r: Resolver) -> Column:
    """Errors of JSON text that should be a record of ``fields``: of an event, a state, a row or its key."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(record_errors(fields, v, F.lit("$"), r))


# ---- canonical text


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def utc(text: Column) -> Column:
    """A timestamp with an offset as the same instant in UTC; its fraction stays as written."""
    fraction = F.regexp_extract(text, r"(\.\d+)", 1)
    seconds = F.unix_seconds(F.try_to_timestamp(F.upper(F.regexp_replace(text, r"\.\d+", ""))))
    base = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.replace(base.cast("string"), F.lit(" "), F.lit("T")), fraction, F.lit("Z"))


def _order(kind: str, text: Column) -> Column:
    """What scalars of a kind are sorted by, from their text."""
    if kind in ("int", "uint"):
        return text.cast("decimal(38,0)")
    if kind == "decimal":
        return text.cast("decimal(38,18)")
    if kind == "timestamp":
        at = utc(text)
        return F.concat(F.substring(at, 1, 19), F.rpad(F.regexp_extract(at, r"\.(\d+)", 1), 9, "0"))
    return text


def _scalar_text(kind: str, v: Column) -> Column:
    """The JSON text of a valid scalar."""
    if kind in ("int", "uint"):
        return F.try_variant_get(v, "$", "decimal(38,0)").cast("string")
    if kind == "bool":
        return F.try_variant_get(v, "$", "boolean").cast("string")
    text = F.try_variant_get(v, "$", "string")
    return _quoted(utc(text) if kind == "timestamp" else text)


def _joined(parts: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), F.array_join(parts, ","), F.lit(end))


def canonical(t: Type, v: Column, r: Resolver) -> Column:
    """The canonical JSON text of a valid variant that is not null."""
    if t.name in SCALARS:
        return _scalar_text(t.name, v)
    if t.name == "list":
        return _joined(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: canonical(t.args[0], x, r)), "[", "]")
    if t.name == "set":
        kind = t.args[0].name
        plain = lambda x: F.try_variant_get(x, "$", "string")
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(_order(kind, plain(x)).alias("by"), i.alias("i"), _scalar_text(kind, x).alias("text")))
        # of equal elements the first one as written
        once = F.transform(F.array(F.array_sort(items)), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x["by"] != F.get(xs, i - 1)["by"])))
        return _joined(F.transform(F.get(once, F.lit(0)), lambda x: x["text"]), "[", "]")
    if t.name == "map":
        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        made = F.transform(pairs, lambda e: F.struct(_order(t.args[0].name, e["key"]).alias("by"), F.concat(_quoted(e["key"]), F.lit(":"), canonical(t.args[1].required(), e["value"], r)).alias("text")))
        return _joined(F.transform(F.array_sort(made), lambda x: x["text"]), "{", "}")
    found = r.find(t.name)
    if isinstance(found, Enum):
        out = _quoted(F.try_variant_get(v, "$", "string"))
        key = F.get(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.lit(0))
        for n, fields in found.variants.items():
            if fields:
                inner = canonical_record(fields, F.try_variant_get(v, f"$.{n}", "variant"), r)
                out = F.when(F.schema_of_variant(v).startswith("OBJECT") & (key == n), F.concat(F.lit(f'{{"{n}":'), inner, F.lit("}"))).otherwise(out)
        return out
    return canonical_record(found.fields, v, r)


def canonical_record(fields: list[Field], v: Column, r: Resolver) -> Column:
    parts = []
    for f in fields:
        x = F.try_variant_get(v, f"$.{f.name}", "variant")
        default = "null" if f.default is None else json.dumps(f.default if isinstance(f.default, (bool, list, dict)) or f.type.name in ("int", "uint") else str(f.default), ensure_ascii=False, separators=(",", ":"))
        value = F.when(x.isNull() | F.is_variant_null(x), F.lit(default)).otherwise(canonical(f.type.required(), x, r))
        parts.append(F.concat(F.lit(f'"{f.name}":'), value))
    return _joined(F.array(*parts), "{", "}")


# ---- events to append


def owner(domain: Schema, family: str) -> Aggregate | None:
    """The aggregate that an event family belongs to."""
    home, _, name = family.rpartition(".")
    context = domain.contexts.get(home)
    return next((a for a in context.aggregates.values() if name in a.events), None) if context else None


def prepared(domain: Schema, rows: DataFrame, families: list[str] | None = None) -> DataFrame:
    """``rows(stream_id, type_ref, payload, metadata, ...)`` with columns family, type_version, canonical and errors.

    A reference is ``Context.Name`` (the latest version) or ``Context.Name@vN``. Errors: a malformed reference, a type
    that the domain lacks, metadata that is no object, those of the payload, and a stream other than the one that the
    owning aggregate's template gives the payload's key. The canonical payload is null where there are errors.
    """
    ref = F.col("_ref")
    family = F.concat(ref["context"], F.lit("."), ref["name"])
    meta = F.try_parse_json(F.col("metadata"))
    odd = (F.coalesce(F.col("metadata"), F.lit("")) != "") & ~F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    errors = F.when(ref.isNull(), F.array(F.lit("malformed event type"))).when(odd, F.array(F.lit("metadata is no object")))
    text, version = F.lit(None).cast("string"), ref["version"]
    for home, context in domain.contexts.items():
        r = Resolver(domain, context)
        for name, versions in context.events.items():
            if families is not None and f"{home}.{name}" not in families:
                continue
            a = owner(domain, f"{home}.{name}")
            mine, latest = family == f"{home}.{name}", max(versions)
            version = F.when(mine, F.coalesce(ref["version"], F.lit(latest))).otherwise(version)
            for n, e in versions.items():
                this = mine & (F.coalesce(ref["version"], F.lit(latest)) == n)
                v = F.try_parse_json(F.col("payload"))
                wrong = errors_of(e.fields, F.col("payload"), r)
                if a is not None:
                    stream = values.render(a.stream, F.try_variant_get(v, f"$.{a.key.name}", "string"))
                    strange = F.array(F.concat(F.lit("belongs to stream "), stream))
                    wrong = F.get(F.transform(F.array(wrong), lambda w: F.when((F.size(w) == 0) & (F.col("stream_id") != stream), strange).otherwise(w)), F.lit(0))
                errors = errors.when(this, wrong)
                text = F.when(this, canonical_record(e.fields, v, r)).otherwise(text)
    errors = errors.otherwise(F.array(F.lit("unknown event type")))
    out = rows.withColumn("_ref", values.event_ref(F.col("type_ref")))
    out = out.withColumns({"family": family, "type_version": version, "errors": errors}).withColumn("canonical", F.when(F.size("errors") == 0, text))
    return out.drop("_ref")

"""Typed views: the events of a family as columns of its latest version.

Each version's payload is parsed with the fields it declares and brought up step by step: a declared step sets, renames,
carries and fills in native expressions, a step by code runs a registered Python function over Arrow batches. One scan
serves all versions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.validate import Resolver
from tidemark.functions.workers import reach
from tidemark.schema.model import Enum, EventVersion, Field, Schema, Type

_TYPES = {"string": T.StringType(), "uuid": T.StringType(), "int": T.LongType(), "uint": T.DecimalType(20, 0), "decimal": T.DecimalType(38, 18), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "bytes": T.BinaryType()}


def spark_type(t: Type, r: Resolver) -> T.DataType:
    """How a declared type is held in a typed view; an enum is its JSON text (a plain variant its name)."""
    if t.name in _TYPES:
        return _TYPES[t.name]
    if t.name in ("list", "set"):
        return T.ArrayType(spark_type(t.args[0], r))
    if t.name == "map":  # JSON has text keys
        return T.MapType(T.StringType(), spark_type(t.args[1], r))
    found = r.find(t.name)
    return T.StringType() if isinstance(found, Enum) else struct_type(found.fields, r)


def struct_type(fields: list[Field], r: Resolver) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.type, r)) for f in fields])


def _filled(fields: list[Field], value: Callable[[Field], Column], r: Resolver) -> Column:
    def one(f: Field) -> Column:
        kind = spark_type(f.type, r)
        c = _inner(f.type, value(f).cast(kind), r)
        return (c if f.default is None else F.coalesce(c, F.lit(str(f.default) if not isinstance(f.default, bool) else f.default).cast(kind))).cast(kind).alias(f.name)

    return F.struct(*[one(f) for f in fields])


def _inner(t: Type, c: Column, r: Resolver) -> Column:
    """``c`` with the defaults of the records inside it filled."""
    if t.name in _TYPES:
        return c
    if t.name in ("list", "set"):
        return F.transform(c, lambda x: _inner(t.args[0], x, r)) if _holds_records(t, r) else c
    if t.name == "map":
        return F.transform_values(c, lambda _, x: _inner(t.args[1], x, r)) if _holds_records(t, r) else c
    found = r.find(t.name)
    return c if isinstance(found, Enum) else F.when(c.isNotNull(), _filled(found.fields, lambda f: c[f.name], r))


def _holds_records(t: Type, r: Resolver) -> bool:
    last = t.args[-1]
    return _holds_records(last, r) if last.args else last.name not in _TYPES and not isinstance(r.find(last.name), Enum)


def _step(old: EventVersion, new: EventVersion, p: Column, r: Resolver, code: dict[str, Callable[[dict], dict]]) -> Column:
    """The payload ``p`` of version ``old`` as one of ``new``."""
    up, had = new.upcast, {f.name for f in old.fields}
    if up is not None and up.code is not None:
        if up.code not in code:
            raise KeyError(f"no function is registered for the upcast {up.code}")
        run = code[up.code]

        @F.pandas_udf("string")
        def call(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None else json.dumps(run(json.loads(t))))

        given = F.from_json(call(F.to_json(p, {"ignoreNullFields": "false"})), struct_type(new.fields, r))
        return _filled(new.fields, lambda f: given[f.name], r)
    sets = up.sets if up else {}
    source = {to: name for name, to in (up.renames if up else {}).items()}

    def value(f: Field) -> Column:
        if f.name in sets:
            x = sets[f.name]
            return F.lit(x if x is None or isinstance(x, bool) else str(x))
        name = source.get(f.name, f.name)
        return p[name] if name in had else F.lit(None)

    return _filled(new.fields, value, r)


def latest(domain: Schema, family: str, version: Column, payload: Column, code: dict[str, Callable[[dict], dict]] | None = None) -> Column:
    """A struct of the latest version's fields from a JSON payload; a version that is not declared raises."""
    home, _, name = family.rpartition(".")
    context = domain.contexts[home]
    r, versions = Resolver(domain, context), sorted(context.events[name])
    out = None
    for n in versions:
        event = context.events[name][n]
        p = F.from_json(payload, struct_type(event.fields, r))
        # Python runs on the whole batch whatever branch a row takes, so other versions' rows must come as null
        p = F.when(version == n, _filled(event.fields, lambda f, p=p: p[f.name], r))
        for m in versions[versions.index(n) + 1 :]:
            new = context.events[name][m]
            p = F.when(version == n, _step(event, new, p, r, code or {}))
            event = new
        out = F.when(version == n, p) if out is None else out.when(version == n, p)
    unknown = F.raise_error(F.concat(F.lit(f"{family} has no version "), F.coalesce(version.cast("string"), F.lit("null"))))
    return out.otherwise(unknown)


def typed_view(events: DataFrame, domain: Schema, family: str, code: dict[str, Callable[[dict], dict]] | None = None) -> DataFrame:
    """position, stream_id and the latest version's fields as ``event.<field>`` of the family's events."""
    reach(events.sparkSession)
    own = events.where(F.col("family") == family)
    return own.select("position", "stream_id", latest(domain, family, F.col("type_version"), F.col("payload"), code).alias("event"))

"""A read model's table, as its schema declares it, folded from column operations in one plan.

Ops are rows of (key columns, ord, op, column, value, map_key, row): the row's key, the order of the op, its name, the
column it changes and its arguments as text; ``upsert`` carries the whole row as a JSON object, ``set`` of a set or map
its JSON. List operations further read ``front``, ``all``, ``keep`` and ``from_end``, absent columns being null.

The last reset of a row and of each of its columns come from one aggregate with partial maxima. One join leaves the
ops that still count; numbers and plain columns are one aggregate per key, sets and maps one per element first, and
only list columns are walked in order. Columns that an upsert leaves out have their default: what is declared, else
null for optional ones, 0 for numbers, nothing for collections; others fail with ``NoDefault``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import decimal_text, scale_of
from tidemark.operators.fold import RESETS
from tidemark.schema.model import Field, Table

NUMBERS = ("int", "uint", "decimal")
#: Spark's type of a scalar's text; the others stay text.
_SQL = {"int": "bigint", "uint": "decimal(20,0)", "bool": "boolean"}
_ARGS = {"column": "string", "value": "string", "map_key": "string", "row": "string", "front": "boolean", "all": "boolean", "keep": "int", "from_end": "string"}


class NoDefault(ValueError):
    """A column has no default and must be supplied."""


def kind_of(f: Field) -> str:
    """number, value, set, map or list."""
    t = f.type
    if t.name in ("set", "map", "list") and not t.optional:
        return t.name
    return "number" if t.name in NUMBERS and not t.optional else "value"


def has_default(f: Field) -> bool:
    return f.fills_itself or kind_of(f) != "value"


def _typed(kind: str, text: Column) -> Column:
    return text.cast(_SQL[kind]) if kind in _SQL else text


def _amount(f: Field, text: Column) -> Column:
    return text.cast("decimal(38,18)" if f.type.name == "decimal" else "decimal(38,0)")


def _text(default: object) -> str | None:
    return None if default is None else str(default).lower() if isinstance(default, bool) else str(default)


def fold_table(ops: DataFrame, table: Table) -> DataFrame:
    """(keys, columns) of every row that exists after all ops."""
    keys = [f.name for f in table.keys]
    for name, kind in _ARGS.items():
        if name not in ops.columns:
            ops = ops.withColumn(name, F.lit(None).cast(kind))
    is_reset, is_set = F.col("op").isin(*RESETS), F.col("op") == "set"
    sets = [F.max(F.when(is_set & (F.col("column") == f.name), F.col("ord"))).alias(f"_set_{f.name}") for f in table.columns]
    last = ops.groupBy(*keys).agg(F.max_by("op", "ord").alias("_last"), F.max(F.when(is_reset, F.col("ord"))).alias("_row"), *sets)
    # a set before the row's last reset no longer counts
    later = [F.when(F.col("_row").isNull() | (F.col(f"_set_{f.name}") > F.col("_row")), F.col(f"_set_{f.name}")).alias(f"_set_{f.name}") for f in table.columns]
    last = last.where("_last != 'delete'").select(*keys, "_row", *later)
    rest = ops.join(last, keys).where(F.col("_row").isNull() | (F.col("ord") >= F.col("_row")))

    given = lambda f: F.when(F.col("op") == "upsert", F.get_json_object("row", f"$.{f.name}")).otherwise(F.col("value"))
    counts = lambda f: F.col(f"_set_{f.name}").isNull() | (F.col("ord") >= F.col(f"_set_{f.name}"))
    own = lambda f: (F.col("column") == f.name) & counts(f)
    starts = lambda f: counts(f) & ((F.col("op") == "upsert") & F.col(f"_set_{f.name}").isNull() | is_set & (F.col("column") == f.name))

    plain = [F.max(F.when(is_reset & (F.col("op") != "delete"), F.col("ord"))).alias("_given")]
    for f in table.columns:
        kind, start = kind_of(f), F.lit(_text(f.default))
        if kind == "number":
            start = F.coalesce(start, F.lit("0"))
            text = F.when(starts(f), F.coalesce(given(f), start)).when(own(f) & (F.col("op") == "add"), F.col("value"))
            total = F.coalesce(F.sum(_amount(f, text)), F.lit(0)) + F.when(F.max(F.when(starts(f), True)).isNull(), _amount(f, start)).otherwise(F.lit(0))
            if f.type.name == "decimal":
                # sums keep the longest scale of what went in
                scale = F.greatest(F.coalesce(F.max(scale_of(text)), F.lit(0)), F.when(F.max(F.when(starts(f), True)).isNull(), scale_of(start)).otherwise(F.lit(0)))
                plain.append(decimal_text(total.cast("decimal(38,18)"), scale).alias(f.name))
            else:
                plain.append(total.cast(_SQL[f.type.name]).alias(f.name))
        elif kind == "value":
            had = F.max(F.when(starts(f), True))
            text = F.max_by(given(f), F.when(starts(f), F.col("ord")))
            value = F.coalesce(text, start)
            if not has_default(f):
                value = F.when(value.isNull() | had.isNull(), F.raise_error(F.lit(f"NoDefault: column {f.name} has no default and must be supplied"))).otherwise(value)
            plain.append(_typed(f.type.name, value).alias(f.name))
    out = rest.groupBy(*keys).agg(*plain).drop("_given")

    for f in table.columns:
        if kind_of(f) == "set":
            item = f.type.args[0].name
            seed = rest.where(starts(f)).select(*keys, "ord", F.explode(F.from_json(F.coalesce(given(f), F.lit("[]")), "array<string>")).alias("_x"), F.lit(True).alias("_in"))
            steps = rest.where(own(f) & F.col("op").isin("set_add", "set_remove")).select(*keys, "ord", F.col("value").alias("_x"), (F.col("op") == "set_add").alias("_in"))
            there = seed.unionByName(steps).groupBy(*keys, "_x").agg(F.max_by("_in", "ord").alias("_in")).where("_in")
            out = _beside(out, there.groupBy(*keys).agg(F.array_sort(F.collect_list(_typed(item, F.col("_x")))).alias(f.name)), keys, f.name, F.array())
        elif kind_of(f) == "map":
            out = _beside(out, _map(rest, f, keys, starts(f), own(f), given(f)), keys, f.name, F.create_map())
        elif kind_of(f) == "list":
            out = _beside(out, _list(rest, f, keys, starts(f), own(f), given(f)), keys, f.name, F.array())
    return out.select(*keys, *[f.name for f in table.columns])


def _beside(out: DataFrame, more: DataFrame, keys: list[str], name: str, empty: Column) -> DataFrame:
    kind = more.schema[name].dataType
    return out.join(more, keys, "left").withColumn(name, F.coalesce(F.col(name), empty.cast(kind)))


def _map(rest: DataFrame, f: Field, keys: list[str], starts: Column, own: Column, given: Column) -> DataFrame:
    """The entries of a map column: the last put or removal of each, plus the adds after it."""
    key, value = (t.name for t in f.type.args)
    numeric = value in NUMBERS
    seed = rest.where(starts).select(*keys, "ord", F.explode(F.from_json(F.coalesce(given, F.lit("{}")), "map<string,string>")).alias("_k", "_v"), F.lit("map_put").alias("op"))
    steps = rest.where(own & F.col("op").isin("map_put", "map_remove", "add")).select(*keys, "ord", F.col("map_key").alias("_k"), F.col("value").alias("_v"), "op")
    every = seed.unionByName(steps)
    last = every.groupBy(*keys, "_k").agg(F.max(F.when(F.col("op") != "add", F.col("ord"))).alias("_at"))
    kept = every.join(last, [*keys, "_k"]).where((F.col("_at").isNull() | (F.col("ord") >= F.col("_at"))) & (F.col("op") != "map_remove"))
    if numeric:
        item = Field(f.name, f.type.args[1])
        total = F.sum(_amount(item, F.col("_v")))
        total = decimal_text(total.cast("decimal(38,18)"), F.max(scale_of(F.col("_v")))) if value == "decimal" else total.cast(_SQL[value])
    else:
        total = _typed(value, F.max_by("_v", "ord"))
    each = kept.groupBy(*keys, "_k").agg(total.alias("_v"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(_typed(key, F.col("_k")).alias("k"), F.col("_v").alias("v"))))).alias(f.name))


def _list(rest: DataFrame, f: Field, keys: list[str], starts: Column, own: Column, given: Column) -> DataFrame:
    """A list column, walked in order from its last reset on."""
    item = f.type.args[0].name
    args = ["op", "value", "front", "all", "keep", "from_end"]
    steps = rest.where(starts | own & F.col("op").startswith("list_")).withColumn("_given", given)
    ordered = F.array_sort(F.collect_list(F.struct("ord", *args, "_given")))

    def step(xs: Column, o: Column) -> Column:
        x = o["value"]
        pushed = F.when(F.coalesce(o["front"], F.lit(False)), F.concat(F.array(x), xs)).otherwise(F.concat(xs, F.array(x)))
        at = F.array_position(xs, x)
        once = F.when(at > 0, F.concat(F.slice(xs, F.lit(1), (at - 1).cast("int")), F.slice(xs, (at + 1).cast("int"), F.size(xs)))).otherwise(xs)
        removed = F.when(F.coalesce(o["all"], F.lit(False)), F.array_remove(xs, x)).otherwise(once)
        keep = F.least(o["keep"], F.size(xs))
        cut = F.when(o["from_end"] == "front", F.slice(xs, F.lit(1), keep)).otherwise(F.slice(xs, F.size(xs) - keep + 1, keep))
        begun = F.coalesce(F.from_json(o["_given"], "array<string>"), F.array().cast("array<string>"))
        return F.when(o["op"].isin("upsert", "set"), begun).when(o["op"] == "list_push", pushed).when(o["op"] == "list_remove", removed).when(o["op"] == "list_truncate", cut).otherwise(xs)

    done = F.aggregate("_ops", F.array().cast("array<string>"), step)
    return steps.groupBy(*keys).agg(ordered.alias("_ops")).select(*keys, F.transform(done, lambda x: _typed(item, x)).alias(f.name))

"""Folds over the log: the column operations as closed-form aggregates.

An op row has a row key, an order (position, op index), an op name and its arguments. Ops on a row are applied in
order; ``upsert`` and ``delete`` replace the row, ``set`` a column. Instead of replaying them one after another, each
column is computed from the ops after its last reset, found by an aggregate with partial maxima; a hot key costs one
partial row per task, not a sort of all its events in one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import by_position, running

RESETS = ("upsert", "delete")


def after_reset(ops: DataFrame, keys: list[str], resets: Iterable[str], order: str = "ord") -> DataFrame:
    """The ops from the last of ``resets`` on (that op included); all of them where ops have no names."""
    if "op" not in ops.columns:
        return ops
    last = ops.groupBy(*keys).agg(F.max(F.when(F.col("op").isin(*resets), F.col(order))).alias("_reset"))
    return ops.join(last, keys).where(F.col("_reset").isNull() | (F.col(order) >= F.col("_reset"))).drop("_reset")


def alive(ops: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Keys whose row exists at the end: their last op is no delete, as any other op makes the row anew."""
    return ops.groupBy(*keys).agg(F.max_by("op", order).alias("_op")).where("_op != 'delete'").select(*keys)


def number(ops: DataFrame, keys: list[str], value: str = "value", order: str = "ord") -> DataFrame:
    """A numeric column: the last set or upsert plus the adds after it; deletes start at 0."""
    rest = after_reset(ops, keys, (*RESETS, "set"), order)
    amount = F.when(F.col("op").isin("upsert", "set", "add"), F.col(value))
    return rest.groupBy(*keys).agg(F.coalesce(F.sum(amount), F.lit(0)).alias(value))


def latest(ops: DataFrame, keys: list[str], value: str = "value", order: str = "ord") -> DataFrame:
    """A column that is only set: the value of the last set or upsert since the row began, else null."""
    rest = after_reset(ops, keys, RESETS, order)
    given = F.when(F.col("op").isin("set", "upsert"), F.col(order)) if "op" in ops.columns else F.col(order)
    return rest.groupBy(*keys).agg(F.max_by(value, given).alias(value))


def members(ops: DataFrame, keys: list[str], element: str = "element", order: str = "ord", seed: str | None = None) -> DataFrame:
    """A set column of set_add and set_remove: (keys, elements), sorted; a row per key that has any.

    ``seed``: the array of elements that an upsert or a set gives; without it they give the empty set.
    """
    rest = after_reset(ops, keys, (*RESETS, "set"), order)
    own = rest.where(F.col("op").isin("set_add", "set_remove")).select(*keys, element, order, "op")
    if seed is not None:
        given = rest.where(F.col("op").isin("upsert", "set"))
        own = own.unionByName(given.select(*keys, F.explode(seed).alias(element), order, F.lit("set_add").alias("op")))
    last = own.groupBy(*keys, element).agg(F.max_by("op", order).alias("op"))
    return last.where("op = 'set_add'").groupBy(*keys).agg(F.array_sort(F.collect_list(element)).alias("elements"))


def entries(ops: DataFrame, keys: list[str], map_key: str = "map_key", value: str = "value", order: str = "ord", seed: str | None = None) -> DataFrame:
    """A map column of map_put, map_remove and add per entry: a row per entry.

    ``seed``: the map that an upsert or a set gives; without it they give the empty map.
    """
    both = [*keys, map_key]
    rest = after_reset(ops, keys, (*RESETS, "set"), order)
    own = rest.where(F.col("op").isin("map_put", "map_remove", "add")).select(*both, value, order, "op")
    if seed is not None:
        given = rest.where(F.col("op").isin("upsert", "set"))
        own = own.unionByName(given.select(*keys, F.explode(seed).alias(map_key, value), order, F.lit("map_put").alias("op")))
    kept = after_reset(own, both, ("map_put", "map_remove"), order).where("op != 'map_remove'")
    return kept.groupBy(*both).agg(F.sum(value).alias(value))


def last_n(ops: DataFrame, keys: list[str], n: int, value: str = "value", order: str = "ord", front: bool = False) -> DataFrame:
    """A list column of pushes, each truncated to the last ``n``: (keys, items), oldest first.

    With ``front`` the pushes go to the front and the first ``n`` stay: newest first. Row numbers up to n prune each
    task's rows before the shuffle, so a hot key sends n rows per task.
    """
    own = after_reset(ops, keys, (*RESETS, "set"), order)
    own = own.where(~F.col("op").isin(*RESETS, "set")) if "op" in ops.columns else own
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    few = own.withColumn("_r", rank).where(F.col("_r") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return few.groupBy(*keys).agg((F.reverse(items) if front else items).alias("items"))


#: What a column of whole numbers holds.
RANGES = {"uint": (0, 2**64 - 1), "int": (-(2**63), 2**63 - 1)}


def first_out_of_range(ops: DataFrame, keys: list[str], kind: str = "uint", value: str = "value", order: str = "ord", bucket: Column | None = None) -> DataFrame:
    """(keys, first_failure, failure): the first order at which a column would leave its range, Underflow or Overflow.

    The value at an op is the running sum less what that sum was just before the last reset; only failures of keys
    that have one are returned. Sums are decimals of 38 digits.
    """
    bucket = by_position(order) if bucket is None else bucket
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in RANGES[kind])
    amount = F.when(F.col("op") == "delete", F.lit(0)).otherwise(F.col(value)).cast("decimal(38,0)")
    total = running(ops.withColumn("_amount", amount), keys, [order], bucket, sums={"_sum": F.col("_amount")})
    dropped = F.when(F.col("op").isin(*RESETS, "set"), F.col("_sum") - F.coalesce("_amount", F.lit(0)))
    based = running(total, keys, [order], bucket, lasts={"_base": dropped})
    now = F.col("_sum") - F.coalesce("_base", F.lit(0))
    failed = based.where((now < low) | (now > high)).select(*keys, F.col(order).alias("_at"), F.when(now < low, "Underflow").otherwise("Overflow").alias("_kind"))
    return failed.groupBy(*keys).agg(F.min("_at").alias("first_failure"), F.min_by("_kind", "_at").alias("failure"))


def first_underflow(ops: DataFrame, keys: list[str], value: str = "value", order: str = "ord", bucket: Column | None = None) -> DataFrame:
    """The first order at which an unsigned column would fall below 0, within any segment between resets."""
    return first_out_of_range(ops, keys, "uint", value, order, bucket).where("failure = 'Underflow'").drop("failure")


def sequential(ops: DataFrame, keys: list[str], start: Column, step, order: str = "ord") -> DataFrame:
    """Any fold as a higher-order aggregate over a key's ops in order: (keys, state)."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *[c for c in ops.columns if c not in (*keys, order)])))
    return ops.groupBy(*keys).agg(ordered.alias("_ops")).select(*keys, F.aggregate("_ops", start, step).alias("state"))

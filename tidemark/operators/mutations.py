"""Row mutations as a builder, and projections written as Python steps.

A step turns one event into mutations of rows and may read the rows of its scope as all earlier mutations left them.
Scopes run in parallel. Within a scope the events come sorted, in Arrow batches, and only the scope's rows are held,
never its events. Prefer the closed forms in ``fold`` where a column has one: they need no order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import interpreter
from tidemark.functions.workers import reach


@dataclass
class Row:
    """Operations on the row with a key, in the order of the calls."""

    key: tuple
    ops: list[dict] = field(default_factory=list)

    def _add(self, op: str, **args: object) -> Row:
        self.ops.append({"op": op, **args})
        return self

    def upsert(self, **row: object) -> Row:
        return self._add("upsert", row=row)

    def delete(self) -> Row:
        return self._add("delete")

    def set(self, column: str, value: object) -> Row:
        return self._add("set", column=column, value=value)

    def add(self, column: str, by: object) -> Row:
        return self._add("add", column=column, value=by)

    def add_in(self, column: str, map_key: object, by: object) -> Row:
        return self._add("add", column=column, map_key=map_key, value=by)

    def set_add(self, column: str, value: object) -> Row:
        return self._add("set_add", column=column, value=value)

    def set_remove(self, column: str, value: object) -> Row:
        return self._add("set_remove", column=column, value=value)

    def push(self, column: str, value: object) -> Row:
        return self._add("list_push", column=column, value=value)

    def push_front(self, column: str, value: object) -> Row:
        return self._add("list_push", column=column, value=value, front=True)

    def remove(self, column: str, value: object) -> Row:
        return self._add("list_remove", column=column, value=value)

    def remove_all(self, column: str, value: object) -> Row:
        return self._add("list_remove", column=column, value=value, all=True)

    def truncate_back(self, column: str, keep: int) -> Row:
        """Keep the last ``keep`` items."""
        return self._add("list_truncate", column=column, keep=keep)

    def truncate_front(self, column: str, keep: int) -> Row:
        """Keep the first ``keep`` items."""
        return self._add("list_truncate", column=column, keep=keep, **{"from": "front"})

    def map_put(self, column: str, map_key: object, value: object) -> Row:
        return self._add("map_put", column=column, map_key=map_key, value=value)

    def map_remove(self, column: str, map_key: object) -> Row:
        return self._add("map_remove", column=column, map_key=map_key)


def sorted_by(batches: Iterator[pa.RecordBatch], scope: str = "_scope") -> Iterator[tuple[object, Iterator[dict]]]:
    """(scope, its rows) from batches sorted by scope; a scope may go on over many batches."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, key=lambda r: r[scope])


def _plain(value: object) -> object:
    return sorted(value) if isinstance(value, set) else dict(sorted(value.items())) if isinstance(value, dict) else value


def project(events: DataFrame, scope: Column, step: Callable[[dict, Callable[[tuple], dict | None]], list[Row]], keys: list[str], columns: dict[str, str], schema: str, order: str = "position") -> DataFrame:
    """The read-model rows that ``step(event, get_row)`` leaves.

    ``columns`` gives the column kinds of ``functions.interpreter``, ``schema`` the Spark types of keys and columns. An
    error of a step fails the query: nothing is skipped. Rows of different scopes must have different keys.
    """
    reach(events.sparkSession)
    given = events.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[str] = []
        for _, rows in sorted_by(batches):
            model: dict[tuple, dict] = {}
            for event in rows:
                for row in step({c: event[c] for c in given}, model.get):
                    after = interpreter.apply(columns, model.get(row.key), row.ops)
                    if after is None:
                        model.pop(row.key, None)
                    else:
                        model[row.key] = after
            out += [json.dumps({**dict(zip(keys, k)), **{c: _plain(v) for c, v in m.items()}}, default=str) for k, m in model.items()]
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pydict({"row": out})
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({"row": out})

    dealt = events.withColumn("_scope", scope).repartition("_scope").sortWithinPartitions("_scope", order)
    return dealt.mapInArrow(fold, "row string").select(F.from_json("row", schema).alias("r")).select("r.*")

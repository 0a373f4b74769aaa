"""Plain-Python meaning of the column operations: the yardstick of the compiled folds."""

from __future__ import annotations


class Underflow(ValueError):
    pass


def default_row(columns: dict[str, str]) -> dict:
    return {n: {"number": 0, "uint": 0, "set": set(), "map": {}, "list": [], "value": None}[k].copy() if k in ("set", "map", "list") else (None if k == "value" else 0) for n, k in columns.items()}


def apply(columns: dict[str, str], row: dict | None, ops: list[dict]) -> dict | None:
    """The row after ``ops``; column kinds: number, uint, set, map, list, value."""
    for op in ops:
        name = op["op"]
        if name == "delete":
            row = None
            continue
        if name == "upsert":
            row = {**default_row(columns), **op["row"]}
            continue
        row = dict(row) if row is not None else default_row(columns)
        c = op["column"]
        if name == "set":
            row[c] = op["value"]
        elif name == "add" and "map_key" in op:
            row[c] = {**row[c], op["map_key"]: row[c].get(op["map_key"], 0) + op["value"]}
        elif name == "add":
            row[c] = row[c] + op["value"]
            if columns[c] == "uint" and row[c] < 0:
                raise Underflow(c)
        elif name == "set_add":
            row[c] = row[c] | {op["value"]}
        elif name == "set_remove":
            row[c] = row[c] - {op["value"]}
        elif name == "list_push":
            row[c] = [op["value"], *row[c]] if op.get("front") else [*row[c], op["value"]]
        elif name == "list_remove":
            if op.get("all"):
                row[c] = [x for x in row[c] if x != op["value"]]
            elif op["value"] in row[c]:
                i = row[c].index(op["value"])
                row[c] = row[c][:i] + row[c][i + 1 :]
        elif name == "list_truncate":
            n = op["keep"]
            row[c] = row[c][:n] if op.get("from") == "front" else row[c][len(row[c]) - n :] if n < len(row[c]) else row[c]
        elif name == "map_put":
            row[c] = {**row[c], op["map_key"]: op["value"]}
        elif name == "map_remove":
            row[c] = {k: v for k, v in row[c].items() if k != op["map_key"]}
        else:
            raise ValueError(f"unknown operation {name}")
    return row

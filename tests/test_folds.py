import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import interpreter
from tidemark.operators import compiled, fold, log
from tidemark.schema.parser import parse

KEYS = ["key"]


def ops_of(seed, names, n=400, keys=12):
    rng = random.Random(seed)
    return [(rng.randrange(keys), i, rng.choice(names), rng.randrange(6), rng.randrange(-5, 9)) for i in range(n)]


def frame(spark, ops):
    return spark.createDataFrame(ops, "key long, ord long, op string, element long, value long")


def by_key(ops):
    out = {}
    for o in ops:
        out.setdefault(o[0], []).append(o)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_numbers_and_rows(spark, seed):
    ops = ops_of(seed, ["add", "add", "add", "set", "upsert", "delete"])
    df = frame(spark, ops)
    want = {}
    for k, own in by_key(ops).items():
        steps = [{"op": o, "column": "n", "value": v, "row": {"n": v}} for _, _, o, _, v in own]
        row = interpreter.apply({"n": "number"}, None, steps)
        if row is not None:
            want[k] = row["n"]
    got = fold.alive(df, KEYS).join(fold.number(df, KEYS), KEYS).collect()
    assert {r["key"]: r["value"] for r in got} == want


@pytest.mark.parametrize("seed", [4, 5])
def test_sets_maps_lists(spark, seed):
    ops = ops_of(seed, ["set_add", "set_remove"])
    want = {k: interpreter.apply({"s": "set"}, None, [{"op": o, "column": "s", "value": e} for _, _, o, e, _ in own])["s"] for k, own in by_key(ops).items()}
    got = {r["key"]: set(r["elements"]) for r in fold.members(frame(spark, ops), KEYS).collect()}
    assert got == {k: v for k, v in want.items() if v}

    ops = ops_of(seed, ["map_put", "map_remove", "add", "add"])
    want = {}
    for k, own in by_key(ops).items():
        row = interpreter.apply({"m": "map"}, None, [{"op": o, "column": "m", "map_key": e, "value": v} for _, _, o, e, v in own])
        want |= {(k, e): v for e, v in row["m"].items()}
    assert {(r["key"], r["element"]): r["value"] for r in fold.entries(frame(spark, ops), KEYS, "element").collect()} == want

    ops = ops_of(seed, ["push"])
    want = {}
    for k, own in by_key(ops).items():
        steps = [s for _, _, _, _, v in own for s in ({"op": "list_push", "column": "l", "value": v}, {"op": "list_truncate", "column": "l", "keep": 5, "from": "back"})]
        want[k] = interpreter.apply({"l": "list"}, None, steps)["l"]
    assert {r["key"]: r["items"] for r in fold.last_n(frame(spark, ops), KEYS, 5).collect()} == want


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_underflow_and_sequential(spark, seed):
    ops = ops_of(seed, ["add", "add", "add", "add", "upsert", "delete"])
    ops = [(k, i, o, e, abs(v) if o == "upsert" else v) for k, i, o, e, v in ops]
    want = {}
    for k, own in by_key(ops).items():
        row = None
        for _, i, o, _, v in own:
            try:
                row = interpreter.apply({"n": "uint"}, row, [{"op": o, "column": "n", "value": v, "row": {"n": v}}])
            except interpreter.Underflow:
                want[k] = i
                break
    assert {r["key"]: r["first_failure"] for r in fold.first_underflow(frame(spark, ops), KEYS).collect()} == want

    ops = ops_of(seed, ["list_push", "list_push", "list_remove"])
    want = {k: interpreter.apply({"l": "list"}, None, [{"op": o, "column": "l", "value": e, "all": True} for _, _, o, e, _ in own])["l"] for k, own in by_key(ops).items()}
    step = lambda s, o: F.when(o["op"] == "list_remove", F.array_remove(s, o["element"])).otherwise(F.array_append(s, o["element"]))
    got = fold.sequential(frame(spark, ops), KEYS, F.array().cast("array<bigint>"), step).collect()
    assert {r["key"]: r["state"] for r in got} == want


def test_interpreter_rules():
    """Each rule on its own, by hand."""
    run = lambda kind, start, *ops: interpreter.apply({"c": kind}, None if start is None else {"c": start}, [{"column": "c", **o} for o in ops])
    assert run("number", None, {"op": "add", "value": 3}, {"op": "set", "value": 10}, {"op": "add", "value": -4}) == {"c": 6}
    assert run("value", "old", {"op": "delete"}) is None
    assert run("value", "old", {"op": "delete"}, {"op": "upsert", "row": {}}) == {"c": None}
    assert run("set", {1}, {"op": "set_add", "value": 2}, {"op": "set_remove", "value": 1}, {"op": "set_remove", "value": 7}) == {"c": {2}}
    assert run("map", {"x": 5}, {"op": "add", "map_key": "x", "value": 1}, {"op": "add", "map_key": "y", "value": 2}, {"op": "map_remove", "map_key": "x"}) == {"c": {"y": 2}}
    assert run("list", [7], {"op": "list_push", "value": 8, "front": True}, {"op": "list_push", "value": 7}, {"op": "list_remove", "value": 7}) == {"c": [8, 7]}
    assert run("list", [4, 5, 4, 6], {"op": "list_remove", "value": 4, "all": True}, {"op": "list_truncate", "keep": 1, "from": "front"}) == {"c": [5]}
    assert run("list", [4, 5, 6], {"op": "list_truncate", "keep": 2, "from": "back"}, {"op": "list_truncate", "keep": 9, "from": "back"}) == {"c": [5, 6]}
    with pytest.raises(interpreter.Underflow):
        run("uint", 2, {"op": "add", "value": -3})


@pytest.mark.parametrize("seed", [11, 12, 13, 14])
def test_every_column_starts_anew_with_its_row(spark, seed):
    resets = ["upsert", "delete", "set"]
    ops = ops_of(seed, ["set_add", "set_add", "set_remove", *resets])
    rows = [(*o, [o[3], 9]) for o in ops]
    df = spark.createDataFrame(rows, "key long, ord long, op string, element long, value long, seed array<long>")
    want = {}
    for k, own in by_key(rows).items():
        row = interpreter.apply({"s": "set"}, None, [{"op": o, "column": "s", "value": set(g) if o == "set" else e, "row": {"s": set(g)}} for _, _, o, e, _, g in own])
        want |= {k: row["s"]} if row and row["s"] else {}
    assert {r["key"]: set(r["elements"]) for r in fold.members(df, KEYS, seed="seed").collect()} == want

    ops = ops_of(seed, ["map_put", "map_remove", "add", "add", *resets])
    rows = [(*o, {o[3]: 5, 9: 1}) for o in ops]
    df = spark.createDataFrame(rows, "key long, ord long, op string, element long, value long, seed map<long,long>")
    want = {}
    for k, own in by_key(rows).items():
        row = interpreter.apply({"m": "map"}, None, [{"op": o, "column": "m", "value": dict(g) if o == "set" else v, "row": {"m": dict(g)}, **({} if o in resets else {"map_key": e})} for _, _, o, e, v, g in own])
        want |= {(k, e): v for e, v in (row or {"m": {}})["m"].items()}
    assert {(r["key"], r["element"]): r["value"] for r in fold.entries(df, KEYS, "element", seed="seed").collect()} == want

    ops = ops_of(seed, ["list_push", "list_push", "list_push", "upsert", "delete"])
    for front in (False, True):
        want = {}
        for k, own in by_key(ops).items():
            steps = [s for _, _, o, _, v in own for s in ([{"op": "list_push", "column": "l", "value": v, "front": front}, {"op": "list_truncate", "column": "l", "keep": 4, "from": "front" if front else "back"}] if o == "list_push" else [{"op": o, "row": {}}])]
            row = interpreter.apply({"l": "list"}, None, steps)
            want |= {k: row["l"]} if row and row["l"] else {}
        assert {r["key"]: r["items"] for r in fold.last_n(frame(spark, ops), KEYS, 4, front=front).collect()} == want

    ops = ops_of(seed, ["set", "add", "upsert", "delete"])
    want = {}
    for k, own in by_key(ops).items():
        row = interpreter.apply({"v": "value", "n": "number"}, None, [{"op": o, "column": "n" if o == "add" else "v", "value": v, "row": {"v": v}} for _, _, o, _, v in own])
        want[k] = row and row["v"]
    assert {r["key"]: r["value"] for r in fold.latest(frame(spark, ops), KEYS).collect()} == want
    assert {r["key"] for r in fold.alive(frame(spark, ops), KEYS).collect()} == {k for k, own in by_key(ops).items() if own[-1][2] != "delete"}


TABLE = """
layer derivation
projection A.Board {
  from A.E
  fold wasm "a.wasm"
  table board { key id: int, n: int, left: uint = 7, paid: decimal, name: string?, tags: set<int>, spent: map<string, decimal>, notes: map<int, string>, recent: [string] }
}
"""


def random_ops(rng, n, keys):
    """(op rows of a frame, the same ops for the interpreter), by key."""
    rows, plain = [], {}
    for i in range(n):
        k, v, e = rng.randrange(keys), rng.randrange(1, 9), rng.randrange(5)
        text = rng.choice([f"{v}", f"{v}.50", f"{v}.125"])
        spent, tags = {f"c{e}": text}, [e, 8]
        full = {"n": v, "paid": text, "name": f"x{e}", "tags": tags, "spent": spent, "recent": ["u"]}
        choice = rng.choice(["upsert", "delete", "part", "set n", "add n", "add left", "add paid", "set name", "set tags", "set_add", "set_remove", "set spent", "add spent", "map_put", "map_remove", "put note", "push", "front", "remove", "all", "truncate", "first"])
        dec = lambda t: Decimal(t)
        frame_row = {
            "upsert": ("upsert", None, None, None, json.dumps(full)), "part": ("upsert", None, None, None, json.dumps({"n": v})), "delete": ("delete", None, None, None, None),
            "set n": ("set", "n", str(v), None, None), "add n": ("add", "n", str(-v), None, None), "add left": ("add", "left", str(v), None, None), "add paid": ("add", "paid", text, None, None),
            "set name": ("set", "name", f"y{e}", None, None), "set tags": ("set", "tags", json.dumps(tags), None, None), "set_add": ("set_add", "tags", str(e), None, None), "set_remove": ("set_remove", "tags", str(e), None, None),
            "set spent": ("set", "spent", json.dumps(spent), None, None), "add spent": ("add", "spent", text, f"c{e}", None), "map_put": ("map_put", "spent", text, f"c{e}", None), "map_remove": ("map_remove", "spent", None, f"c{e}", None),
            "put note": ("map_put", "notes", f"z{v}", str(e), None), "push": ("list_push", "recent", f"r{e}", None, None), "front": ("list_push", "recent", f"f{e}", None, None), "remove": ("list_remove", "recent", f"r{e}", None, None),
            "all": ("list_remove", "recent", f"r{e}", None, None), "truncate": ("list_truncate", "recent", None, None, None), "first": ("list_truncate", "recent", None, None, None),
        }[choice]
        rows.append((k, i, *frame_row, choice == "front", choice == "all", 3, "front" if choice == "first" else "back"))
        start = {"left": 7, "paid": dec("0")}
        step = {
            "upsert": {"op": "upsert", "row": {**start, "n": v, "paid": dec(text), "name": f"x{e}", "tags": set(tags), "spent": {a: dec(b) for a, b in spent.items()}, "recent": ["u"]}}, "part": {"op": "upsert", "row": {**start, "n": v}}, "delete": {"op": "delete"},
            "set n": {"op": "set", "column": "n", "value": v}, "add n": {"op": "add", "column": "n", "value": -v}, "add left": {"op": "add", "column": "left", "value": v}, "add paid": {"op": "add", "column": "paid", "value": dec(text)},
            "set name": {"op": "set", "column": "name", "value": f"y{e}"}, "set tags": {"op": "set", "column": "tags", "value": set(tags)}, "set_add": {"op": "set_add", "column": "tags", "value": e}, "set_remove": {"op": "set_remove", "column": "tags", "value": e},
            "set spent": {"op": "set", "column": "spent", "value": {a: dec(b) for a, b in spent.items()}}, "add spent": {"op": "add", "column": "spent", "map_key": f"c{e}", "value": dec(text)}, "map_put": {"op": "map_put", "column": "spent", "map_key": f"c{e}", "value": dec(text)}, "map_remove": {"op": "map_remove", "column": "spent", "map_key": f"c{e}"},
            "put note": {"op": "map_put", "column": "notes", "map_key": e, "value": f"z{v}"}, "push": {"op": "list_push", "column": "recent", "value": f"r{e}"}, "front": {"op": "list_push", "column": "recent", "value": f"f{e}", "front": True}, "remove": {"op": "list_remove", "column": "recent", "value": f"r{e}"},
            "all": {"op": "list_remove", "column": "recent", "value": f"r{e}", "all": True}, "truncate": {"op": "list_truncate", "column": "recent", "keep": 3, "from": "back"}, "first": {"op": "list_truncate", "column": "recent", "keep": 3, "from": "front"},
        }[choice]
        plain.setdefault(k, []).append(step)
    return rows, plain


@pytest.mark.parametrize("seed", [21, 22])
def test_a_table_of_the_schema_against_the_interpreter(spark, seed):
    kinds = {"n": "number", "left": "number", "paid": "number", "name": "value", "tags": "set", "spent": "map", "notes": "map", "recent": "list"}
    rows, plain = random_ops(random.Random(seed), 1500, 40)
    df = spark.createDataFrame(rows, "id long, ord long, op string, column string, value string, map_key string, row string, front boolean, all boolean, keep int, from_end string")
    got = {r["id"]: r.asDict() for r in compiled.fold_table(df, parse(TABLE).projections["A.Board"].tables["board"]).collect()}
    want = {}
    for k, steps in plain.items():
        row = None
        for s in steps:  # the table's defaults for rows that an op makes
            if s["op"] not in ("delete", "upsert") and row is None:
                row = {**interpreter.default_row(kinds), "left": 7, "paid": Decimal(0)}
            row = interpreter.apply(kinds, row, [s])
        if row is not None:
            want[k] = row
    assert set(got) == set(want) and len(want) < len(plain)
    for k, w in want.items():
        g = got[k]
        assert (g["n"], g["left"], g["name"], set(g["tags"]), g["recent"], g["notes"]) == (w["n"], w["left"], w["name"], w["tags"], w["recent"], w["notes"])
        # equal numbers of equal scale
        assert (g["paid"], {a: b for a, b in g["spent"].items()}) == (str(w["paid"]), {a: str(b) for a, b in w["spent"].items()})
        assert g["tags"] == sorted(g["tags"]) and list(g["notes"]) == sorted(g["notes"])


def test_failures_of_a_column(spark):
    rows = [(1, 0, "add", "5"), (1, 1, "add", "-6"), (2, 0, "upsert", "9223372036854775807"), (2, 1, "add", "1"), (2, 2, "add", "-5"), (3, 0, "set", "3"), (3, 1, "delete", None), (3, 2, "add", "-1")]
    df = spark.createDataFrame(rows, "key long, ord long, op string, value string").withColumn("value", F.col("value").cast("decimal(38,0)"))
    find = lambda kind: {r["key"]: (r["first_failure"], r["failure"]) for r in fold.first_out_of_range(df, KEYS, kind).collect()}
    assert find("uint") == {1: (1, "Underflow"), 3: (2, "Underflow")}
    assert find("int") == {2: (1, "Overflow")}
    table = parse('layer derivation projection A.P { from A.E fold wasm "a.wasm" table p { key id: int, name: string } }').projections["A.P"].tables["p"]
    ops = spark.createDataFrame([(1, 0, "upsert", None, None, "{}")], "id long, ord long, op string, column string, value string, row string")
    with pytest.raises(Exception, match="NoDefault"):
        compiled.fold_table(ops, table).collect()


def test_reads(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", "A.B" if i % 2 else "A.C", 1 + i % 2) for i in range(20)], "position long, stream_id string, family string, type_version int")
    assert [r.position for r in log.read_all_backward(rows, 100, 3).collect()] == [19, 18, 17]
    assert [r.position for r in log.read_stream(rows, "s1", 2, True).collect()] == [7, 4, 1]
    assert log.read_by_type(rows, "A.B", 3, 2, 1).count() == 0
    with pytest.raises(log.PositionOutOfRange):
        log.check_from(rows, 21)
    log.check_from(rows, 20)
    assert log.next_position(rows.limit(0)) == 0
    with pytest.raises(ValueError):
        log.scan(rows, ["stream_id", "family"], {"family": "A.B"})
    assert log.scan(rows, ["stream_id", "family"], {"stream_id": "s0"}, 2).count() == 2

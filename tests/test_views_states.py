"""Typed views, steps in Python, aggregate states and their snapshots, start-up checks, key bytes."""

import json
import random
import struct
import sys
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import interpreter, upcasts, values
from tidemark.functions.errors import FailedPrecondition, NotFound, Unavailable
from tidemark.operators.mutations import Row, project
from tidemark.schema import startup
from tidemark.schema.parser import parse
from tidemark.sources.store import Event, LogStore
from tidemark.streaming.app import Aggregate
from tidemark.streaming.states import States

#: The workers cannot import this module; its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOMAIN = """
layer domain
context Orders {
  value Money { amount: decimal, currency: string = "EUR" }
  event Placed v1 { id: string, total: Money, n: int, lines: [Money], old: string? }
  event Placed v2 { id: string, total: Money, qty: int, lines: [Money], note: string } upcast from v1 { rename n as qty, set note: "legacy" }
  event Placed v3 { id: string, total: Money, qty: int, lines: [Money], note: string = "none", label: string } upcast from v2 wasm "up.wasm"
  aggregate Order { key id: uint  stream "order-{id}"  events Placed }
}
"""


def label(p):
    return {**p, "label": f"{p['id']}:{p['qty']}"}


def test_typed_view(spark):
    money = {"amount": "1.50"}
    rows = [
        (0, "order-1", "Orders.Placed", 1, json.dumps({"id": "a", "total": money, "n": 3, "lines": [money, {"amount": "2", "currency": "USD"}]})),
        (1, "order-2", "Orders.Placed", 2, json.dumps({"id": "b", "total": money, "qty": 4, "lines": [], "note": "new"})),
        (2, "order-3", "Orders.Placed", 3, json.dumps({"id": "c", "total": money, "qty": 5, "lines": [], "label": "own"})),
        (3, "order-3", "Orders.Other", 9, "{}"),
    ]
    log = spark.createDataFrame(rows, "position bigint, stream_id string, family string, type_version int, payload string")
    got = [r["event"].asDict(True) for r in upcasts.typed_view(log, parse(DOMAIN), "Orders.Placed", {"up.wasm": label}).orderBy("position").collect()]
    eur = {"amount": Decimal("1.5"), "currency": "EUR"}
    assert got == [
        {"id": "a", "total": eur, "qty": 3, "lines": [eur, {"amount": Decimal(2), "currency": "USD"}], "note": "legacy", "label": "a:3"},
        {"id": "b", "total": eur, "qty": 4, "lines": [], "note": "new", "label": "b:4"},
        {"id": "c", "total": eur, "qty": 5, "lines": [], "note": "none", "label": "own"},
    ]
    with pytest.raises(KeyError):
        upcasts.typed_view(log, parse(DOMAIN), "Orders.Placed")
    odd = log.withColumn("type_version", F.lit(7))
    with pytest.raises(PySparkException):
        upcasts.typed_view(odd, parse(DOMAIN), "Orders.Placed", {"up.wasm": label}).collect()


COLUMNS = {"n": "number", "tags": "set", "recent": "list", "by": "map"}


def step(event, get_row):
    key = (event["key"],)
    if event["kind"] == "drop":
        return [Row(key).delete()]
    seen = get_row(key)
    row = Row(key).add("n", 1).set_add("tags", event["tag"]).push("recent", event["tag"]).truncate_back("recent", 2)
    row = row.add_in("by", event["tag"], event["position"])
    if seen and event["kind"] == "cut":
        row.remove_all("recent", event["tag"]).set_remove("tags", event["tag"])
    return [row]


def test_project_equals_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice(["a", "a", "b", None]), rng.choice(["put", "put", "cut", "drop"]), rng.choice("xyz")) for p in range(200)]
    df = spark.createDataFrame(rows, "position bigint, key string, kind string, tag string").repartition(4)
    schema = "key string, n bigint, tags array<string>, recent array<string>, by map<string,bigint>"
    got = project(df, F.col("key"), step, ["key"], COLUMNS, schema)
    model = {}
    for p, k, kind, tag in rows:
        for m in step({"position": p, "key": k, "kind": kind, "tag": tag}, model.get):
            after = interpreter.apply(COLUMNS, model.get(m.key), m.ops)
            model.pop(m.key, None) if after is None else model.__setitem__(m.key, after)
    want = {k[0]: {"key": k[0], "n": m["n"], "tags": sorted(m["tags"]), "recent": m["recent"], "by": m["by"]} for k, m in model.items()}
    assert {r["key"]: r.asDict() for r in got.collect()} == want
    assert project(df.limit(0), F.col("key"), step, ["key"], COLUMNS, schema).count() == 0
    with pytest.raises(PySparkException):
        project(df, F.col("key"), lambda e, g: 1 / 0, ["key"], COLUMNS, schema).collect()


def evolve(state, family, p):
    return {"n": (state["n"] if state else 0) + p["qty"]}


def evolve_twice(state, family, p):
    return {"n": (state["n"] if state else 0) + 2 * p["qty"]}


@pytest.fixture
def store(spark, tmp_path):
    s = LogStore.create(spark, f"file://{tmp_path}/log")
    for i in range(6):
        s.append(f"order-{i % 3}", "any", [Event("Orders.Placed", {"qty": i})])
    s.append("order-007", "any", [Event("Orders.Placed", {"qty": 1})])
    return s


def states_of(s, base=None):
    return {r["stream_id"]: (r["stream_version"], json.loads(r["state"])["n"]) for r in s.states(None, base).collect()}


def test_states_and_snapshots(store, tmp_path):
    a = Aggregate("Order", "order-{id}", ["Orders.Placed"], evolve)
    s = States(store, a, f"file://{tmp_path}/agg", "uint")
    first = s.refresh()
    assert s.refresh() == first and first["next"] == 7
    store.append("order-1", "any", [Event("Orders.Placed", {"qty": 10})])
    store.append("order-9", "any", [Event("Orders.Placed", {"qty": 3})])
    want = {"order-0": (1, 3), "order-1": (2, 15), "order-2": (1, 7), "order-9": (0, 3)}
    assert states_of(s, s.last()) == states_of(s) == want
    assert s.get("1")[:2] == ({"n": 15}, 2) and s.get("5")[:2] == (None, None)
    with pytest.raises(Unavailable):
        s.get("1", 3)
    with pytest.raises(FailedPrecondition):
        s.check()
    second = s.refresh()
    assert [x["next"] for x in s.snapshots()] == [7, 9]
    store.truncate(8)  # the second snapshot has seen what is gone
    assert s.last() == first and s.get("9")[:2] == (None, None)
    s.drop(second["name"])
    with pytest.raises(NotFound):
        s.drop(second["name"])
    # other code: no snapshot holds
    t = States(store, Aggregate("Order", "order-{id}", ["Orders.Placed"], evolve_twice), f"file://{tmp_path}/agg", "uint")
    assert t.last() is None and t.get("1")[:2] == ({"n": 30}, 2)
    s.clear()
    assert s.snapshots() == []


def test_start_up(store, tmp_path):
    first = startup.start_domain(store, DOMAIN)
    assert first.changes == [] and startup.start_domain(store, DOMAIN).digest == first.digest
    less = DOMAIN.replace("event Placed v1 { id: string, total: Money, n: int, lines: [Money], old: string? }", "event Placed v1 { id: string, total: Money, n: int, old: string? }")
    with pytest.raises(FailedPrecondition):
        startup.start_domain(store, less)
    assert startup.start_domain(store, less, force=True).changes
    derive = 'layer derivation\nstate Orders.Order { n: int } evolve wasm "a.wasm" export "e"\nprojection Totals { from Orders.Placed fold wasm "a.wasm" table t { key id: string, n: int } }\n'
    calls = []
    acts = [lambda n, k=k: calls.append((k, n)) for k in ("rebuild", "drop", "clear")]
    startup.start_derivation(store, derive, f"file://{tmp_path}/models", *acts)
    assert calls == []
    done = startup.start_derivation(store, derive.replace("n: int }", "n: string }"), f"file://{tmp_path}/models", *acts)
    assert sorted(calls) == [("clear", "Orders.Order"), ("rebuild", "Totals")] and len(done.done) == 2
    startup.start_derivation(store, "layer derivation\n", f"file://{tmp_path}/models", *acts)
    assert ("drop", "Totals") in calls
    assert startup.check_registrations(DOMAIN, {"Place": "Order", "Bad": "None"}, {"p": ["Orders.Placed", "Orders.Gone"]}) == ["command Bad: no aggregate None", "process p: no event Orders.Gone"]


def test_key_bytes(spark):
    ints = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    df = spark.createDataFrame([(i, str(abs(i) * 2), "é" + str(i)) for i in ints], "i bigint, u string, s string")
    got = df.select(values.key_bytes("int", F.col("i")).alias("i"), values.key_bytes("uint", F.col("u").cast("decimal(20,0)")).alias("u"), values.key_bytes("string", F.col("s")).alias("s")).where("u is not null").collect()
    assert [bytes(r["i"]) for r in got] == [struct.pack(">Q", i + 2**63) for i in ints]
    assert [bytes(r["u"]) for r in got] == [struct.pack(">Q", abs(i) * 2) if abs(i) * 2 < 2**64 else bytes(r["u"]) for i, r in zip(ints, got)]
    assert [bytes(r["s"]) for r in got] == [("é" + str(i)).encode() + b"\0" for i in ints]

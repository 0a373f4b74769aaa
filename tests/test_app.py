import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.errors import FailedPrecondition, Failure, InvalidArgument, NotFound, Unavailable
from tidemark.sources.store import Event, LogStore, parse_token
from tidemark.streaming.app import Aggregate, App, ContextInvariant, Process, ProcessRunner, Reaction, Rejected
from tidemark.streaming.runner import Projection, Runner


def evolve(state, family, p):
    if family == "Orders.OrderPlaced":
        return {"customer": p["customer"], "status": "Pending", "lines": p["lines"]}
    return {**state, "status": "Cancelled"}


def ship(state, family, p):
    return {"status": "Prepared" if family == "Shipping.Prepared" else "Shipped"}


@pytest.fixture
def app(spark, tmp_path):
    store = LogStore.create(spark, f"file://{tmp_path}/log", "orders")
    app = App(store)
    app.aggregate(Aggregate("Order", "order-{id}", ["Orders.OrderPlaced", "Orders.OrderCancelled"], evolve, [("AtMostThree", "TOO_MANY_LINES", lambda s: s["lines"] <= 3)]))
    app.aggregate(Aggregate("Shipment", "shipment-{id}", ["Shipping.Prepared"], ship))

    @app.command("Place", "Order")
    def place(state, p):
        if state is not None:
            raise Rejected("ALREADY_PLACED")
        return [Event("Orders.OrderPlaced", p)]

    @app.command("Cancel", "Order")
    def cancel(state, p):
        if state is None:
            raise Rejected("NOT_PLACED")
        return [] if state["status"] == "Cancelled" else [Event("Orders.OrderCancelled", {"order": p["order"]})]

    @app.command("Prepare", "Shipment")
    def prepare(state, p):
        if p["order"] == "bad":
            raise Rejected("NO_STOCK")
        return [Event("Shipping.Prepared", p)]

    app.command("Break", "Order")(lambda state, p: 1 / 0)
    app.command("Foreign", "Order")(lambda state, p: [Event("Shipping.Prepared", p)])

    def fold(events):
        p = lambda n: F.get_json_object("payload", f"$.{n}")
        return events.groupBy(p("customer").alias("customer")).agg(F.count(F.lit(1)).alias("placed"))

    run = Runner(store, Projection("by_customer", ["Orders.OrderPlaced"], "customer string, placed bigint", fold, lambda a, b: a.unionByName(b).groupBy("customer").agg(F.sum("placed").alias("placed"))), f"file://{tmp_path}/models")
    app.context.append(ContextInvariant("MaxOrders", "MAX_ORDERS", run, ["Orders.OrderPlaced"], lambda p: {"customer": p["customer"]}, lambda row, new: (row["placed"] if row else 0) + len(new) <= 2))
    return app


def order(i, customer="ada", lines=1):
    return {"order": i, "customer": customer, "lines": lines}


def test_commands(app):
    t = app.execute("Place", "a", order("a"), "k1")
    assert parse_token(t) == ("orders", 1, 0)
    assert app.execute("Place", "a", order("a"), "k1") == t and app.store.head == 1  # the same key appends once
    for command, key, p, code, invariant in [("Place", "a", order("a"), "ALREADY_PLACED", None), ("Cancel", "zz", {"order": "zz"}, "NOT_PLACED", None), ("Place", "b", order("b", lines=4), "TOO_MANY_LINES", "AtMostThree")]:
        with pytest.raises(Rejected) as e:
            app.execute(command, key, p)
        assert (e.value.code, e.value.invariant) == (code, invariant)
    app.execute("Cancel", "a", {"order": "a"})
    assert parse_token(app.execute("Cancel", "a", {"order": "a"}))[2] == 1  # nothing to do is success
    app.execute("Place", "b", order("b"))
    with pytest.raises(Rejected) as e:
        app.execute("Place", "c", order("c"))
    assert (e.value.code, e.value.invariant) == ("MAX_ORDERS", "MaxOrders")
    with pytest.raises(Rejected):
        app.append("Order", "c", [Event("Orders.OrderPlaced", order("c"))])
    app.append("Order", "d", [Event("Orders.OrderPlaced", order("d", "bob"))])
    for command in ("Break", "Foreign"):
        with pytest.raises(Failure):
            app.execute(command, "q", {})
    with pytest.raises(NotFound):
        app.execute("Nope", "q", {})
    with pytest.raises(InvalidArgument):
        app.append("Order", "q", [])
    assert app.load(app.aggregates["Order"], "order-a") == (1, {"customer": "ada", "status": "Cancelled", "lines": 1})


def test_conflict_is_tried_once_more(app):
    calls = []

    @app.command("Race", "Order")
    def race(state, p):
        calls.append(state)
        if len(calls) == 1:
            app.store.append("order-r", "any", [Event("Orders.OrderPlaced", order("r"))])
        return [Event("Orders.OrderCancelled", {"order": "r"})] if state else [Event("Orders.OrderPlaced", order("r"))]

    app.execute("Race", "r", {})
    assert calls[0] is None and calls[1]["status"] == "Pending" and app.store.head == 2


def reaction():
    """A local function, so that workers get it by value."""

    def react(state, t):
        p = t["payload"]
        if t["kind"] == "timer":
            return Reaction({**state, "step": "overdue"}, [("Cancel", state["order"], {"order": state["order"]})])
        if t["kind"] == "rejected":
            return Reaction({**state, "step": p["code"]}, cancel=["late"])
        if t["family"] == "Orders.OrderPlaced":
            return Reaction({"order": p["order"], "step": "requested"}, [("Prepare", p["order"], {"order": p["order"]})], [("late", 1000)])
        if t["family"] == "Shipping.Prepared":
            return Reaction({**state, "step": "prepared"})
        return Reaction(None)

    return react


def test_process_with_timers(app, tmp_path):
    process = Process("fulfilment", {"Orders.OrderPlaced": "order", "Shipping.Prepared": "order", "Orders.OrderCancelled": "order"}, reaction(), ("late",))
    run = ProcessRunner(app, process, f"file://{tmp_path}/processes")
    steps = lambda: {r.pkey: json.loads(r.state)["step"] for r in run.instances().collect()}
    app.execute("Place", "x", order("x", "ada"))
    app.execute("Place", "bad", order("bad", "bob"))
    assert run.run() == 1  # one prepared, one rejected
    assert steps() == {"x": "requested", "bad": "requested"}
    assert run.dispatch() == 0  # sent before
    run.run()
    assert steps() == {"x": "prepared", "bad": "NO_STOCK"}
    due = max(v for r in run.instances().collect() for v in json.loads(r.timers).values())
    assert run.fire(due - 1) == 0
    assert run.fire(due) == 1 and run.fire(due) == 0  # the rejected order's timer was cancelled
    run.run()
    run.run()
    assert steps() == {"bad": "NO_STOCK"}  # the overdue order was cancelled, which ends its instance
    assert app.load(app.aggregates["Order"], "order-x")[1]["status"] == "Cancelled"
    # what was rejected is no event: every event of the log is one that a command made, or a fired timer
    assert {r.family for r in app.store.events().select("family").distinct().collect()} == {"Orders.OrderPlaced", "Orders.OrderCancelled", "Shipping.Prepared", "System.TimerFired"}


def test_commands_outlive_a_failure(app, tmp_path):
    process = Process("fulfilment", {"Orders.OrderPlaced": "order", "Shipping.Prepared": "order"}, reaction(), ("late",))
    waits = []
    run = ProcessRunner(app, process, f"file://{tmp_path}/processes", sleep=waits.append)
    for i, who in (("a", "ada"), ("b", "bob"), ("c", "cleo")):
        app.execute("Place", i, order(i, who))
    name, handler = app.commands["Prepare"]
    app.commands["Prepare"] = (name, lambda state, p: 1 / 0 if p["order"] == "b" else handler(state, p))
    with pytest.raises(Failure):
        run.run()
    assert run.checkpoint()["pending"] and app.store.events().where("family = 'Shipping.Prepared'").count() == 1
    app.execute("Place", "d", order("d", "dan"))  # the head moves on meanwhile
    with pytest.raises(Failure):
        run.run()
    app.commands["Prepare"] = (name, handler)
    assert run.run() == 3  # the two that were left, and the new one
    assert sorted(json.loads(r.payload)["order"] for r in app.store.events().where("family = 'Shipping.Prepared'").collect()) == ["a", "b", "c", "d"]
    assert run.checkpoint()["pending"] == [] and run.dispatch() == 0

    def busy(state, p):
        if len(waits) < 2:
            raise Unavailable("later")
        return handler(state, p)

    app.commands["Prepare"] = (name, busy)
    app.execute("Place", "e", order("e", "eve"))
    assert run.run() == 1 and waits == [0.5, 1.0]


def test_a_process_starts_anew_after_a_cut(app, tmp_path):
    process = Process("fulfilment", {"Orders.OrderPlaced": "order", "Shipping.Prepared": "order"}, reaction(), ("late",))
    run = ProcessRunner(app, process, f"file://{tmp_path}/processes")
    app.execute("Place", "a", order("a"))
    run.run()
    run.run()
    assert app.store.head == 2
    app.store.truncate(1)  # takes away what was prepared
    assert run.run() == 1 and app.store.head == 2
    assert [json.loads(r.state)["step"] for r in run.instances().collect()] == ["requested"]


def test_an_invariant_holds_when_its_events_are_written(app):
    app.execute("Place", "a", order("a"))
    (inv,) = app.context
    holds, calls = inv.holds, []

    def slow(row, new):
        if not calls:  # another writer comes in after the check, on another stream
            calls.append(app.store.append("order-z", "no_stream", [Event("Orders.OrderPlaced", order("z"))]))
            return True
        return holds(row, new)

    app.context[:] = [ContextInvariant(inv.name, inv.code, inv.runner, inv.families, inv.scope, slow)]
    with pytest.raises(Rejected) as e:
        app.execute("Place", "b", order("b"))
    assert e.value.code == "MAX_ORDERS" and app.store.head == 2


def test_half_written_files_are_not_seen(app):
    app.execute("Place", "a", order("a"))
    store = app.store
    out = store.fs.create(store._jpath(f"{store.path}/manifests/.0123.part"), False)  # a writer died here
    out.close()
    assert store.head == 1 and app.execute("Place", "b", order("b", "bob"))
    with pytest.raises(FailedPrecondition):  # of two writers of one number the second fails, and the first's file stays
        store._commit({**store.manifest(), "head": 99})
    assert store.head == 2

"""A node's verbs, by Python and by the command line: snapshots of projections, rebuilds, scans, health."""

import json

import pytest

from tidemark import cli
from tidemark.functions.errors import FailedPrecondition, InvalidArgument, NotFound, Unavailable
from tidemark.streaming.node import load

NODE = '''
from pyspark.sql import functions as F
from tidemark.sources.store import Event, LogStore
from tidemark.streaming.app import Aggregate, App, Rejected
from tidemark.streaming.node import Node
from tidemark.streaming.runner import Projection, Runner
from tidemark.streaming.states import States


def evolve(state, family, p):
    return {"n": (state["n"] if state else 0) + p["by"]}


def make(spark, path):
    try:
        store = LogStore.create(spark, path + "/log", "counters")
    except Exception:
        store = LogStore(spark, path + "/log")
    app = App(store)
    a = Aggregate("Counter", "counter-{id}", ["C.Moved"], evolve, [("Low", "TOO_HIGH", lambda s: s["n"] <= 100)])
    app.aggregate(a)
    app.command("Move", "Counter")(lambda state, p: [Event("C.Moved", p)])
    by = F.get_json_object("payload", "$.by").cast("long")
    fold = lambda e: e.groupBy("stream_id", (by % 2).alias("odd")).agg(F.sum(by).alias("n"))
    merge = lambda x, y: x.unionByName(y).groupBy("stream_id", "odd").agg(F.sum("n").alias("n"))
    run = Runner(store, Projection("sums", ["C.Moved"], "stream_id string, odd bigint, n bigint", fold, merge), path + "/models")
    return Node(store, app, {"sums": run}, {"sums": ["stream_id", "odd"]}, {"Counter": States(store, a, path + "/states", "uint")})
'''


@pytest.fixture
def place(tmp_path):
    (tmp_path / "counter_node.py").write_text(NODE)
    return f"{tmp_path}/counter_node.py:make", f"file://{tmp_path}/data"


def test_node(spark, place):
    n = load(spark, *place)
    at = ""
    for i in range(5):
        at = n.exec("Move", str(i % 2), {"by": i}, f"move-{i}")
    assert n.exec("Move", "0", {"by": 4}, "move-4") == at
    row, read = n.get("sums", {"stream_id": "counter-0", "odd": 0}, at)
    assert row["n"] == 6 and read == at
    with pytest.raises(InvalidArgument):
        n.get("sums", {"stream_id": "counter-0"})
    with pytest.raises(NotFound):
        n.get("none", {})
    assert [r["n"] for r in n.scan("sums", {"stream_id": "counter-1"})[0].collect()] == [4]
    assert [r["stream_id"] for r in n.scan("sums", limit=1)[0].collect()] == ["counter-0"]
    assert n.aggregate("Counter", "1")[:2] == ({"n": 4}, 1)
    run = n.projections["sums"]
    with pytest.raises(Unavailable):
        run._wait(at.rsplit(":", 1)[0] + ":99", 0.2)

    kept = n.snapshot("sums")
    assert n.snapshot("sums") == kept and n.snapshot("Counter")["next"] == 5
    n.exec("Move", "7", {"by": 9})
    n.catch_up()
    whole = sorted(map(str, run.table().collect()))
    assert n.rebuild("sums", kept["name"]) == 6 and sorted(map(str, run.table().collect())) == whole
    assert n.rebuild("sums") == 6 and sorted(map(str, run.table().collect())) == whole
    assert run.vacuum() >= 1 and sorted(map(str, run.table().collect())) == whole
    assert [s["name"] for s in n.snapshots("sums")] == [kept["name"]] and n.rebuild("Counter") == 6
    health = {r["layer"]: r for r in n.health()}
    assert health["projection"]["behind"] == 0 and health["log"]["head"] == 6 and health["aggregate"]["snapshots"] == 2

    n.store.truncate(4)
    with pytest.raises(FailedPrecondition):
        n.rebuild("sums", kept["name"])
    assert n.rebuild("sums") == 4
    n.drop_snapshot("sums", kept["name"])
    with pytest.raises(NotFound):
        n.drop_snapshot("sums", kept["name"])
    run.drop()
    assert run.checkpoint()["next"] == 0


def test_command_line(spark, place, capsys):
    where, path = place

    def call(*words):
        code = cli.main(["node", where, path, *words])
        return code, capsys.readouterr().out.strip()

    code, at = call("exec", "Move", "3", '{"by": 8}')
    assert code == 0 and call("exec", "Move", "3", '{"by": 800}')[0] == 1
    assert json.loads(call("get", "sums", '{"stream_id": "counter-3", "odd": 0}', "--token", at)[1])["row"]["n"] == 8
    assert json.loads(call("aggregate", "Counter", "3")[1])["state"] == {"n": 8}
    assert json.loads(call("scan", "sums")[1])["n"] == 8
    assert json.loads(call("snapshot", "sums")[1])["next"] == 1 and call("rebuild", "sums")[1] == "1"
    assert len(call("health")[1].splitlines()) == 3 and call("get", "none", "{}")[0] == 1

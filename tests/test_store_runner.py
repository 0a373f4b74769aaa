import pytest
from pyspark.sql import functions as F

from tidemark.functions.errors import AlreadyExists, FailedPrecondition, InvalidArgument, PermissionDenied, Unavailable
from tidemark.operators import log
from tidemark.sources.store import Event, LogStore, parse_token, token
from tidemark.streaming.runner import Projection, Runner


def add(n, family="Counter.Added"):
    return Event(family, {"n": n})


@pytest.fixture
def store(spark, tmp_path):
    return LogStore.create(spark, f"file://{tmp_path}/log", "log-a")


def counter():
    def fold(events):
        return events.groupBy("stream_id").agg(F.sum(F.get_json_object("payload", "$.n").cast("long")).alias("total"))

    def merge(old, new):
        return old.unionByName(new).groupBy("stream_id").agg(F.sum("total").alias("total"))

    return Projection("counter", ["Counter.Added"], "stream_id string, total bigint", fold, merge)


def test_append_and_read(store):
    assert store.append("a", "no_stream", [add(1), add(2)], now=10) == 1
    assert store.append("b", "any", [add(5)], key="k1", now=20) == 2
    assert store.append("a", 1, [add(3)], now=30) == 3
    rows = store.events().orderBy("position").collect()
    assert [(r.position, r.stream_id, r.stream_version, r.last_in_batch) for r in rows] == [(0, "a", 0, False), (1, "a", 1, True), (2, "b", 0, True), (3, "a", 2, True)]
    for mode, actual in (("no_stream", 2), (0, 2), (5, 2)):
        with pytest.raises(FailedPrecondition) as e:
            store.append("a", mode, [add(1)])
        assert e.value.actual == actual
    with pytest.raises(FailedPrecondition):
        store.append("zzz", "stream_exists", [add(1)])
    with pytest.raises(AlreadyExists) as e:
        store.append("b", "any", [add(1)], key="k1")
    assert e.value.position == 2 and store.lookup_key("k1") == 2 and store.lookup_key("k2") is None
    for bad in (lambda: store.append("a", "any", []), lambda: store.append("", "any", [add(1)]), lambda: store.append("a\n", "any", [add(1)]), lambda: store.lookup_key("")):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(PermissionDenied):
        store.append("a", "any", [add(1, "System.TimerFired")])
    assert store.append("a", "any", [add(1, "System.TimerFired")], system=True) == 4
    assert [r.position for r in log.read_all(store.events(), 2, 2).collect()] == [2, 3]


def test_concurrent_writers_and_fencing(store):
    m = store.manifest()
    store.append("a", "any", [add(1)])
    with pytest.raises(FailedPrecondition) as e:
        store._add(m, store.events().limit(1), 1, [])
    assert e.value.code == "CONFLICT" and store.head == 1 and store.events().count() == 1
    epoch = store.fence()
    with pytest.raises(FailedPrecondition):
        store.append("a", "any", [add(1)], epoch=epoch - 1)
    store.append("a", "any", [add(1)], epoch=epoch)


def test_truncate_and_times(store):
    store.append("a", "any", [add(1)], key="x", now=100)
    store.append("a", "any", [add(2), add(3), add(4)], key="y", now=200)
    store.append("b", "any", [add(5)], now=300)
    assert [store.position_after(t) for t in (50, 100, 250, 300)] == [0, 1, 4, 5]
    with pytest.raises(InvalidArgument, match="1 to 3"):
        store.truncate(2)
    store.truncate(4)
    m = store.manifest()
    assert (m["head"], m["generation"], m["cut"]) == (4, 1, 4)
    store.truncate(1)
    assert store.events().count() == 1 and store.lookup_key("y") is None and store.lookup_key("x") == 0
    store.append("c", "any", [add(9)], key="y")
    assert [(r.position, r.stream_id) for r in store.events().orderBy("position").collect()] == [(0, "a"), (1, "c")]
    store.divergence(2, store.events(1, 2).first().event_id)
    for at, event in ((3, None), (1, "other")):
        with pytest.raises(FailedPrecondition):
            store.divergence(at, event)


def test_backup_chain(spark, store, tmp_path):
    store.append("a", "any", [add(1)], key="x")
    store.backup(f"file://{tmp_path}/full")
    store.append("a", "any", [add(2), add(3)], key="y")
    store.backup(f"file://{tmp_path}/inc", 1)
    copy = LogStore.restore(spark, f"file://{tmp_path}/full", f"file://{tmp_path}/copy")
    assert copy.head == 1
    copy.apply(f"file://{tmp_path}/inc")
    key = lambda s: sorted(tuple(r) for r in s.events().collect())
    assert key(copy) == key(store) and copy.lookup_key("y") == 1
    with pytest.raises(FailedPrecondition):
        copy.apply(f"file://{tmp_path}/inc")
    with pytest.raises(FailedPrecondition):
        LogStore.restore(spark, f"file://{tmp_path}/full", f"file://{tmp_path}/copy")


def test_bulk_append(spark, store):
    store.append("user-1", "any", [add(1)])
    rows = spark.createDataFrame([(i, f"user-{i % 3}", "Counter.Added", 1, 7, '{"n": 2}') for i in range(30)], "ord long, stream_id string, family string, type_version int, recorded_at_nanos long, payload string")
    assert store.append_frame(rows) == 30
    heads = {r["stream_id"]: r["last_version"] for r in log.stream_heads(store.events()).collect()}
    assert heads == {"user-0": 9, "user-1": 10, "user-2": 9}
    assert store.stream_version("user-1") == 10


def totals(runner):
    return {r["stream_id"]: r["total"] for r in runner.table().collect()}


def test_runner_is_exactly_once(store, tmp_path):
    run = Runner(store, counter(), f"file://{tmp_path}/models")
    for i in range(6):
        store.append(f"s{i % 2}", "any", [add(i), Event("Other.Event", {"n": 100})])
    assert run.catch_up(batch=5) == 12 and run.status == "LIVE"
    assert totals(run) == {"s0": 6, "s1": 9}
    assert run.apply(store.events(), 12) is False  # a retried batch changes nothing
    assert totals(run) == {"s0": 6, "s1": 9}
    row, at = run.get(stream_id="s1")
    assert row == {"stream_id": "s1", "total": 9} and parse_token(at) == ("log-a", 1, 11)
    last = store.append("s1", "any", [add(1)])
    assert run.get(token("log-a", 1, last), stream_id="s1")[0]["total"] == 10  # reads its own writes
    assert run.get(stream_id="none")[0] is None
    with pytest.raises(Unavailable):
        run.get(token("log-a", 1, 99), stream_id="s1")
    store.truncate(2)
    run.catch_up()  # what it had seen is gone: it starts over
    assert totals(run) == {"s0": 0}
    run.rebuild()
    assert totals(run) == {"s0": 0}


def test_runner_stream_and_failure(store, tmp_path):
    run = Runner(store, counter(), f"file://{tmp_path}/models")
    store.append("a", "any", [add(1), add(2)])
    for want in (3, 8):
        q = run.stream(f"file://{tmp_path}/cp")
        q.awaitTermination(60)
        assert totals(run) == {"a": want}
        store.append("a", "any", [add(5)])
    store.append("a", "any", [Event("Counter.Added", {"n": "bad"})])
    before = run.checkpoint()
    with pytest.raises(Exception):
        run.catch_up()
    assert run.status == "FAILED" and run.checkpoint() == before
    with pytest.raises(FailedPrecondition):
        run.get(stream_id="a")

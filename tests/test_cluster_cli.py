import json

import pytest

from tidemark import cli
from tidemark.functions.errors import FailedPrecondition
from tidemark.sources.store import Event, LogStore
from tidemark.streaming.cluster import Backup, Lease, Member, backoff, duration, elect, next_backup, prune


def test_durations_and_backoff():
    assert [duration(x) for x in ("250ms", "30s", "5m", "6h", "7d")] == [0.25, 30, 300, 21600, 604800]
    for bad in ("", "5", "h", "1.5h", "-1s"):
        with pytest.raises(ValueError):
            duration(bad)
    assert [backoff(n) for n in (1, 2, 7, 50)] == [0.5, 1.0, 30.0, 30.0]


def test_lease_needs_a_majority():
    lease = Lease({"a", "b", "c"}, 10)
    lease.renew("a", 0)
    lease.renew("x", 0)
    assert not lease.valid(1)
    lease.renew("b", 5)
    assert lease.valid(9) and not lease.valid(12)


def test_elections():
    a, b, c = Member("a", 10), Member("b", 10), Member("c", 7)
    assert elect(c, [a, b]) is None  # its log is shorter
    assert elect(a, [b, c]) == 1
    assert not b.vote("c", 1, 99) and b.vote("a", 1, 10)  # one vote per epoch
    with pytest.raises(ValueError):
        a.follow(0)


def test_backup_schedule():
    done = []
    assert next_backup(done, 5, 3) == ("full", 0)
    done = [Backup("1", 0, 5), Backup("2", 5, 8)]
    assert next_backup(done, 8, 3) is None
    assert next_backup(done, 9, 3) == ("incremental", 8)
    assert next_backup([*done, Backup("3", 8, 9)], 12, 3) == ("full", 0)
    assert next_backup(done, 4, 3) == ("full", 0)  # the log was cut
    chains = [Backup("1", 0, 5), Backup("2", 5, 8), Backup("3", 0, 9), Backup("4", 0, 12), Backup("5", 12, 13)]
    assert [b.name for b in prune(chains, 2)] == ["1", "2"] and prune(chains, 3) == []


def test_replication(spark, tmp_path):
    a = LogStore.create(spark, f"file://{tmp_path}/a", "one")
    b = LogStore.create(spark, f"file://{tmp_path}/b", "one")
    a.append("s", "any", [Event("C.E", {"n": i}) for i in range(3)], key="k")
    a.append("t", "any", [Event("C.E", {"n": 9})])
    chunk = a.replication_chunk(0, records=2)
    assert (chunk["start"], chunk["stop"]) == (0, 3)  # a chunk ends with a batch
    assert b.apply_chunk(chunk) == 3 and b.lookup_key("k") == 0
    with pytest.raises(FailedPrecondition):
        b.apply_chunk(chunk)
    last = b.events(2, 3).first().event_id
    assert b.apply_chunk(a.replication_chunk(3, last)) == 4
    assert b.apply_chunk(a.replication_chunk(4)) == 4
    assert sorted(map(tuple, b.events().collect())) == sorted(map(tuple, a.events().collect()))
    with pytest.raises(FailedPrecondition):
        a.replication_chunk(3, "other")
    assert b.health().first().head == 4


def test_cli(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/log"
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out.strip())
    assert run("log", path, "init")[0] == 0
    assert run("log", path, "append", "s-1", "C.E", '{"n": 1}', "--expected", "no_stream") == (0, "0")
    assert run("log", path, "append", "s-1", "C.E", '{"n": 1}', "--expected", "no_stream")[0] == 1
    assert run("log", path, "append", "s-1", "C.E", '{"n": 2}', "--expected", "0", "--key", "k") == (0, "1")
    code, out = run("log", path, "stream", "s-1", "--start", "1")
    assert code == 0 and json.loads(out)["payload"] == '{"n":2}'
    assert run("log", path, "all", "--start", "9")[0] == 1
    assert json.loads(run("log", path, "heads")[1])["last_version"] == 1
    assert run("log", path, "backup", f"file://{tmp_path}/bk")[0] == 0
    assert run("log", f"file://{tmp_path}/copy", "restore", f"file://{tmp_path}/bk") == (0, "2")
    old, new = tmp_path / "old", tmp_path / "new"
    text = 'layer domain context C { event E v1 { k: uuid, n: int } aggregate A { key k: uuid stream "a-{k}" events E } }'
    old.write_text(text)
    new.write_text(text.replace("n: int", "n: string"))
    assert run("schema", "check", str(old)) == (0, "")
    assert run("schema", "diff", str(old), str(new))[0] == 1
    assert run("schema", "fmt", str(old))[1].startswith("layer domain")
    with pytest.raises(SystemExit) as e:
        cli.main(["log", path])
    assert e.value.code == 2

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.errors import InvalidArgument, NotFound
from tidemark.functions.validate import event_errors, prepared
from tidemark.schema.parser import parse
from tidemark.sources.store import Event, LogStore

DOMAIN = parse("""
layer domain
context C {
  value Money { amount: decimal, currency: string = "EUR" }
  enum Shape { Dot, Box { w: int, h: int? } }
  event E v1 { k: uuid, n: int, u: uint, s: string?, total: Money, shape: Shape, li: [int], se: set<string>, ma: map<int, Money>, lines: [L], at: timestamp? }
  aggregate A { key k: uuid stream "a-{k}" entity L { id lid: uint, q: int } events E }
}
""")
GOOD = {"k": "11111111-1111-1111-1111-111111111111", "n": 5, "u": 18446744073709551615, "total": {"amount": "1.50"}, "shape": "Dot", "li": [1, 2], "se": ["a"], "ma": {"1": {"amount": "2"}}, "lines": [{"lid": 1, "q": -2}]}


def test_payloads(spark):
    cases = [
        ({}, []),
        ({"s": None, "at": "2024-01-02T03:04:05Z", "shape": {"Box": {"w": 1}}}, []),
        ({"n": 1.5}, ["$.n: wrong type"]),
        ({"n": "1"}, ["$.n: wrong type"]),
        ({"n": 9223372036854775808}, ["$.n: wrong type"]),
        ({"u": -1}, ["$.u: wrong type"]),
        ({"n": None}, ["$.n: missing"]),
        ({"k": "nope", "zz": 1, "aa": 2}, ["$.k: wrong type", "$.aa: unknown field", "$.zz: unknown field"]),
        ({"total": {"amount": 12}}, ["$.total.amount: wrong type"]),
        ({"total": 3}, ["$.total: wrong type"]),
        ({"total": {"amount": "1", "x": 1}}, ["$.total.x: unknown field"]),
        ({"shape": "Box"}, ["$.shape: unknown variant"]),
        ({"shape": {"Box": {"h": 1}}}, ["$.shape.Box.w: missing"]),
        ({"li": [1, "x", 2.5]}, ["$.li[1]: wrong type", "$.li[2]: wrong type"]),
        ({"li": {}}, ["$.li: wrong type"]),
        ({"se": ["a", "a"]}, ["$.se: duplicate element"]),
        ({"ma": {"x": {"amount": "1"}}}, ["$.ma.x: wrong key"]),
        ({"ma": {"1": {}}}, ["$.ma.1.amount: missing"]),
        ({"lines": [{"lid": 1}]}, ["$.lines[0].q: missing"]),
        ({"at": "2024-01-02"}, ["$.at: wrong type"]),
    ]
    rows = [(i, json.dumps({**GOOD, **c})) for i, (c, _) in enumerate(cases)] + [(98, "{"), (99, "[]")]
    df = spark.createDataFrame(rows, "i int, payload string")
    got = {r.i: r.e for r in df.select("i", event_errors(DOMAIN, "C.E", 1, F.col("payload")).alias("e")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, rows[i]
    assert got[98] == ["$: no JSON"] and got[99] == ["$: wrong type"]


RULED = parse("""
layer domain
context C {
  enum Kind { Plain, Big { size: int } }
  value Pay { amount: decimal, kind: Kind = "Plain", tags: set<string>, note: string?, part: Part }
    rules { Positive: amount > 0, BigOnly: kind == "Big" or amount < 100, Few: len(tags) <= 2, Noted: note matches "^ok", Inner: part.n in [1, 2] }
  value Part { n: int, m: map<string, int> }
  event Paid v1 { id: uint, pay: Pay }
  event Paid v2 { id: uint, pay: Pay, at: timestamp?, marks: set<int>, lines: map<int, Line> }
  event Loose v1 { x: int = 4 }
  aggregate Account { key id: uint stream "account-{id}" entity Line { id lid: int, q: decimal } events Paid }
}
""")
PAY = {"amount": "5.00", "tags": [], "part": {"n": 1, "m": {}}}


def test_rules_hold_inside_payloads(spark):
    cases = [
        ({}, []),
        ({"amount": "0"}, ["$.pay: violates Positive"]),
        ({"amount": "100.00"}, ["$.pay: violates BigOnly"]),
        ({"amount": "100.00", "kind": {"Big": {"size": 3}}}, []),  # a variant with a payload compares by its name
        ({"tags": ["a", "b", "c"], "amount": "-1"}, ["$.pay: violates Positive", "$.pay: violates Few"]),
        ({"note": "no"}, ["$.pay: violates Noted"]),
        ({"note": "ok then"}, []),
        ({"part": {"n": 3, "m": {}}}, ["$.pay: violates Inner"]),
        ({"amount": 3, "note": "no"}, ["$.pay.amount: wrong type"]),  # rules wait for the fields
    ]
    df = spark.createDataFrame([(i, json.dumps({"id": 1, "pay": {**PAY, **c}})) for i, (c, _) in enumerate(cases)], "i int, payload string")
    got = {r.i: r.e for r in df.select("i", event_errors(RULED, "C.Paid", 1, F.col("payload")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_events_are_prepared(spark):
    full = {"lines": {"10": {"q": "1.50", "lid": 10}, "9": {"lid": 9, "q": "2"}, "-1": {"lid": -1, "q": "0.0"}}, "marks": [10, 9, -1], "pay": {**PAY, "tags": ["é", "a"]}, "at": "2024-01-01T01:30:00.250+01:30", "id": 7}
    text = '{"id":7,"pay":{"amount":"5.00","kind":"Plain","tags":["a","é"],"note":null,"part":{"n":1,"m":{}}},"at":"2024-01-01T00:00:00.250Z","marks":[-1,9,10],"lines":{"-1":{"lid":-1,"q":"0.0"},"9":{"lid":9,"q":"2"},"10":{"lid":10,"q":"1.50"}}}'
    rows = [
        ("account-7", "C.Paid", full, "", (text, [])),
        ("account-7", "C.Paid@v2", full, '{"by": 1}', (text, [])),
        ("account-8", "C.Paid", full, None, (None, ["belongs to stream account-7"])),
        ("account-7", "C.Paid", {**full, "lines": {"9": {"lid": 8, "q": "1"}}}, None, (None, ["$.lines.9: key is not the id"])),
        ("account-7", "C.Paid@v3", full, None, (None, ["unknown event type"])),
        ("account-7", "C.Nope", full, None, (None, ["unknown event type"])),
        ("account-7", "no ref", full, None, (None, ["malformed event type"])),
        ("account-7", "C.Paid", full, "[1]", (None, ["metadata is no object"])),
        ("any stream", "C.Loose", {}, "{}", ('{"x":4}', [])),
        ("any stream", "C.Loose", {"x": None, "y": 1}, "{}", (None, ["$.y: unknown field"])),
    ]
    df = spark.createDataFrame([(i, s, t, json.dumps(p), m) for i, (s, t, p, m, _) in enumerate(rows)], "i int, stream_id string, type_ref string, payload string, metadata string")
    for r in prepared(RULED, df).collect():
        assert (r.canonical, r.errors) == rows[r.i][4], rows[r.i]
    again = prepared(RULED, df.where("i = 0").withColumn("payload", F.lit(text))).first()
    assert again.canonical == text and (again.family, again.type_version) == ("C.Paid", 2)


def test_a_log_with_a_domain_takes_what_fits(spark, tmp_path):
    store = LogStore.create(spark, f"file://{tmp_path}/log", domain=RULED)
    pay = {"id": 7, "pay": {**PAY, "tags": ["b", "a"]}}
    store.append("account-7", "any", [Event("C.Paid", pay), Event("C.Loose", {})])
    assert [json.loads(r.payload) for r in store.events().orderBy("position").collect()] == [{"id": 7, "pay": {"amount": "5.00", "kind": "Plain", "tags": ["a", "b"], "note": None, "part": {"n": 1, "m": {}}}}, {"x": 4}]
    for stream, event, error in [("account-8", Event("C.Paid", pay), InvalidArgument), ("account-7", Event("C.Paid", {"id": 7}), InvalidArgument), ("account-7", Event("C.Paid", pay, 9), NotFound), ("account-7", Event("C.Paid", {**pay, "pay": {**PAY, "amount": "0"}}), InvalidArgument)]:
        with pytest.raises(error):
            store.append(stream, "any", [event])
    assert store.head == 2

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, values


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("n > 1", [False, True, False]),
        ("n >= 1 and s == \"abc\"", [True, False, False]),
        ("not n > 1", [True, False, True]),
        ("s matches \"b\"", [True, False, True]),
        ("n in [1, 5]", [True, False, False]),
        ("len(s) <= 3 or n == 2", [True, True, True]),
        ("len(l) < 2", [True, False, False]),
        ("m.a == 4", [True, False, False]),
        ("s > 3", [False, False, True]),
        ("(n > 1 or n < 1) and true == true", [False, True, False]),
        ("d >= 1.50", [True, False, False]),
    ],
)
def test_rules(spark, rule, want):
    rows = [(0, 1, "abc", [1], (4,), "1.50"), (1, 2, "xyz", [1, 2], (5,), "1.49"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, n long, s string, l array<int>, m struct<a: int>, d string").withColumn("d", F.col("d").cast("decimal(10,2)"))
    got = df.select("i", rules.compile_rule(rule, df.schema, {"s"}).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want  # s may be absent, the others may not


@pytest.mark.parametrize("bad", ["", "n >", "n", "n ~ 1", "l > 1", "nope == 1", 's matches "(?=x)"', "n in [1", "(n > 1", "n > 1 n > 2"])
def test_bad_rules(spark, bad):
    schema = spark.createDataFrame([], "n long, s string, l array<int>").schema
    with pytest.raises(rules.RuleError):
        rules.compile_rule(bad, schema)


FORMS = {
    "string": (["a", ""], []),
    "int": (["0", "-5", "9223372036854775807"], ["1.5", "9223372036854775808", "", "+1"]),
    "uint": (["0", "5", "18446744073709551615"], ["-1", "1.5", "18446744073709551616"]),
    "decimal": (["12.50", "0", "-3.25", "40.00"], ["abc", "1e5", "+1", ".5", "5.", ""]),
    "uuid": (["11111111-1111-1111-1111-111111111111"], ["11111111111111111111111111111111", "1111111g-1111-1111-1111-111111111111", "1"]),
    "timestamp": (["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123+02:00"], ["2024-01-02", "yesterday", "1704164645", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z"]),
    "bytes": (["aGVsbG8=", ""], ["aGVsbG8", "!!!", "a"]),
}


@pytest.mark.parametrize("kind", FORMS)
def test_scalar_forms(spark, kind):
    good, bad = FORMS[kind]
    df = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "x string")
    got = {r.x: r.ok for r in df.select("x", values.accepts(kind, F.col("x")).alias("ok")).collect()}
    assert got == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False), None: False}


def test_decimals_templates_references(spark):
    df = spark.createDataFrame([("40.00", 2, "40"), ("1.50", 2, "1.5"), ("0.00", 2, "0"), ("7", 0, "7"), ("-0.0", 1, "0"), ("100", 0, "100")], "t string, scale int, key string")
    for r in df.select("*", values.scale_of(F.col("t")).alias("s"), values.decimal_key(F.col("t")).alias("k"), values.decimal_text(F.col("t").cast("decimal(38,18)"), F.col("scale")).alias("text")).collect():
        assert (r.s, r.k) == (r.scale, r.key) and (r.text == r.t or r.t == "-0.0")
    streams = ["user-5", "user-05", "user-", "user-x", "other-5", None]
    got = spark.createDataFrame([(s,) for s in streams], "s string").select(values.match("user-{id}", F.col("s"), "uint").alias("k")).collect()
    assert [r.k for r in got] == ["5", None, None, None, None, None]
    refs = ["A.B", "A.B@v2", "A", "A.B@v0", "A.B@2", ".B"]
    got = spark.createDataFrame([(s,) for s in refs], "s string").select(values.event_ref(F.col("s")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [("A", "B", None), ("A", "B", 2), None, None, None, None]


def test_upcast(spark):
    old = spark.createDataFrame([("c1", None, 3, "gone")], "cust string, qty int, keep int, dropped string")
    new = values.upcast(old, {"note": "string", "customer": "string", "qty": "int", "keep": "bigint", "extra": "string"}, {"note": "legacy"}, {"cust": "customer"}, {"qty": 1})
    assert tuple(new.first()) == ("legacy", "c1", 1, 3, None)
    assert new.columns == ["note", "customer", "qty", "keep", "extra"]


def test_violations(spark):
    df = spark.createDataFrame([(1, "EUR"), (-1, "eur")], "amount int, currency string")
    got = rules.violations(df, {"NonNegative": "amount >= 0", "Iso": 'currency matches "^[A-Z]{3}$"'}).orderBy("amount").collect()
    assert [r.errors for r in got] == [["NonNegative", "Iso"], []]

"""Two-level running values against one window per key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.running import by_position, running


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("before", [False, True])
def test_running_equals_a_window(spark, width, before):
    rng = random.Random(width)
    rows = [(p, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1, 2, -5]), rng.choice([None, None, "x", "y"])) for p in range(120)]
    df = spark.createDataFrame(rows, "position bigint, key string, n bigint, v string").repartition(5)
    got = running(df, ["key"], ["position"], by_position(width=width), {"total": F.col("n")}, {"seen": F.col("v")}, before)
    assert got.columns == [*df.columns, "total", "seen"]
    line = Window.partitionBy("key").orderBy("position").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = df.withColumn("total", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(line), F.lit(0))).withColumn("seen", F.last("v", ignorenulls=True).over(line))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_rows(spark):
    df = spark.createDataFrame([], "position bigint, key string")
    assert running(df, ["key"], ["position"], by_position(), {"total": F.lit(1)}).count() == 0

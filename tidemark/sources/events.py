"""Event logs as DataFrames: two views over plain tables, in one shape.

Columns: position, stream_id, stream_version, context, name, family, type_version, recorded_at, payload columns.
Nothing here is computed unless a query selects it; Catalyst drops unused windows and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.running import by_position, running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a log: a stream per user, event ids as positions."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("position"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"),
        F.col("user_id"),
        F.lit("Activity").alias("context"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("Activity."), F.col("event_type")).alias("family"),
        (F.pmod(k, F.lit(2)) + 1).cast("int").alias("type_version"),
        F.col("ts").alias("recorded_at"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        k.alias("k"),
        F.col("props").alias("payload"),
    )


def with_versions(log: DataFrame) -> DataFrame:
    """Dense 0-based version of each event in its stream; a stream's events are counted in buckets of positions."""
    numbered = running(log, ["stream_id"], ["position"], by_position(), sums={"stream_version": F.lit(1).cast("long")})
    return numbered.withColumn("stream_version", F.col("stream_version") - 1)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and lines as one log: kind, ids, amount and an order key, without a dense position.

    Sorted by (recorded_at, kind, order_id, line, part): kinds are 0 registered, 1 placed, 2 line added, 3 cancelled.
    """
    money = lambda c: F.col(c).cast("decimal(18,2)")
    none = F.lit(None)
    customers = table(spark, sf_dir, "customer").select(F.lit("1990-01-01").cast("timestamp_ntz").alias("recorded_at"), F.lit(0).alias("kind"), none.cast("long").alias("order_id"), F.col("c_custkey").alias("customer_id"), none.cast("int").alias("line"), F.col("c_name").alias("name"), none.cast("decimal(18,2)").alias("amount"))
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    placed = o.select(at.alias("recorded_at"), F.lit(1), F.col("o_orderkey"), F.col("o_custkey"), none.cast("int"), none.cast("string"), money("o_totalprice"))
    cancelled = o.where("o_orderstatus = 'F'").select((at + F.expr("interval 2 days")).alias("recorded_at"), F.lit(3), F.col("o_orderkey"), none.cast("long"), none.cast("int"), none.cast("string"), none.cast("decimal(18,2)"))
    return customers.unionAll(placed).unionAll(cancelled)


def dense_positions(df: DataFrame, bucket, *order) -> DataFrame:
    """``position`` from 0 without a single-partition sort: rows are numbered within buckets that rise with the order,
    and each bucket starts where the ones before it end. Only the bucket counts meet in one task."""
    counted = df.withColumn("_b", bucket)
    starts = counted.groupBy("_b").count()
    starts = starts.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_start"))
    rows = counted.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - F.lit(1))
    return rows.join(starts, "_b").withColumn("position", F.col("_start") + F.col("_n")).drop("_b", "_n", "_start")

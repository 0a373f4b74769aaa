"""Reads, heads, cuts and bounds of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import by_position, running


class PositionOutOfRange(ValueError):
    pass


def next_position(log: DataFrame) -> int:
    top = log.agg(F.max("position")).first()[0]
    return 0 if top is None else top + 1


def check_from(log: DataFrame, start: int) -> None:
    if start > next_position(log):
        raise PositionOutOfRange(f"{start} lies past the head")


def read_all(log: DataFrame, start: int, limit: int) -> DataFrame:
    return log.where(F.col("position") >= start).orderBy("position").limit(limit)


def read_all_backward(log: DataFrame, start: int, limit: int) -> DataFrame:
    return log.where(F.col("position") <= start).orderBy(F.desc("position")).limit(limit)


def read_stream(log: DataFrame, stream: str, start: int | None = None, backward: bool = False, limit: int = 0) -> DataFrame:
    """One stream by version; ``limit`` 0: all. The stream filter reaches the scan before versions are numbered."""
    own = log.where(F.col("stream_id") == stream)
    if "stream_version" not in own.columns:
        own = running(own, ["stream_id"], ["position"], by_position(), sums={"stream_version": F.lit(1).cast("long")})
        own = own.withColumn("stream_version", F.col("stream_version") - 1)
    if start is not None:
        own = own.where(F.col("stream_version") <= start if backward else F.col("stream_version") >= start)
    own = own.orderBy(F.desc("stream_version") if backward else "stream_version")
    return own.limit(limit) if limit else own


def read_by_type(log: DataFrame, family: str, start: int, limit: int, version: int | None = None) -> DataFrame:
    out = log.where((F.col("family") == family) & (F.col("position") >= start))
    if version is not None:
        out = out.where(F.col("type_version") == version)
    return out.orderBy("position").limit(limit)


def stream_heads(log: DataFrame) -> DataFrame:
    """Last version, position and family of each stream: one aggregate with partial sums, no window."""
    return log.groupBy("stream_id").agg((F.count(F.lit(1)) - 1).alias("last_version"), F.max("position").alias("last_position"), F.max_by("family", "position").alias("last_family"))


def list_streams(log: DataFrame, prefix: str = "") -> DataFrame:
    return log.where(F.col("stream_id").startswith(prefix)).select("stream_id").distinct()


def batch_ends(log: DataFrame, batch: Column) -> DataFrame:
    """The last position of each batch, from a batch number."""
    return log.groupBy(batch.alias("batch_id")).agg(F.max("position").alias("last_position"), F.count(F.lit(1)).alias("n_events"))


def position_after(log: DataFrame, at: Column) -> DataFrame:
    """(cut): the first position recorded after ``at``, else the head."""
    return log.agg(F.coalesce(F.min(F.when(F.col("recorded_at") > at, F.col("position"))), F.max("position") + 1).alias("cut"))


def truncate(log: DataFrame, cut: int) -> DataFrame:
    return log.where(F.col("position") < cut)


def increment(log: DataFrame, base_head: int, cut: int) -> DataFrame:
    """What an incremental backup of [base_head, cut) holds."""
    return log.where((F.col("position") >= base_head) & (F.col("position") < cut))


def chunk_bounds(log: DataFrame, batch: Column, records: int) -> DataFrame:
    """(chunk, first_position, last_position, n): chunks of about ``records`` events that end on batch ends."""
    ends = log.groupBy(batch.alias("b")).agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count(F.lit(1)).alias("n"))
    chunk = F.floor(F.col("lo") / records).alias("chunk")
    return ends.groupBy(chunk).agg(F.min("lo").alias("first_position"), F.max("hi").alias("last_position"), F.sum("n").alias("n_events"))


def first_of_key(rows: DataFrame, key: str) -> DataFrame:
    """Idempotency: the first position that wrote each key, and how many were refused after it."""
    return rows.groupBy(key).agg(F.min("position").alias("first_position"), (F.count(F.lit(1)) - 1).alias("refused"))


def expected_version(appends: DataFrame, heads: DataFrame) -> DataFrame:
    """``appends(stream_id, mode, expected)`` with actual, outcome: ok or wrong_expected_version.

    mode: any, no_stream, stream_exists, exact.
    """
    both = appends.join(heads.select("stream_id", F.col("last_version").alias("actual")), "stream_id", "left")
    ok = F.when(F.col("mode") == "any", True).when(F.col("mode") == "no_stream", F.col("actual").isNull()).when(F.col("mode") == "stream_exists", F.col("actual").isNotNull()).otherwise(F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))
    return both.withColumn("outcome", F.when(ok, "ok").otherwise("wrong_expected_version"))


def as_of(events: DataFrame, key: str, value: Column, name: str, order: str = "position") -> DataFrame:
    """The events with ``name``: the value that the key's row had before each event."""
    return running(events, [key], [order], by_position(order), lasts={name: value}, before=True)


def get(model: DataFrame, **key: object) -> DataFrame:
    for name, value in key.items():
        model = model.where(F.col(name) == value)
    return model


def scan(model: DataFrame, keys: list[str], prefix: dict[str, object] | None = None, limit: int = 0) -> DataFrame:
    """Rows whose leading key fields equal ``prefix``, in key order; limit 0 means 100."""
    prefix = prefix or {}
    if list(prefix) != keys[: len(prefix)]:
        raise ValueError("a prefix names the leading key fields without gaps")
    return get(model, **prefix).orderBy(*keys).limit(limit or 100)

"""Running sums and last values in two levels, so that a key's rows need not meet in one task.

A window over a key sorts all its events in one task; a stream with a third of the log would be that task's. Here the
rows of a key are cut into buckets that rise with the order. Each bucket is aggregated (with partial aggregates), the
bucket totals are scanned per key, and what came before a bucket enters it as one carry row at its start. The rows are
shuffled once, by key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one bucket, where positions give the order.
BUCKET = 1 << 20


def by_position(order: str = "position", width: int = BUCKET) -> Column:
    return F.expr(f"`{order}` div {width}")


def running(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """``rows`` with a column per sum (nulls count 0) and per last value (that is not null) over the key's rows up to
    each row, or ``before`` it.

    ``bucket`` must not fall where the order rises. Rows with null keys form a group of their own, as in a window.
    """
    sums, lasts = sums or {}, lasts or {}
    given = rows.columns
    fed = rows.withColumns({"_b": bucket, "_c": F.lit(1), **{f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}, **{f"_l_{n}": c for n, c in lasts.items()}})
    # a plain number lets the aggregate hash; a struct makes it sort
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    totals = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums] + [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in lasts]
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = fed.groupBy(*keys, "_b").agg(*totals).select(
        *keys,
        "_b",
        F.lit(0).alias("_c"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in lasts],
    )
    line = Window.partitionBy(*keys, "_b").orderBy("_c", *order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    out = fed.unionByName(carry, allowMissingColumns=True)
    done = {n: F.sum(f"_s_{n}").over(line) for n in sums} | {n: F.last(f"_l_{n}", ignorenulls=True).over(line) for n in lasts}
    return out.select(*given, "_c", *[c.alias(n) for n, c in done.items()]).where("_c = 1").drop("_c")

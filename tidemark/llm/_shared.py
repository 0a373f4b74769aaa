"""What the operators share: a scratch folder every executor sees, Arrow batch limits, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.workers import reach

#: Bytes of one Arrow batch handed to Python; long texts then come a few at a time.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, whatever the length of the texts; called before every use of Python workers."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; on a local master without that setting, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self.remove(path)

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it once the results have been written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A key that holds more than this share of all rows is hot; there are at most so many hot keys. Up to ``FEW`` rows
#: none is, as one task holds all of them with ease.
HOT, FEW = 1000, 1_000_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``small(key, ..., n)``, one row per key, where n counts the key's rows and ``total`` all rows.

    The rows of a hot key stay where they are and meet its row by broadcast; at most ``HOT`` keys have a thousandth of
    all rows, so the broadcast is bounded. All other keys meet in a sort-merge join.
    """
    if total <= FEW:
        return rows.join(small.drop("n"), key)
    hot = F.col("n") > total // HOT
    left = rows.join(F.broadcast(small.where(hot)), key, "left")
    few = left.where("n is null").select(rows.columns).join(small.where(~hot).hint("merge"), key)
    return left.where("n is not null").unionByName(few).drop("n")


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star until the edge set stays the same, however many rounds that takes. Every step
    is a hash aggregate and an equality join that keeps hubs where they are; the edges between rounds are a table in
    the shared folder.
    """
    e = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    least = [F.min("v").alias("m"), F.count(F.lit(1)).alias("n")]
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(*least).select("u", F.least("u", "m").alias("m"), "n")
        # the larger neighbours of a node go to its smallest one; each edge has one larger end, so large has no more rows than e
        large = join_hot(both.where("v > u"), low, "u", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = join_hot(large, large.groupBy("u").agg(*least), "u", now[0])
        nxt = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        nxt = scratch.keep(nxt.distinct(), "edges")
        scratch.drop(e)
        e = nxt
    own = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = scratch.keep(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own), "components")
    scratch.drop(e)
    return out

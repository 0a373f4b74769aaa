"""SimHash fingerprints and near-duplicate classes by deletion-variant signatures.

Documents with equal fingerprints form a class. To link classes whose 64-bit fingerprints differ in at most four
bits, the fingerprint is cut into three segments: of any such pair at least one segment differs by one bit or none.
Each segment is indexed under its one-wildcard variants (one bit of it deleted), so such a pair shares a variant key.
Equality on the key finds the candidates, the Hamming distance verifies them.

A bucket (one key) may hold a large group of near copies, so pairs within a bucket are never listed. First every
member is compared with two members of the bucket that a hash picks; the links found are contracted to components.
Only buckets that still hold several components are joined, the rows outside the component of the largest size against
the others, and only links between different components are kept. All links between classes are thereby respected.

Null and empty texts have fingerprint 0, linked like any other. Rows with equal ids count as one document for the
component's name; null ids never name a component unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, bounded_batches, connected_components, join_hot
from tidemark.llm.bpe import raw_texts

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: (first bit, bits) of each segment; DISTANCE // len(SEGMENTS) is 1, so one segment differs by one bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_SLICE = 1 << 15


def fingerprint(raw: bytes) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for a text without words."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : min(n, at + _SLICE)].tolist(), stops[at : at + _SLICE].tolist())), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long): the fingerprint's bits as a signed number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in raw_texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def variant_keys(fp: Column) -> Column:
    """The one-wildcard variants of every segment, tagged with segment and wildcard."""
    keys = []
    for s, (first, bits) in enumerate(SEGMENTS):
        for bit in range(bits):
            mask = ((1 << bits) - 1) & ~(1 << bit)
            keys.append(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(mask).cast("long")) + F.lit((s * 32 + bit) << 32).cast("long"))
    return F.array(*keys)


def near(a: str, b: str, distance: int = DISTANCE) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def link(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component) for distinct fingerprints ``fps(fp)``; component is the smallest fingerprint of the component."""
    index = fps.select("fp", F.explode(variant_keys(F.col("fp"))).alias("k"))
    bucket = Window.partitionBy("k")
    # pivots by a hash of fingerprint and key: a large group has others in each of its buckets
    dice = F.struct(F.xxhash64("fp", "k").alias("h"), "fp")
    index = index.select("k", "fp", F.min(dice).over(bucket)["fp"].alias("low"), F.max(dice).over(bucket)["fp"].alias("high"), F.count(F.lit(1)).over(bucket).alias("n")).where("n > 1")
    index = scratch.keep(index, "buckets")
    star = lambda pivot: index.where((F.col("fp") != F.col(pivot)) & near("fp", pivot)).select(F.col("fp").alias("a"), F.col(pivot).alias("b"))
    stars = star("low").unionByName(star("high"))
    labels = connected_components(scratch, stars)

    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = scratch.keep(labels.join(sizes, "component").select(F.col("node").alias("fp"), "component", "size"), "labels")
    rest = index.where("n > 3")  # of three, all pairs have been compared
    rest = rest.join(named, "fp", "left").select("k", "fp", F.coalesce("component", "fp").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    ranked = F.struct("size", "label")
    rest = rest.select("k", "fp", "label", F.max(ranked).over(bucket).alias("top"), F.min(ranked).over(bucket).alias("low"))
    rest = scratch.keep(rest.where("top != low").select("k", "fp", "label", (F.col("label") == F.col("top.label")).alias("major")), "mixed")
    minor = rest.where("not major").select("k", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    more = minor.join(rest, "k").where((F.col("label") != F.col("label2")) & near("fp", "fp2")).select(F.col("label").alias("a"), F.col("label2").alias("b"))
    second = connected_components(scratch, more).select(F.col("node").alias("label"), F.col("component").alias("top"))
    out = fps.join(named.select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))
    out = out.join(second, "label", "left").select("fp", F.coalesce("top", "label").alias("component"))
    return scratch.keep(out, "components")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component): one row per row of ``docs``; component is the smallest key reachable by links."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs, text, key), "fingerprints")
    classes = scratch.keep(rows.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    linked = link(classes.select("fp"), scratch).withColumnRenamed("component", "_c")
    members = linked.join(classes, "fp")
    named = scratch.keep(members.groupBy("_c").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")), "named")
    # a component may have a third of all classes: its rows are not gathered
    names = scratch.keep(join_hot(linked, named, "_c", classes.count()).select("fp", "component"), "names")
    return rows.join(names, "fp").select(key, "fp", "component")


def hex64(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

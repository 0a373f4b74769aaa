"""Embedding near-duplicates by collision-counting projections.

Vectors with equal labels and equal components are one class. Unit vectors with cosine >= c are at most
d = sqrt(2 - 2c) apart, so on a random unit direction their projections differ by about d / sqrt(dim) times a
standard normal. A pair collides on a direction if one lies in the window of +-w around the other (the query). Over
M directions a linked pair collides nearly always, others seldom; pairs with at least T collisions are verified by
their cosine in double precision. T is calibrated: the largest count that a pair at the threshold itself misses with
a probability of at most ``MISS``.

One more direction deals the classes: cells of a width that linked pairs exceed with a like probability, each cell
compared with itself and the next. Cells are cut into blocks of bounded size, and a task compares two blocks: it
sorts a block along a direction, takes the pairs that the windows of the other's vectors give, thins them out by a few
more directions, counts the collisions of the rest, verifies, and returns for each class its number of links and the smallest class its links reach inside the pair of blocks: rows in proportion to
the classes, not to the pairs.

Labels that are null, and vectors that are null, empty, zero, or hold a null or non-finite component link with
nothing. Vectors of unequal length do not link. Rows with equal ids count as separate vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, bounded_batches, connected_components

COSINE = 0.98
#: Directions, half a window and a cell in standard deviations of a pair at the threshold, and the chance to miss it.
DIRECTIONS, HALF_WINDOW, CELL, MISS = 24, 2.5, 5.0, 1e-6
BLOCK = 2048


def calibrated_count(directions: int = DIRECTIONS, half_window: float = HALF_WINDOW, miss: float = MISS) -> int:
    """The largest T such that fewer than T of the directions collide with a probability of at most ``miss``."""
    p = math.erf(half_window / math.sqrt(2))
    total = 0.0
    for t in range(directions + 1):
        total += math.comb(directions, t) * p**t * (1 - p) ** (directions - t)
        if total > miss:
            return t
    return directions


def directions(dim: int, n: int = DIRECTIONS + 1) -> np.ndarray:
    """(dim, n) random unit vectors; the first one deals the cells."""
    a = np.random.default_rng(dim).normal(size=(dim, n))
    return a / np.linalg.norm(a, axis=0)


def _spread(dim: int, cosine: float) -> tuple[float, float]:
    """Half a window and a cell's width; no unit direction separates a linked pair by more than its distance."""
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    return min(d, HALF_WINDOW * d / math.sqrt(dim)) + 1e-9, min(d, CELL * d / math.sqrt(dim)) + 1e-9


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def candidates(a: np.ndarray, b: np.ndarray, half: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of (n, m) and (k, m) projections that collide on at least ``count`` of the m directions.

    A pair that misses at most m - count directions collides on all of at least one of m - count + 1 groups of them. So
    a group's first direction is sorted and each window gives its pairs, the group's other directions thin these out,
    and only pairs that pass a whole group have their collisions counted over all directions.
    """
    m = a.shape[1]
    found = []
    for group in np.array_split(np.arange(m), m - count + 1):
        first = group[0]
        order = np.argsort(b[:, first], kind="stable")
        line = b[order, first]
        lo, hi = np.searchsorted(line, a[:, first] - half, "left"), np.searchsorted(line, a[:, first] + half, "right")
        for at in range(0, len(a), 512):  # bounds the pairs held at once
            size = (hi - lo)[at : at + 512]
            i = np.repeat(np.arange(at, at + len(size)), size)
            j = order[np.arange(len(i)) + np.repeat(lo[at : at + 512] - np.cumsum(size) + size, size)]
            for d in group[1:]:
                near = np.abs(a[i, d] - b[j, d]) <= half
                i, j = i[near], j[near]
            found.append(i * len(b) + j)
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    i, j = pair // max(len(b), 1), pair % max(len(b), 1)
    total = np.zeros(len(i), np.int64)
    for d in range(m):
        total += np.abs(a[i, d] - b[j, d]) <= half
    return i[total >= count], j[total >= count]


def compare(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """Linked pairs of two blocks of unit vectors; a vector of one block (``same``) does not link with itself."""
    dim = x.shape[1]
    half, _ = _spread(dim, cosine)
    lines = directions(dim)[:, 1:]
    i, j = candidates(x @ lines, y @ lines, half, calibrated_count())
    linked = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(i), 1 << 18):
        p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        linked[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
    if same:
        np.fill_diagonal(linked, False)
    return linked


def _reach(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches through links."""
    far = np.iinfo(np.int64).max
    while True:
        a = np.minimum(left, np.where(linked, right[None, :], far).min(axis=1, initial=far))
        b = np.minimum(right, np.where(linked, a[:, None], far).min(axis=0, initial=far))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def link(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, weight, root) of ``classes(node, label, dim, v, n)``, a row for each linked class and pair of blocks.

    weight: how many vectors its links lead to; root: the smallest class they reach there.
    """
    bounded_batches(classes.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            cells = np.zeros(b.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _unit(b.column("v").take(pa.array(at)), dim)
                cells[at] = np.floor(x @ directions(dim)[:, 0] / _spread(dim, cosine)[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], [*b.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    dealt = Scratch(classes.sparkSession).keep(classes.mapInArrow(deal, schema + ", cell bigint"), "cells")
    line = Window.partitionBy("label", "dim").orderBy("cell")
    blocks = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("own"))
    beside = lambda f, step: F.when(f("cell").over(line) == F.col("cell") + step, f("own").over(line)).otherwise(0)
    blocks = blocks.select("label", "dim", "cell", "own", beside(F.lag, -1).alias("before"), beside(F.lead, 1).alias("after"))
    rows = dealt.join(blocks, ["label", "dim", "cell"]).withColumn("sub", F.pmod("node", F.col("own")).cast("int"))
    pairs = F.expr("""concat(
        transform(sequence(0, own - 1), t -> if(t = sub, struct(cell as c1, sub as s1, cell as c2, sub as s2, 2 as side),
            if(t > sub, struct(cell as c1, sub as s1, cell as c2, t as s2, 0 as side), struct(cell as c1, t as s1, cell as c2, sub as s2, 1 as side)))),
        transform(if(after > 0, sequence(0, after - 1), cast(array() as array<int>)), t -> struct(cell as c1, sub as s1, cell + 1 as c2, t as s2, 0 as side)),
        transform(if(before > 0, sequence(0, before - 1), cast(array() as array<int>)), t -> struct(cell - 1 as c1, t as s1, cell as c2, sub as s2, 1 as side)))""")
    rows = rows.select("node", "label", "dim", "v", "n", F.explode(pairs).alias("pair")).select("node", "label", "dim", "v", "n", "pair.*")

    def block_pair(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim = t.column("dim")[0].as_py()
        side = np.asarray(t.column("side"))
        same = bool(side[0] == 2)
        take = lambda s: t.take(pa.array(np.flatnonzero(side == s)))
        a, b = (t, t) if same else (take(0), take(1))
        node = [np.asarray(x.column("node")) for x in (a, b)]
        n = [np.asarray(x.column("n")) for x in (a, b)]
        x, y = ((_unit(z.column("v").combine_chunks(), dim) if z.num_rows else np.zeros((0, dim))) for z in (a, b))
        linked = compare(x, y, cosine, same)
        ra, rb = _reach(linked, node[0], node[1])
        some = [linked.any(axis=1), linked.any(axis=0)]
        out = [(node[0], (linked @ n[1].astype(np.float64)).astype(np.int64), ra, some[0])]
        if not same:
            out.append((node[1], (n[0].astype(np.float64) @ linked).astype(np.int64), rb, some[1]))
        return pa.table([pa.array(np.concatenate([o[i][o[3]] for o in out])) for i in range(3)], ["node", "weight", "root"])

    return rows.groupBy("label", "dim", "c1", "s1", "c2", "s2").applyInArrow(block_pair, "node bigint, weight bigint, root bigint")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of ``table``."""
    scratch = Scratch(table.sparkSession)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(key).alias("_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("node", F.when(fine, F.xxhash64("label", F.size(v), "v")))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.keep(classes.select("node", "first", "n", "label", F.size("v").alias("dim"), "v"), "classes")
    links = scratch.keep(link(classes.select("node", "label", "dim", "v", "n"), cosine), "links")
    comps = connected_components(scratch, links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("node").agg(F.sum("weight").alias("weight"))
    named = classes.select("node", "first", "n").join(comps, "node", "left").select("node", "first", "n", F.coalesce("component", "node").alias("c"))
    names = named.groupBy("c").agg(F.min("first").alias("component_id"))
    done = named.join(names, "c").join(total, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("_id", "node").join(scratch.keep(done, "named"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))

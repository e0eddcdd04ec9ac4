"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of length one whose cosine reaches c lie within eps = sqrt(2 - 2 c) of each other. They are
projected on their leading principal dimensions, laid in a grid of cells of side eps, and sorted by
cell. The sorted sequence is cut into blocks; pairs of intervals are split recursively and dropped
as soon as their bounding boxes lie more than eps apart, first between blocks as a table, then
within a pair of blocks in its task. Small intervals are compared by one matrix product, and what
comes near the threshold again in double precision. Equal vectors are compared once.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.catalog import arrow_schema, in_arrow, narrow, query, table
from tidings.llm.components import components
from tidings.llm.link_blocks import COLUMNS, Links
from tidings.session import staged

THRESHOLD = 0.95
#: Principal dimensions of the grid that orders, and of the boxes that exclude.
GRID_DIMS, BOX_DIMS = 4, 8
#: Vectors of a block: a task holds two. Within it, intervals up to a leaf are compared at once.
BLOCK, LEAF = 8192, 512
#: Rounds of the iteration that finds the principal dimensions.
ROUNDS = 3
#: Children of an interval of blocks.
FAN = 8
#: Half the width of the band around the threshold that single precision may misjudge.
SLACK = 1e-4


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, and of usable vectors key, raw values (little-endian, as wide as they come) and size."""
    wide = "double" in dict(rows.dtypes)["embedding"]

    def work(batch):
        keys, raws, sizes = [], [], []
        for name, own in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = None
            if name is not None and own.values is not None and len(own.values) and not own.values.null_count:
                v = own.values.to_numpy(zero_copy_only=False) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    v = None
            known = v is not None
            keys.append(hashlib.blake2b(v.astype("<f8").tobytes(), digest_size=16).digest() if known else None)
            raws.append(v.astype("<f8" if wide else "<f4").tobytes() if known else None)
            sizes.append(len(v) if known else None)
        return {"vec_id": batch.column(0), "key": keys, "raw": raws, "size": sizes}

    return in_arrow(narrow(rows, "vec_id", "embedding"), work, "vec_id bigint, key binary, raw binary, size int")


def unit_vectors(raws, size: int) -> np.ndarray:
    """Vectors of length one, in double precision, from raw values."""
    joined = b"".join(raws)
    kind = "<f4" if len(joined) == 4 * size * len(raws) else "<f8"
    v = np.frombuffer(joined, dtype=kind).reshape(len(raws), size).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True, initial=0)  # first, so that no square overflows
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def principal_axes(reps: DataFrame, size: int, wanted: int) -> np.ndarray:
    """Leading principal dimensions as columns, by subspace iteration.

    A round sums each vector, weighted by its projections, so ``size * (wanted + 1)`` numbers reach the
    driver. Any axes give right results; better ones exclude more.
    """
    axes = np.linalg.qr(np.random.default_rng(20260101).normal(size=(size, wanted)))[0]
    for _ in range(ROUNDS):

        def work(batch, axes=axes):
            u = unit_vectors(batch.column("raw").to_pylist(), size)
            weights = np.hstack([u @ axes, np.ones((len(u), 1))])
            return {"at": np.arange(size * (wanted + 1)), "value": (u.T @ weights).ravel(), "n": [len(u)] * (size * (wanted + 1))}

        parts = in_arrow(reps.select("raw"), work, "at int, value double, n bigint")
        rows = parts.groupBy("at").agg(F.sum("value").alias("s"), F.sum("n").alias("n")).collect()
        sums, n = np.zeros(size * (wanted + 1)), rows[0]["n"]
        sums[[r["at"] for r in rows]] = [r["s"] for r in rows]
        sums = sums.reshape(size, wanted + 1) / n
        mean = sums[:, -1]
        moved = sums[:, :-1] - np.outer(mean, mean @ axes)
        # Rounded, so that sums taken in another order give the same axes.
        axes = np.linalg.qr(np.round(moved, 12) + 1e-9 * axes)[0]
    return axes


def in_grid_order(reps: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Representatives with their projections and the block of their place in the grid order."""

    def work(batch):
        leading = unit_vectors(batch.column("raw").to_pylist(), len(axes)) @ axes
        cells = np.floor(leading[:, :GRID_DIMS] / eps).astype(np.int32)
        return {
            "rep": batch.column("rep"),
            "copies": batch.column("copies"),
            "raw": batch.column("raw"),
            "leading": [r.astype("<f8").tobytes() for r in leading],
            "cell": list(cells),
        }

    rows = "rep bigint, copies bigint, raw binary, leading binary, cell array<int>"
    placed = in_arrow(reps.select("rep", "copies", "raw"), work, rows)
    ordered = staged(placed.orderBy("cell", "rep").withColumn("at", F.monotonically_increasing_id()))
    # The id is the number of a sorted partition and the place in it: prefix sums make it a rank.
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = ordered.withColumn("part", part).join(bases, "part")
    return ranked.select(
        "rep", "copies", "raw", "leading", place.alias("place"),
        F.floor(place / BLOCK).cast("long").alias("block"),
    )


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def boxes(ranked: DataFrame, dims: int) -> DataFrame:
    """Bounding box of each block in the leading dimensions."""

    def work(batch):
        leading = matrix(batch.column("leading"))
        blocks, where = np.unique(batch.column("block").to_numpy(), return_inverse=True)
        low = np.full((len(blocks), dims), np.inf)
        high = np.full((len(blocks), dims), -np.inf)
        np.minimum.at(low, where, leading)
        np.maximum.at(high, where, leading)
        return {
            "block": np.repeat(blocks, dims),
            "dim": np.tile(np.arange(dims), len(blocks)),
            "low": low.ravel(),
            "high": high.ravel(),
        }

    parts = in_arrow(
        ranked.select("block", "leading"), work, "block bigint, dim int, low double, high double"
    )
    sides = parts.groupBy("block", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return sides.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("box")
    )


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs i <= j of blocks whose boxes are within eps, by splitting pairs of intervals."""
    n = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    depth = max(1, math.ceil(math.log(n, FAN) - 1e-9)) if n > 1 else 1
    pairs = blocks.sparkSession.range(1).select(F.lit(0).alias("i"), F.lit(0).alias("j"))
    side = F.sequence(F.lit(0), F.lit(FAN - 1))
    for level in range(depth - 1, -1, -1):
        nodes = _interval_boxes(blocks, FAN**level)
        pairs = pairs.withColumn("di", F.explode(side)).withColumn("dj", F.explode(side))
        pairs = pairs.select(
            (F.col("i") * FAN + F.col("di")).alias("i"), (F.col("j") * FAN + F.col("dj")).alias("j")
        ).filter("i <= j")
        pairs = pairs.join(nodes.select(F.col("node").alias("i"), F.col("box").alias("a")), "i")
        pairs = pairs.join(nodes.select(F.col("node").alias("j"), F.col("box").alias("b")), "j")
        gap = F.aggregate(
            F.zip_with(
                "a", "b", lambda x, y: F.greatest(x.low - y.high, y.low - x.high, F.lit(0.0))
            ),
            F.lit(0.0),
            lambda total, d: total + d * d,
        )
        pairs = pairs.filter(gap <= eps * eps).select("i", "j")
    return pairs


def _interval_boxes(blocks: DataFrame, width: int) -> DataFrame:
    """Boxes of intervals of ``width`` blocks."""
    if width == 1:
        return blocks.select(F.col("block").alias("node"), "box")
    parts = blocks.select(F.floor(F.col("block") / width).cast("long").alias("node"), F.explode("box").alias("s"))
    sides = parts.groupBy("node", "s.dim").agg(
        F.min("s.low").alias("low"), F.max("s.high").alias("high")
    )
    return sides.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("box")
    )


class Intervals:
    """Vectors in grid order; joins intervals of them recursively."""

    def __init__(self, unit, leading, threshold, eps, links):
        self.unit, self.leading = unit, leading
        self.single = unit.astype(np.float32)
        self.threshold, self.eps, self.links = threshold, eps, links

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Links between interval a and interval b, which are equal or do not meet."""
        if self.apart(a, b):
            return
        if a == b:
            if a[1] - a[0] <= LEAF:
                return self.leaf(a, b)
            left, right = self.halves(a)
            self.join(left, left)
            self.join(left, right)
            return self.join(right, right)
        if max(a[1] - a[0], b[1] - b[0]) <= LEAF:
            return self.leaf(a, b)
        for x in self.halves(a) if a[1] - a[0] > LEAF else [a]:
            for y in self.halves(b) if b[1] - b[0] > LEAF else [b]:
                self.join(x, y)

    @staticmethod
    def halves(a: tuple[int, int]) -> list[tuple[int, int]]:
        middle = (a[0] + a[1]) // 2
        return [(a[0], middle), (middle, a[1])]

    def apart(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        x, y = self.leading[slice(*a)], self.leading[slice(*b)]
        gap = np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0))
        gap = np.maximum(gap, 0)
        return float(gap @ gap) > self.eps**2

    def leaf(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        near = self.single[slice(*a)] @ self.single[slice(*b)].T
        x, y = np.nonzero(near >= self.threshold - SLACK)
        x, y = x + a[0], y + b[0]
        if a == b:
            x, y = x[x < y], y[x < y]
        exact = np.empty(len(x))
        for k in range(0, len(x), 1 << 15):
            few = slice(k, k + (1 << 15))
            exact[few] = np.einsum("ij,ij->i", self.unit[x[few]], self.unit[y[few]])
        on = exact >= self.threshold
        self.links.add(x[on], y[on])


def links_of_size(reps: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between vectors of one length (rep, copies, raw), summed up by block pairs."""
    eps = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)
    axes = principal_axes(reps, size, min(BOX_DIMS, size))
    ranked = staged(in_grid_order(reps, axes, eps))
    pairs = near_blocks(staged(boxes(ranked, axes.shape[1])), eps)
    tagged = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # Raw values travel; the rest is taken from them again.
    groups = ranked.drop("leading").join(tagged, "block")
    schema = arrow_schema(COLUMNS)

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        links = Links(group.column("rep").to_numpy(), group.column("copies").to_numpy())
        unit = unit_vectors(group.column("raw").to_pylist(), size)
        seq = Intervals(unit, unit @ axes, threshold, eps, links)
        middle = int(np.searchsorted(group.column("block").to_numpy(), j)) if i != j else 0
        n = group.num_rows
        seq.join((0, n), (0, n)) if i == j else seq.join((0, middle), (middle, n))
        found = links.columns()
        return pa.table([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return staged(groups.groupBy("i", "j").applyInArrow(work, COLUMNS))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For every vector its number of links and the component it belongs to.

    ``vectors`` has vec_id and embedding (an array of floats or doubles); other columns are
    ignored. Returned per row: ``vec_id``, ``n_links``, ``component_id`` (the least vec_id reachable
    by links) and ``kept`` (whether it is the row's own). A vector that is null, empty, zero, or holds
    a null or non-finite component links with nothing, and neither does one without a vec_id, whose
    component is null and which is kept. Vectors of different lengths do not link; those of each length
    are joined by themselves. Different vectors under one vec_id are vectors of their own, each with
    its links; rows that repeat an id with its vector count once. An empty table gives no rows.
    """
    held = staged(usable_vectors(vectors))
    usable = held.filter("key IS NOT NULL")
    copies = usable.select("key", "vec_id").distinct().groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies")
    )
    raws = usable.groupBy("key").agg(F.first("raw").alias("raw"), F.first("size").alias("size"))
    # Numbered in order of their ids: of linked vectors the least number is that of the least id.
    ordered = copies.join(raws, "key").orderBy("least", "key")
    reps = staged(ordered.withColumn("rep", F.monotonically_increasing_id()))
    sizes = [r[0] for r in reps.select("size").distinct().collect()]  # one row for each length there is
    none = held.sparkSession.createDataFrame([], COLUMNS)
    each = [links_of_size(reps.filter(F.col("size") == n), n, threshold) for n in sorted(sizes)]
    found = reduce(DataFrame.unionByName, each, none)
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    names = reps.select(F.col("rep").alias("component"), F.col("least").alias("component_id"))
    named = staged(joined.join(names, "component").select(F.col("node").alias("rep"), "component_id"))
    known = reps.select("key", "rep", "least", "copies").join(counts, "rep", "left").join(named, "rep", "left")
    # Staged, so that its size is known and a frequent key of the rows can be split.
    known = staged(
        known.select(
            "key",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component_id", "least").alias("least"),
        )
    )
    component = F.coalesce("least", "vec_id")
    return held.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


@query("op7_epsilon_grid_join")
def op7_epsilon_grid_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""Embedding near-duplicates by an epsilon grid order join.

Vectors are sorted by the cells of a grid on their leading principal dimensions; the grid is as wide as the distance
that the cosine allows. The sequence is cut into blocks. Blocks whose boxes are farther apart than that distance are
never paired; pairs that are left are joined recursively by halving intervals of the sequence, again skipping distant
ones, down to small matrix products. Pairs of blocks are dealt to cells, rows of blocks by columns of blocks, and a block is
sent to a cell once, however many pairs it has there. A cell reports link counts and a spanning forest, never its pairs, so
dense groups cost no more output than sparse ones. Equal vectors are one vector with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, stored
from .components import connected_components

LEAD = 6
BLOCK = 2048
LEAF = 128
#: Blocks along one side of a cell, at most, and numbers that one side may hold.
SIDE, SIDE_NUMBERS = 4, 1 << 22
#: Vectors that the principal dimensions are taken from, at most, and numbers that may be taken for them.
FIT_ROWS, FIT_NUMBERS = 20_000, 4_000_000
EDGE = 1e-9
#: Grid cells that a box may touch where blocks meet, at most; it sets the number of dimensions.
MEETING_CELLS = 4096


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not empty, all components finite, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by their largest component first, so none overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal(vectors: DataFrame, lead: int) -> dict[int, np.ndarray]:
    """Leading principal directions (dims x lead) per vector length, from a bounded sample. Any orthonormal directions
    give the same links, better ones skip more."""
    bases = {}
    for (size,) in vectors.groupBy("size").count().where("count > 0").select("size").toLocalIterator():
        rows = max(2, min(FIT_ROWS, FIT_NUMBERS // size))
        sample = vectors.where(F.col("size") == size).orderBy(F.xxhash64("key")).limit(rows).select("vector").toPandas()
        v = unit(np.stack(sample["vector"].to_numpy()))
        _, axes = np.linalg.eigh(v.T @ v)
        bases[size] = axes[:, ::-1][:, :lead]
    return bases


def _gap(lo_a, hi_a, lo_b, hi_b) -> float:
    """Square of the least distance between two boxes."""
    apart = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((apart * apart).sum())


def rounding(size: int) -> float:
    """How far a cosine in single precision may be off: rounding both vectors, the products and their sum in any order
    adds less than (size + 4) roundings of 2 ** -24, as the products of two unit vectors sum to one at most."""
    return (size + 4) * 2.0**-24 * 1.01


class Block:
    """A stretch of the sequence with the boxes of its leaves."""

    def __init__(self, size: int, keys: bytes, copies: bytes, vectors: bytes, lead: bytes, kind: str) -> None:
        self.keys, self.copies = np.frombuffer(keys, dtype="<i8"), np.frombuffer(copies, dtype="<i8")
        self.unit = unit(np.frombuffer(vectors, dtype=kind).reshape(-1, size))
        self.short = self.unit.astype(np.float32)
        places = np.frombuffer(lead, dtype="<f8").reshape(len(self.keys), -1)
        starts = np.arange(0, len(self.keys), LEAF)
        self.lo, self.hi = np.minimum.reduceat(places, starts), np.maximum.reduceat(places, starts)
        self.counts = np.zeros(len(self.keys), dtype=np.int64)

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, (i + 1) * LEAF)


class Forest:
    """Union-find over keys."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _leaf_links(a: Block, b: Block, i: int, j: int, least: float, forest: Forest) -> None:
    """Counts and joins the links between two leaves. Cosines are taken in single precision and, near the limit, again
    in double."""
    sa, sb = a.leaf(i), b.leaf(j)
    cosine = a.short[sa] @ b.short[sb].T
    hit = cosine >= least
    doubt = np.abs(cosine - least) <= rounding(a.unit.shape[1])
    if doubt.any():
        x, y = np.nonzero(doubt)
        hit[x, y] = np.einsum("ij,ij->i", a.unit[sa][x], b.unit[sb][y]) >= least
    same = a is b and i == j
    if same:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return
    a.counts[sa] += hit @ b.copies[sb]
    if not same:
        b.counts[sb] += hit.T @ a.copies[sa]
    # smallest label over links until nothing changes: the leaves' components
    keys_a, keys_b = a.keys[sa], b.keys[sb]
    label_a, label_b, top = keys_a.copy(), keys_b.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(label_a, np.where(hit, label_b[None, :], top).min(axis=1))
        new_b = np.minimum(label_b, np.where(hit, new_a[:, None], top).min(axis=0))
        if np.array_equal(new_a, label_a) and np.array_equal(new_b, label_b):
            break
        label_a, label_b = new_a, new_b
    for keys, labels, linked in ((keys_a, label_a, hit.any(axis=1)), (keys_b, label_b, hit.any(axis=0))):
        for key, label in zip(keys[linked].tolist(), labels[linked].tolist(), strict=True):
            forest.union(key, label)


def join_blocks(a: Block, b: Block, least: float, reach: float, forest: Forest) -> None:
    """Recursive join of two sequence intervals, in leaves; ``reach`` is the largest squared distance of a link."""
    todo = [(0, len(a.lo), 0, len(b.lo))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a is b and a0 >= b1:
            continue  # the mirrored half
        if _gap(a.lo[a0:a1].min(axis=0), a.hi[a0:a1].max(axis=0), b.lo[b0:b1].min(axis=0), b.hi[b0:b1].max(axis=0)) > reach + EDGE:
            continue
        if a1 - a0 == 1 and b1 - b0 == 1:
            if a is not b or a0 <= b0:
                _leaf_links(a, b, a0, b0, least, forest)
        elif a1 - a0 >= b1 - b0:
            middle = (a0 + a1) // 2
            todo += [(a0, middle, b0, b1), (middle, a1, b0, b1)]
        else:
            middle = (b0 + b1) // 2
            todo += [(a0, a1, b0, middle), (a0, a1, middle, b1)]


def _joined(least: float, reach: float, kind: str):
    names = ("keys", "copies", "vectors", "lead")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """All block pairs of one cell. Two blocks are open at a time; the others wait as bytes."""
        packed = {r["block"]: r for r in rows.to_dict("records")}
        opened = lambda n: Block(packed[n]["size"], *(packed[n][name] for name in names), kind)
        counts: dict[int, np.ndarray] = {}
        forest, a, at = Forest(), None, None
        for left, right in sorted((p["a"], p["b"]) for p in rows["pairs"].iloc[0]):
            if left != at:
                a, at = opened(left), left
            b = a if left == right else opened(right)
            a.counts[:] = 0
            join_blocks(a, b, least, reach, forest)
            for number, block in {left: a, right: b}.items():
                counts[number] = counts.get(number, 0) + block.counts
        found = [
            (k, n, forest.root(k))
            for number, links in counts.items()
            for k, n in zip(np.frombuffer(packed[number]["keys"], dtype="<i8").tolist(), links.tolist(), strict=True) if n
        ]
        return pd.DataFrame(found, columns=["key", "n_links", "root"], dtype=np.int64)

    return run


def _projected(bases: dict[int, np.ndarray], width: float, lead: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            places = np.zeros((len(rows), lead))
            for size in rows["size"].unique():
                own = (rows["size"] == size).to_numpy()
                part = unit(np.stack(rows["vector"][own].to_numpy())) @ bases[size]
                places[own, : part.shape[1]] = part
            yield rows.assign(lead=list(places), cells=list(np.floor(places / width).astype(np.int32)))

    return run


def _blocks(kind: str):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        lead = np.stack(rows["lead"].to_numpy()).astype("<f8")
        raw = lambda c: rows[c].to_numpy().astype("<i8").tobytes()
        vectors = np.stack(rows["vector"].to_numpy()).astype(kind)
        return pd.DataFrame(
            [(int(key[0]), int(key[1]), raw("key"), raw("copies"), vectors.tobytes(), lead.tobytes(), lead.min(axis=0), lead.max(axis=0))],
            columns=["size", "block", "keys", "copies", "vectors", "lead", "lo", "hi"],
        )

    return pack


def _in_order(rows: DataFrame, lead: int, block: int) -> DataFrame:
    """Adds ``place`` in the grid order and ``block``. Only one count per partition passes the driver."""
    cells = [F.col("cells")[i] for i in range(lead)]
    dealt = rows.repartitionByRange("size", *cells, "key").sortWithinPartitions("size", *cells, "key")
    marked = stored(dealt.withColumns({"part": F.spark_partition_id(), "within": F.monotonically_increasing_id()}), "grid_order")
    counts = marked.groupBy("part").agg(F.count("*").alias("n"), F.min("within").alias("first")).orderBy("part").collect()
    before, total = {}, 0
    for c in counts:
        before[c["part"]], total = total - c["first"], total + c["n"]
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")] if before else F.lit(0)
    place = F.col("within") + shift
    return marked.withColumn("place", place).withColumn("block", F.floor(F.col("place") / block))


def _axes(width: float, lead: int) -> int:
    """Leading dimensions whose cells blocks meet over: as many as keep the cells that one box can touch few."""
    along = int(2 / width) + 3
    return max(1, max(d for d in range(lead + 1) if along**d <= MEETING_CELLS or d == 0))


def _pairs(blocks: DataFrame, width: float, reach: float, lead: int) -> DataFrame:
    """Pairs (size, a, b), a <= b, of blocks whose boxes are within reach, each once.

    Blocks meet over the grid cells of several dimensions that their boxes touch, one box a cell wider on each side, and a
    pair is told in the first cell that both touch. As blocks are stretches of the grid order, all but those over the borders
    of cells, whose number does not grow with the rows, touch one cell in each of these dimensions."""
    step = width * (1 + 1e-6)  # wider than the reach by more than rounding
    axes = range(min(lead, _axes(width, lead)))
    cell = lambda c, i: F.floor(F.col(c)[i] / step)
    left = blocks.select("size", F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = blocks.select("size", F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    for i in axes:
        left = left.withColumn(f"cell{i}", F.explode(F.sequence(cell("lo_a", i) - 1, cell("hi_a", i) + 1)))
        right = right.withColumn(f"cell{i}", F.explode(F.sequence(cell("lo_b", i), cell("hi_b", i))))
    gaps = [F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]) for i in range(lead)]
    near = reduce(lambda x, y: x + y, [g * g for g in gaps]) <= reach + EDGE
    first = reduce(lambda x, y: x & y, [F.col(f"cell{i}") == F.greatest(cell("lo_a", i) - 1, cell("lo_b", i)) for i in axes])
    met = left.join(right, ["size", *(f"cell{i}" for i in axes)])
    return met.where((F.col("a") <= F.col("b")) & first & near).select("size", "a", "b")


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, lead: int = LEAD, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: the number of other rows with cosine of at least ``least``,
    the smallest vec_id reachable over links, and whether that is the row's own.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, and so do vectors of
    different lengths. Repeated rows are links of each other. A NULL vec_id takes part; a component without any id has
    a NULL component_id. The output has a row per input row; an empty table gives none."""
    spark = rows.sparkSession
    ship_package(spark)
    bound_batches(spark)
    element = rows.schema[vector_col].dataType.elementType.simpleString()
    kind, element = ("<f4", "float") if element == "float" else ("<f8", "double")
    given = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("vector"))
    fit = usable(F.col("vector"))
    reach = max(0.0, 2 - 2 * least)
    width = max(1e-6, float(np.sqrt(reach)))
    groups = given.where(fit).groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    groups = stored(groups.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("key")), "vectors")
    bases = principal(groups, lead)
    kinds = f"key bigint, copies bigint, size int, vector array<{element}>"
    projected = groups.select("key", "copies", "size", "vector").mapInPandas(_projected(bases, width, lead), f"{kinds}, lead array<double>, cells array<int>")
    ordered = _in_order(projected, lead, block).select("size", "block", "place", "key", "copies", "vector", "lead")
    made = "size int, block bigint, keys binary, copies binary, vectors binary, lead binary, lo array<double>, hi array<double>"
    blocks = stored(ordered.groupBy("size", "block").applyInPandas(_blocks(kind), made), "blocks")
    pairs = _pairs(blocks, width, reach, lead)
    # a cell has SIDE x SIDE pairs at most, and each of its blocks once
    side = F.least(F.lit(SIDE), F.greatest(F.lit(1), F.floor(F.lit(SIDE_NUMBERS) / (F.col("size") * block)))).cast("int")
    cell = ["size", "row", "col"]
    dealt = pairs.withColumns({"row": F.floor(F.col("a") / side), "col": F.floor(F.col("b") / side)})
    cells = dealt.groupBy(*cell).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    sent = cells.withColumn("block", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"]))))))
    sent = sent.join(blocks.select("size", "block", "keys", "copies", "vectors", "lead"), ["size", "block"])
    found = sent.groupBy(*cell).applyInPandas(_joined(least, reach, kind), "key bigint, n_links bigint, root bigint")
    found = stored(found, "found")
    counts = found.groupBy("key").agg(F.sum("n_links").alias("linked"))
    labels = connected_components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    placed = groups.select("vector", "copies", "first_id", "key").join(labels, "key", "left").join(counts, "key", "left")
    placed = placed.withColumn("label", F.coalesce("label", "key"))
    placed = stored(placed, "placed")
    roots = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    links = (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    by_vector = placed.join(roots, "label").select("vector", links, "component_id")
    linked = given.where(fit).join(by_vector, "vector").select("vec_id", "n_links", "component_id")
    alone = given.where(~fit).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Near-duplicate vectors by tiled comparison in the order of principal components.

Equal vectors of a label become one row with a number of copies. All rows are turned into the axes
of their principal components, most varied first; a turn keeps every inner product. Rows of a label
are cut into tiles that lie close together in the leading axes. Two tiles are compared only if their
boxes come near enough. Within a pair of tiles inner products are accumulated a few axes at a time;
what the remaining axes can add is at most the product of both rests' norms, and a pair is given up
as soon as that cannot reach the threshold. What is left is decided in double precision on the
vectors as they came.

A pair of tiles gives back link counts and a spanning forest of what it has linked, never its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.llm.components import components
from domloom.llm.vectors import finite, grouped, listed, merged, packed, unpacked
from domloom.session import checkpointed

THRESHOLD = 0.98

#: Components of all vectors of a tile: 2,048 vectors of 64.
TILE_VALUES = 1 << 17

#: Neighbours in the first axis that are cut into tiles together.
SEGMENT = 1 << 16

#: Leading axes (and the norm of the rest) that the box of a tile covers.
BOX = 8

#: The most frequent vector lengths, up to so many components, get principal axes; others keep theirs.
LENGTHS, LONGEST = 4, 2048

#: Tiles that one tile is compared with in one task.
PIECE = 16

#: Cells of the first product, and pairs that later axes are gathered for, at a time.
CELLS, PAIRS = 1 << 20, 1 << 15

#: Bounds are taken in single precision.
SLACK = 1e-4

#: Sums this near to the threshold are taken again, pair by pair in one order.
EXACT = 1e-9


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", tile_values: int = TILE_VALUES, piece: int = PIECE,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Rows are linked if they share a label and their cosine reaches ``threshold``. ``n_links`` is
    the number of other rows linked directly, ``component_id`` the smallest id reachable by links.

    Rows with a null id or label, with a vector that is null, empty or all zero, or with a null or
    non-finite component link with nothing and are their own component. Vectors of different length
    link with nothing. Rows that repeat are copies, linked with each other. Rows that repeat an id
    with different vectors are rows of their own, each with the links of its vector. Other columns
    are ignored. An empty table gives no rows.

    Principal components are taken over all vectors; the axes decide only what is skipped.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    single = kind == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    marks = [F.xxhash64("label", "vector").alias("mark"), F.xxhash64(F.lit(1), "vector", "label").alias("other_mark")]
    marked = rows.where(usable).select("vec_id", *marks)
    classes = checkpointed(rows.where(usable).select("*", *marks).groupBy("label", "mark", "other_mark").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))

    axes = spark.sparkContext.broadcast(_principal_axes(classes))
    turned = classes.select("label", "first_id", "copies", "mark", "other_mark", "vector").mapInArrow(_turn(axes, single), _TURNED)
    tiles = checkpointed(
        turned.repartitionByRange("label", "length", "lead").sortWithinPartitions("label", "length", "lead")
        .mapInArrow(_tiles(threshold, single, tile_values), _TILED))
    near = checkpointed(_near_tiles(tiles.where("low IS NOT NULL").select("tile", "label", "length", "low", "high"), threshold))

    numbered = near.join(near.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), ["unit"]).select(
        "unit", F.pmod(F.xxhash64("tile"), F.ceil(F.col("n") / piece)).cast("int").alias("piece"), F.lit(1).alias("probe"), "tile")
    sent = checkpointed(numbered.unionByName(
        numbered.select("unit", "piece", F.lit(0).alias("probe"), F.col("unit").alias("tile")).distinct()))
    units = tiles.join(sent, ["tile"]).repartition("unit", "piece").sortWithinPartitions("unit", "piece", "probe", "tile")
    crossed = checkpointed(units.select(
        "unit", "piece", "probe", "tile", "node", "copies", "inner", "raw", "turned").mapInArrow(_cross(threshold, single), _CROSSED))

    edges = crossed.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    nodes = tiles.select("node", "first_id", "copies", "mark", "other_mark", "inner", "links")
    parts = components(edges).withColumnRenamed("id", "inner")
    joined = checkpointed(
        nodes.join(crossed.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("further")), ["node"], "left")
        .join(parts, ["inner"], "left").select(
            "mark", "other_mark", "first_id", F.coalesce("component", "inner").alias("component"),
            (F.col("links") + F.coalesce("further", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lowest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = joined.join(lowest, ["component"]).select("mark", "other_mark", "n_links", "component_id")
    linked = marked.join(found, ["mark", "other_mark"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_MOMENTS = "length int, axis int, amounts binary"
_TURNED = "label string, length int, lead float, first_id bigint, copies bigint, mark bigint, other_mark bigint, raw binary, turned binary"
_TILED = ("tile bigint, node bigint, label string, length int, first_id bigint, copies bigint, mark bigint, other_mark bigint, "
          "raw binary, turned binary, inner bigint, links bigint, low array<float>, high array<float>")
_CROSSED = "node bigint, links bigint, other bigint"


def _principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per frequent length the axes of the covariance of all unit vectors, most varied first.

    Tasks add up products of components; sums meet by (length, axis), and the driver gets one
    square matrix per length.
    """
    usual = [r["length"] for r in classes.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("length") <= LONGEST).orderBy(F.desc("n"), "length").limit(LENGTHS).collect()]
    parts = classes.where(F.size("vector").isin(usual)).select("vector").mapInArrow(_moments, _MOMENTS)
    sums: dict[int, np.ndarray] = {d: np.zeros((d + 2, d)) for d in usual}
    for row in parts.repartition("length", "axis").mapInArrow(_add_moments, _MOMENTS).collect():
        sums[row["length"]][row["axis"]] += np.frombuffer(row["amounts"], dtype=np.float64)
    axes = {}
    for d, total in sums.items():
        count = max(1.0, total[d + 1][0])
        mean = total[d] / count
        _, columns = np.linalg.eigh(total[:d] / count - np.outer(mean, mean))
        axes[d] = np.ascontiguousarray(columns[:, ::-1])
    return axes


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lists as matrices, one per length: ``(length, rows, matrix)``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, listed(column if len(rows) == len(column) else column.take(pa.array(rows)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, raw in _by_length(batch.column(0)):
            unit = _unit(raw)
            total = sums.setdefault(d, np.zeros((d + 2, d)))
            total[:d] += unit.T @ unit
            total[d] += unit.sum(axis=0)
            total[d + 1] += len(unit)
    for d, total in sums.items():
        yield _moment_rows(d, np.arange(d + 2), total)


def _moment_rows(length: int, axes: np.ndarray, amounts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(axes), length), pa.int32()), pa.array(axes, pa.int32()), packed(amounts)], names=["length", "axis", "amounts"])


def _add_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["length"], row["axis"])
            sums[key] = sums.get(key, 0.0) + np.frombuffer(row["amounts"], dtype=np.float64)
    for (length, axis), amounts in sums.items():
        yield _moment_rows(length, np.array([axis]), amounts[None, :])


def _turn(axes, single: bool):
    """Vectors as they came, and in the principal axes."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, first_id, copies, mark, other_mark, vector = batch.columns
            for d, rows, raw in _by_length(vector):
                unit = _unit(raw)
                turned = (unit @ axes.value[d] if d in axes.value else unit).astype(np.float32)
                own = [c.take(pa.array(rows)) for c in (first_id, copies, mark, other_mark)]
                yield pa.RecordBatch.from_arrays(
                    [label.take(pa.array(rows)), pa.array(np.full(len(rows), d), pa.int32()), pa.array(turned[:, 0]), *own,
                     packed(raw.astype("<f4" if single else "<f8")), packed(turned)],
                    names=["label", "length", "lead", "first_id", "copies", "mark", "other_mark", "raw", "turned"])

    return turn


class Block:
    """The vectors of a tile and what its comparisons need."""

    def __init__(self, raw: pa.Array, turned: pa.Array, copies: pa.Array, single: bool):
        self.unit = _unit(unpacked(raw, "<f4" if single else "<f8"))
        self.turned = unpacked(turned, "<f4")
        self.copies = copies.to_numpy(zero_copy_only=False)
        self.stops = [k for k in (8, 16, 32, 64, 128, 256, 512, 1024) if k < self.turned.shape[1]] + [self.turned.shape[1]]
        squares = self.turned.astype(np.float64) ** 2
        self.rests = [np.sqrt(squares[:, k:].sum(axis=1)).astype(np.float32) for k in self.stops]

    def __len__(self) -> int:
        return len(self.unit)


def linked(a: Block, b: Block, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs, a bounded number at a time; with ``same`` each pair of a block once."""
    if not len(a) or not len(b):
        return
    least = np.float32(threshold - SLACK)
    height = max(1, CELLS // len(b))
    for low in range(0, len(a), height):
        rows = slice(low, low + height)
        begin = a.stops[0]
        sums = a.turned[rows, :begin] @ b.turned[:, :begin].T
        open_pairs = sums + np.outer(a.rests[0][rows], b.rests[0]) >= least
        if 8 * np.count_nonzero(open_pairs) > open_pairs.size:
            # Mostly alike: one product of whole vectors is cheaper than gathering pairs.
            sums = a.unit[rows] @ b.unit.T
            left, right = np.nonzero(sums >= threshold - EXACT)
            sums = sums[left, right]
            left += low
            if same:
                below = left < right
                left, right, sums = left[below], right[below], sums[below]
            close = np.flatnonzero(sums < threshold + EXACT)
            use = np.ones(len(left), dtype=bool)
            use[close] = np.einsum("ij,ij->i", a.unit[left[close]], b.unit[right[close]]) >= threshold
            if use.any():
                yield left[use], right[use]
            continue
        left, right = np.nonzero(open_pairs)
        sums = sums[left, right]
        left += low
        if same:
            use = left < right
            left, right, sums = left[use], right[use], sums[use]
        for at in range(0, len(left), PAIRS):
            i, j, total = left[at : at + PAIRS], right[at : at + PAIRS], sums[at : at + PAIRS]
            for number, (begin, end) in enumerate(zip(a.stops, a.stops[1:]), 1):
                total = total + np.einsum("ij,ij->i", a.turned[i, begin:end], b.turned[j, begin:end])
                use = total + a.rests[number][i] * b.rests[number][j] >= least
                i, j, total = i[use], j[use], total[use]
            use = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= threshold
            if use.any():
                yield i[use], j[use]


def _tile_places(coordinates: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Cuts places in halves across the widest coordinate until no part is larger than ``most``."""
    waiting = [np.arange(len(coordinates))]
    while waiting:
        places = waiting.pop()
        if len(places) <= most:
            yield places
            continue
        own = coordinates[places]
        order = np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")
        waiting += [places[order[: len(order) // 2]], places[order[len(order) // 2 :]]]


def _tiles(threshold: float, single: bool, tile_values: int):
    """Tiles with the links inside them: a root per group of linked rows, and link counts."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for (label, length), columns in grouped(batches, 2, SEGMENT):
            _, first_id, copies, mark, other_mark, raw, turned = columns
            lead = unpacked(turned, "<f4")[:, :BOX]
            rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", lead, lead)))
            coordinates = np.column_stack([lead, rest]).astype(np.float32)
            for places in _tile_places(coordinates, max(256, tile_values // length)):
                at = pa.array(places)
                own = [c.take(at) for c in (first_id, copies, mark, other_mark, raw, turned)]
                n = len(places)
                block = Block(own[4], own[5], own[1], single)
                roots, links = np.arange(n), np.zeros(n, dtype=np.int64)
                for i, j in linked(block, block, threshold, same=True):
                    np.add.at(links, i, block.copies[j])
                    np.add.at(links, j, block.copies[i])
                    roots = merged(roots, i, j)
                box = [pa.array([edge.tolist()] + [None] * (n - 1), pa.list_(pa.float32()))
                       for edge in (coordinates[places].min(axis=0), coordinates[places].max(axis=0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(np.arange(n) + number), pa.array([label] * n, pa.string()),
                     pa.array(np.full(n, length), pa.int32()), *own, pa.array(roots + number), pa.array(links), *box],
                    names=[f.split()[0] for f in _TILED.split(", ")])
                number += n

    return tiles


def _near_tiles(boxes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles ``(unit, tile)`` whose boxes are no further apart than linked vectors can be.

    Tiles meet in stripes of the first axis as wide as that distance; a pair is taken in the stripe
    where the later of the two begins.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold) + SLACK))
    stripe = lambda x: F.floor(x / reach).cast("int")
    striped = boxes.withColumn("first", F.col("low")[0]).withColumn(
        "stripe", F.explode(F.sequence(stripe(F.col("low")[0]), stripe(F.col("high")[0] + reach))))
    one = striped.select("label", "length", "stripe", *[F.col(c).alias(f"one_{c}") for c in ("tile", "first", "low", "high")])
    two = striped.select("label", "length", "stripe", *[F.col(c).alias(f"two_{c}") for c in ("tile", "first", "low", "high")])
    gaps = F.transform(F.sequence(F.lit(0), F.size("one_low") - 1), lambda i: F.greatest(
        F.get("one_low", i) - F.get("two_high", i), F.get("two_low", i) - F.get("one_high", i), F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0).cast("double"), lambda total, gap: total + gap * gap)
    return one.join(two, ["label", "length", "stripe"]).where("one_tile < two_tile").where(
        (F.col("stripe") == stripe(F.greatest("one_first", "two_first"))) & (apart <= reach * reach)
    ).select(F.col("one_tile").alias("unit"), F.col("two_tile").alias("tile"))


def _cross(threshold: float, single: bool):
    """Link counts of rows in different tiles, and edges that join what the tiles had linked."""

    def rows(node, links, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([node, links, other], names=["node", "links", "other"])

    def counted(nodes: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        use = links > 0
        return rows(pa.array(nodes[use]), pa.array(links[use]), pa.nulls(int(use.sum()), pa.int64()))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = nodes = inner = links = None
        for (_, _, probe, _), (node, copies, root, raw, turned) in grouped(batches, 4):
            block = Block(raw, turned, copies, single)
            node, root = (c.to_numpy(zero_copy_only=False) for c in (node, root))
            if not probe:
                if own is not None:
                    yield counted(nodes, links)
                own, nodes, inner, links = block, node, root, np.zeros(len(block), dtype=np.int64)
                continue
            further = np.zeros(len(block), dtype=np.int64)
            groups, places = np.unique(np.concatenate([inner, root]), return_inverse=True)
            joined = np.arange(len(groups))
            for i, j in linked(own, block, threshold):
                np.add.at(links, i, block.copies[j])
                np.add.at(further, j, own.copies[i])
                joined = merged(joined, places[i], places[len(own) + j])
            yield counted(node, further)
            moved = np.flatnonzero(joined != np.arange(len(groups)))
            yield rows(pa.array(groups[moved]), pa.nulls(len(moved), pa.int64()), pa.array(groups[joined[moved]]))
        if own is not None:
            yield counted(nodes, links)

    return cross

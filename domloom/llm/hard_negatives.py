"""Hard-negative mining by segment summaries.

Vectors are cut into segments, and of each segment the mean and the deviation are stored, in several
widths. A segment's part of an inner product is its length times the product of the means, plus
or minus at most the product of the deviations, so summaries bound a score from both sides. Rows
that cannot come among an anchor's results are dropped at the widest segments, the others are
bounded again by narrower ones, and only what is left is scored exactly, in whole numbers.

Anchors are dealt into blocks and rows into pieces; a task holds one block of anchors, streams one
piece and keeps the few best of each anchor. Positives are searched within a label, negatives in
the whole table, once the positives' scores have fixed the window of each anchor and positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domloom.llm.vectors import finite, listed, packed, runs, unpacked, widths
from domloom.session import checkpointed

#: Widths of segments, in the order in which bounds are taken.
SEGMENTS = (16, 4)

#: Components are whole numbers: floor(SCALE * x).
SCALE = 256

#: Anchors that a task holds, and rows that it streams past them.
BLOCK, PIECE = 4096, 4096

#: Scores taken at a time.
CELLS = 1 << 19

#: Bounds are taken in single precision: parts of the product of both norms.
SLACK = 1e-4

#: Beyond this share of open pairs, whole blocks are scored by one product.
DENSE = 0.2

_LARGEST = np.iinfo(np.int64).max


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of the components ``floor(256 * x)``. Of each row for which
    ``anchors`` holds, the best ``positives`` other rows of its label are taken, and for each the
    best ``negatives`` rows of other labels whose score lies within the two percentages of the
    positive's. Ties go to the smaller id, then to an order that only the written table decides.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no
    part. Vectors of different length are not compared. Rows that repeat count each on its own, so
    a repeated anchor gives its results again. Scores are exact; what does not fit 64 bits becomes
    the nearest number that does. Other columns are ignored. An empty table gives no rows.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector"))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"))
    numbered = rows.where(usable).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "vector")
    stored = checkpointed(numbered.mapInArrow(_summarised, _STORED))

    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    near = _sent(stored, stored.where("anchor").withColumn("windows", F.lit(None).cast(_WINDOWS)), ["label", "length"])
    chosen = checkpointed(
        near.mapInArrow(_best_positives(positives), _FOUND).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))

    windows = chosen.groupBy(F.col("anchor_row").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("place", "score"))).alias("windows"))
    asking = stored.where("anchor").join(windows, ["row"])
    far = _sent(stored, asking, ["length"])
    ranked = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    found = far.mapInArrow(_best_negatives(negatives, low_percent, high_percent), _FOUND + ", place int").withColumn(
        "rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return found.select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        chosen.select("anchor_row", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["anchor_row", "place"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_STORED = "row bigint, vec_id bigint, label string, anchor boolean, length int, numbers binary, summary binary"
_WINDOWS = "array<struct<place:int,score:bigint>>"
_FOUND = "anchor_row bigint, anchor_id bigint, row bigint, vec_id bigint, score bigint"


def summaries(numbers: np.ndarray) -> np.ndarray:
    """Per row and width of segment: means times the root of the segment's length, then deviations
    (roots of summed squares), so that bounds are products of what is stored."""
    out = []
    for width in SEGMENTS:
        begins = np.arange(0, numbers.shape[1], width)
        lengths = np.diff([*begins, numbers.shape[1]])
        sums = np.add.reduceat(numbers, begins, axis=1)
        squares = np.add.reduceat(numbers * numbers, begins, axis=1)
        out += [sums / np.sqrt(lengths), np.sqrt(np.maximum(0.0, squares - sums * sums / lengths))]
    return np.concatenate(out, axis=1).astype(np.float32)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole numbers of 4 bytes, or of 8 as doubles where a row has larger ones, with summaries."""
    for batch in batches:
        row, vec_id, label, anchor, vector = batch.columns
        lengths = vector.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            with np.errstate(over="ignore"):
                same = np.flatnonzero(lengths == d)
                numbers = np.floor(SCALE * listed(vector.take(pa.array(same))))
            numbers = np.clip(numbers, -np.finfo(np.float64).max, np.finfo(np.float64).max)
            wide = (np.abs(numbers) >= 2**31).any(axis=1)
            for places, kind in ((same[~wide], "<i4"), (same[wide], "<f8")):
                if len(places):
                    own = numbers[wide if kind == "<f8" else ~wide]
                    with np.errstate(over="ignore", invalid="ignore"):
                        summary = summaries(own)
                    at = pa.array(places)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(at) for c in (row, vec_id, label, anchor)], pa.array(np.full(len(places), d), pa.int32()),
                         packed(own.astype(kind)), packed(summary)],
                        names=["row", "vec_id", "label", "anchor", "length", "numbers", "summary"])


def _sent(stored: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Every block of anchors with every piece of the rows that have the same ``keys``, sorted so
    that a task meets the anchors first."""
    asked = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    there = stored.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    counts = checkpointed(asked.join(there, keys))
    columns = ["row", "vec_id", "label", "length", "numbers", "summary", "windows"]
    dealt = F.xxhash64("row")

    def spread(table: DataFrame, probe: int, block: Column, piece: Column) -> DataFrame:
        unit = F.xxhash64(*keys).alias("unit")
        placed = table.join(counts, keys).select(unit, block.alias("block"), "pieces", F.lit(probe).alias("probe"), *columns)
        return placed.withColumn("piece", piece).select("unit", "block", "piece", "probe", *columns)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = spread(anchors, 0, F.pmod(dealt, "blocks").cast("int"), every("pieces"))
    streamed = spread(stored.withColumn("windows", F.lit(None).cast(_WINDOWS)), 1, every("blocks"), F.pmod(F.xxhash64("row"), "pieces").cast("int"))
    return held.unionByName(streamed).repartition("unit", "block", "piece").sortWithinPartitions(
        "unit", "block", "piece", "length", "probe", "vec_id", "row")


class Rows:
    """Vectors of one length: exact numbers, norms and stored summaries. ``codes`` numbers the labels
    met so far in the unit."""

    def __init__(
        self, length: int, codes: dict[str, int], row: pa.Array, vec_id: pa.Array, label: pa.Array, numbers: pa.Array, summary: pa.Array,
    ):
        self.row, self.vec_id = (c.to_numpy(zero_copy_only=False) for c in (row, vec_id))
        names = label.dictionary_encode()
        own = np.array([codes.setdefault(name, len(codes)) for name in names.dictionary.to_pylist()], dtype=np.int64)
        self.label = own[names.indices.to_numpy(zero_copy_only=False)]
        self.numbers = np.empty((len(numbers), length))
        small = widths(numbers) == 4 * length
        for kind, use in (("<i4", small), ("<f8", ~small)):
            if use.any():
                self.numbers[use] = unpacked(numbers if use.all() else numbers.filter(pa.array(use)), kind)
        self.summary = unpacked(summary, "<f4")
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(np.einsum("ij,ij->i", self.numbers, self.numbers))

    def __len__(self) -> int:
        return len(self.row)


def bounds(a: Rows, b: Rows, span: slice, part: slice, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores by the segments of one width."""
    d = a.numbers.shape[1]
    begin = 2 * sum(-(-d // width) for width in SEGMENTS[:level])
    count = -(-d // SEGMENTS[level])
    means, rests = slice(begin, begin + count), slice(begin + count, begin + 2 * count)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = a.summary[span, means] @ b.summary[part, means].T
        apart = a.summary[span, rests] @ b.summary[part, rests].T
        apart += (SLACK * a.norm[span, None] * b.norm[part]).astype(np.float32) + np.float32(1)
        return np.nan_to_num(middle - apart, nan=-np.inf), np.nan_to_num(middle + apart, nan=np.inf)


def _limited(number: int) -> int:
    return max(-_LARGEST - 1, min(_LARGEST, number))


def exact_scores(a: Rows, b: Rows, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows as 64-bit numbers."""
    out = np.empty(len(left), dtype=np.int64)
    for at in range(0, len(left), 1 << 15):
        i, j = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
        # Sums of whole numbers below 2**53 are exact in any order.
        with np.errstate(over="ignore"):
            safe = a.norm[i] * b.norm[j] < 2**53
        score = np.zeros(len(i), dtype=np.int64)
        score[safe] = np.einsum("ij,ij->i", a.numbers[i[safe]], b.numbers[j[safe]]).astype(np.int64)
        for k in np.flatnonzero(~safe):
            total = sum(int(x) * int(y) for x, y in zip(a.numbers[i[k]], b.numbers[j[k]]))
            score[k] = _limited(total)
        out[at : at + (1 << 15)] = score
    return out


def scored(a: Rows, b: Rows, floor: np.ndarray, ceiling: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` and scores of all pairs whose score may lie between an anchor's
    ``floor`` and ``ceiling``, a bounded number at a time. Both may move between two results."""
    height = max(1, CELLS // max(1, len(b)))
    for low in range(0, len(a), height):
        span, whole = slice(low, min(len(a), low + height)), slice(0, len(b))
        open_pairs = np.ones((span.stop - low, len(b)), dtype=bool)
        for level in range(len(SEGMENTS)):
            if level and np.count_nonzero(open_pairs) <= DENSE * open_pairs.size:
                break
            least, greatest = bounds(a, b, span, whole, level)
            open_pairs &= (greatest >= floor[span, None]) & (least <= ceiling[span, None])
        left, right = np.nonzero(open_pairs)
        if len(left) > DENSE * open_pairs.size and a.norm[span].max(initial=0) * b.norm.max(initial=0) < 2**53:
            score = (a.numbers[span] @ b.numbers.T)[left, right].astype(np.int64)
        else:
            left, right = _narrowed(a, b, left, right, low, floor, ceiling)
            score = exact_scores(a, b, left + low, right)
        left = left + low
        use = (score >= floor[left]) & (score <= ceiling[left])
        yield left[use], right[use], score[use]


def _narrowed(a: Rows, b: Rows, left, right, low, floor, ceiling) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the narrowest segments leave open."""
    d = a.numbers.shape[1]
    begin = 2 * sum(-(-d // width) for width in SEGMENTS[:-1])
    count = -(-d // SEGMENTS[-1])
    keep = np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), 1 << 15):
        part = slice(at, at + (1 << 15))
        i, j = left[part] + low, right[part]
        with np.errstate(over="ignore", invalid="ignore"):
            one, two = a.summary[i, begin:], b.summary[j, begin:]
            middle = np.einsum("ij,ij->i", one[:, :count], two[:, :count])
            apart = np.einsum("ij,ij->i", one[:, count:], two[:, count:]) + SLACK * a.norm[i] * b.norm[j] + 1
            keep[part] = ~((middle + apart < floor[i]) | (middle - apart > ceiling[i]))
    return left[keep], right[keep]


def _first(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, sorted by group and in the order of results."""
    order = np.lexsort((row, vec_id, ~score, group))
    ordered = group[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=int)
    rank = np.arange(len(ordered)) - np.repeat(begins, np.diff([*begins, len(ordered)]))
    return order[rank < most]


class Best:
    """The first few rows of each group so far, and the score that a further row has to reach."""

    def __init__(self, groups: int, most: int):
        self.most, self.kept = most, [np.zeros(0, dtype=np.int64)] * 4
        self.least = np.full(groups, -_LARGEST - 1, dtype=np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        new = _first(group, score, vec_id, row, self.most)
        found = [np.concatenate([old, c[new]]) for old, c in zip(self.kept, (group, score, vec_id, row))]
        order = _first(*found, self.most)
        self.kept = [c[order] for c in found]
        last = np.flatnonzero(np.bincount(self.kept[0], minlength=len(self.least))[self.kept[0]] == self.most)[self.most - 1 :: self.most]
        self.least[self.kept[0][last]] = self.kept[1][last]


def _streams(batches: Iterator[pa.RecordBatch]):
    """``(unit, anchors, windows, rows)``: the anchors of a unit, then its rows, some at a time."""
    key, parts, held, windows, codes = None, [], None, None, {}
    for batch in batches:
        for (*own, length, probe), span in runs([*batch.columns[:3], batch.columns[7], batch.columns[3]]):
            unit = (*own, length)
            if unit != key:
                key, parts, held, codes = unit, [], None, {}
            columns = [c[span] for c in batch.columns]
            if not probe:
                parts.append(columns)
                continue
            if held is None and parts:
                joined = [pa.concat_arrays(c) for c in zip(*parts)]
                held, windows = Rows(length, codes, *_of(joined)), joined[10]
            if held is None:
                continue
            for at in range(0, len(columns[0]), 2048):
                yield key, held, windows, Rows(length, codes, *_of([c[at : at + 2048] for c in columns]))


def _of(columns: list[pa.Array]) -> list[pa.Array]:
    return [columns[k] for k in (4, 5, 6, 8, 9)]


def _found(held: Rows, anchor: np.ndarray, best: Best, **more) -> pa.RecordBatch:
    _, score, vec_id, row = best.kept
    columns = {"anchor_row": held.row[anchor], "anchor_id": held.vec_id[anchor], "row": row, "vec_id": vec_id, "score": score, **more}
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "place" else pa.int64()) for k, v in columns.items()})


def _best_positives(most: int):
    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = best = None
        for unit, anchors, _, rows in _streams(batches):
            if unit != key:
                if best is not None:
                    yield _found(held, best.kept[0], best)
                key, held, best = unit, anchors, Best(len(anchors), most)
            ceiling = np.full(len(held), _LARGEST)
            for i, j, score in scored(held, rows, best.least, ceiling):
                other = (held.row[i] != rows.row[j]) & (held.label[i] == rows.label[j])
                i, j, score = i[other], j[other], score[other]
                best.add(i, score, rows.vec_id[j], rows.row[j])
        if best is not None:
            yield _found(held, best.kept[0], best)

    return positives


def _best_negatives(most: int, low_percent: int, high_percent: int):
    def limits(windows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, least and greatest score per anchor and positive; a missing one has an empty window."""
        lists = windows.to_pylist()
        shape = (len(lists), max(map(len, lists)))
        place, floor, ceiling = np.zeros(shape, dtype=np.int64), np.full(shape, _LARGEST), np.full(shape, -_LARGEST - 1)
        for i, own in enumerate(lists):
            for k, window in enumerate(own):
                place[i, k] = window["place"]
                floor[i, k] = _limited(-(-low_percent * window["score"] // 100))
                ceiling[i, k] = _limited(high_percent * window["score"] // 100)
        return place, floor, ceiling

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = best = None

        def results() -> pa.RecordBatch:
            anchor, k = np.divmod(best.kept[0], place.shape[1])
            return _found(held, anchor, best, place=place[anchor, k])

        for unit, anchors, windows, rows in _streams(batches):
            if unit != key:
                if best is not None:
                    yield results()
                key, held = unit, anchors
                place, floor, ceiling = limits(windows)
                best = Best(floor.size, most)
            least = np.maximum(floor, best.least.reshape(floor.shape))
            usable = ceiling >= least
            lowest = np.where(usable, least, _LARGEST).min(axis=1)
            highest = np.where(usable, ceiling, -_LARGEST - 1).max(axis=1)
            for i, j, score in scored(held, rows, lowest, highest):
                other = held.label[i] != rows.label[j]
                i, j, score = i[other], j[other], score[other]
                for k in range(floor.shape[1]):
                    use = (score >= least[i, k]) & (score <= ceiling[i, k])
                    best.add(i[use] * floor.shape[1] + k, score[use], rows.vec_id[j[use]], rows.row[j[use]])
        if best is not None:
            yield results()

    return negatives

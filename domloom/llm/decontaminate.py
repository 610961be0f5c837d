"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Words of the shortest tile.
MIN_TILE = 4

#: Share of an item's words that tiles must cover for a document to count as contaminated.
MIN_COVERAGE = 0.6

#: Bytes of test items looked for in one pass over the documents. A larger benchmark takes more
#: passes; what a pass ships to the tasks does not grow.
BLOCK_BYTES = 12_000_000

# Blocks of scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Words: runs of letters, digits and underscores; of unspaced scripts every character.
WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")

#: Base of the rolling hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = (
    "doc_id bigint, item_id bigint, coverage double, matched_words bigint, item_words bigint, "
    "tiles array<struct<item_start:int,doc_start:int,words:int>>"
)
_TILE = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()),
    ("item_words", pa.int64()), ("tiles", pa.list_(_TILE)),
])


def contaminations(
    docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and test item it gives away, with the tiles as word positions.

    Words are runs of letters and digits in lower case, and single characters of scripts written
    without spaces. Seeds, ``min_tile`` words long, join the
    two texts through Karp-Rabin hashes. Tiling marks the longest match whose words are unmarked
    on both sides, again and again, until none of ``min_tile`` words is left; what covers
    ``min_coverage`` of the item counts, in whatever order the tiles stand in the document.

    Documents are neither shuffled nor copied. The benchmark is the query set: it is read in
    blocks of about ``block_bytes`` bytes, one pass over the documents each, so memory per task
    has a bound whatever its size. Whole texts are searched; a document's hits are linear in its
    words unless test items repeat each other (equal items are searched once).

    Items of fewer than ``min_tile`` words are given away by a document that has all their words in a
    row; the tile is the first such place. Null and empty texts match nothing, nor do items
    without words. Rows that repeat are reported each. Other columns are ignored. Empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [
        texts.mapInArrow(_search(block, min_tile, min_coverage), RESULT)
        for block in _blocks(benchmark, item_col, item_text_col, block_bytes)
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that give no test item away by the rule of
    ``contaminations``. Rows pass through the tasks that search them and are not shuffled."""
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(_pass(block, min_tile, min_coverage, docs.columns.index(text_col)), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator:
    """Broadcasts of the test items and their words, about ``block_bytes`` bytes each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast([(r["item_id"], WORD.findall(r["text"].lower())) for r in rows])


class ItemIndex:
    """Test items as numbers, with their seeds sorted by hash; items too short for a seed by length."""

    def __init__(self, items: Sequence[tuple[int, list[str]]], min_tile: int):
        self.min_tile = min_tile
        self.numbers: dict[str, int] = {}
        ids: dict[tuple[str, ...], list[int]] = {}
        for item_id, words in items:
            if words:
                ids.setdefault(tuple(words), []).append(item_id)
        self.ids = [sorted(x, key=lambda i: (i is None, i)) for x in ids.values()]
        self.items = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.int64) for words in ids]
        self.short: dict[int, dict[tuple[int, ...], int]] = {}
        for owner, item in enumerate(self.items):
            if len(item) < min_tile:
                self.short.setdefault(len(item), {})[tuple(item.tolist())] = owner
        seeds = [rolling_hashes(item, min_tile) for item in self.items]
        hashes = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64)
        owners = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        places = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else owners
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.places = hashes[order], owners[order], places[order]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, item positions and document positions of the seeds in a document."""
        k = self.min_tile
        known = np.concatenate([[0], np.cumsum(words > 0)])
        at = np.flatnonzero(known[k:] - known[:-k] == k) if len(words) >= k else np.zeros(0, dtype=np.int64)
        wanted = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            wanted = wanted * BASE + words[at + j].astype(np.uint64)
        low = np.searchsorted(self.hashes, wanted, "left")
        count = np.searchsorted(self.hashes, wanted, "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else low
        return self.owners[rows], self.places[rows], np.repeat(at, count)


    def short_hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """Short items that stand in a document as a whole, each with its first place."""
        for length, items in self.short.items():
            known = np.flatnonzero(words > 0)
            known = known[known + length <= len(words)]
            runs = words[known[:, None] + np.arange(length)]
            at = known[(runs > 0).all(axis=1)]
            first: dict[int, int] = {}
            for place, run in zip(at.tolist(), words[at[:, None] + np.arange(length)].tolist()):
                owner = items.get(tuple(run))
                if owner is not None:
                    first.setdefault(owner, place)
            yield from first.items()


def rolling_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of each run of ``k`` words."""
    count = max(0, len(words) - k + 1)
    hashes = np.zeros(count, dtype=np.uint64)
    for j in range(k):
        hashes = hashes * BASE + words[j : j + count].astype(np.uint64)
    return hashes


def tile(item: np.ndarray, doc: np.ndarray, places: np.ndarray, at: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item_start, doc_start, words)`` from seed hits at ``places`` and ``at``."""
    order = np.lexsort((at, at - places))
    places, at = places[order], at[order]
    same = np.flatnonzero((np.diff(at - places) != 0) | (np.diff(at) != 1)) + 1
    begins, ends = np.concatenate([[0], same]), np.concatenate([same, [len(at)]])
    heap = [(-(int(e - b) + min_tile - 1), int(at[b]), int(places[b])) for b, e in zip(begins, ends)]
    heapq.heapify(heap)
    item_marked, doc_marked = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    tiles = []
    while heap:
        length, d, i = heapq.heappop(heap)
        length = -length
        taken = item_marked[i : i + length] | doc_marked[d : d + length] | (item[i : i + length] != doc[d : d + length])
        if not taken.any():
            item_marked[i : i + length] = doc_marked[d : d + length] = True
            tiles.append((i, d, length))
            continue
        # What is left of the match goes back in line by its new length.
        free = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
        for b, e in zip(free[::2], free[1::2]):
            if e - b >= min_tile:
                heapq.heappush(heap, (-int(e - b), d + int(b), i + int(b)))
    return sorted(tiles)


def _given_away(index: ItemIndex, text: str | None, min_coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Items, by their place in the index, that a text gives away, and their tiles."""
    number = index.numbers.get
    tokens = WORD.findall(text.lower()) if text else []
    words = np.fromiter((number(t, 0) for t in tokens), dtype=np.int64, count=len(tokens))
    for owner, place in index.short_hits(words):
        yield owner, [(0, place, len(index.items[owner]))]
    owners, places, at = index.hits(words)
    order = np.argsort(owners, kind="stable")
    bounds = np.flatnonzero(np.diff(owners[order])) + 1
    for rows in np.split(order, bounds) if len(order) else []:
        owner = owners[rows[0]]
        item = index.items[owner]
        # Tiles consist of seeds, so the words under seeds bound their coverage.
        under = np.zeros(len(item) + 1, dtype=np.int64)
        seen = np.unique(places[rows])
        under[seen] += 1
        under[seen + index.min_tile] -= 1
        if (np.cumsum(under)[:-1] > 0).sum() < min_coverage * len(item):
            continue
        tiles = tile(item, words, places[rows], at[rows], index.min_tile)
        if sum(t[2] for t in tiles) >= min_coverage * len(item):
            yield owner, tiles


def _search(shipped, min_tile: int, min_coverage: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shipped.value, min_tile)
        for batch in batches:
            found = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for owner, tiles in _given_away(index, text, min_coverage):
                    matched, size = sum(t[2] for t in tiles), len(index.items[owner])
                    found += [{
                        "doc_id": doc_id, "item_id": item_id, "coverage": matched / size, "matched_words": matched,
                        "item_words": size, "tiles": [{"item_start": i, "doc_start": d, "words": n} for i, d, n in tiles],
                    } for item_id in index.ids[owner]]
            yield pa.RecordBatch.from_pylist(found, _ARROW)

    return search


def _pass(shipped, min_tile: int, min_coverage: float, place: int):
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shipped.value, min_tile)
        for batch in batches:
            clean = [next(_given_away(index, text, min_coverage), None) is None for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return passing

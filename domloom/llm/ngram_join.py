"""N-gram Jaccard self-join by T-occurrence search.

Two texts of n and m shingles reach the similarity if they share at least T of them. Shingles
are put in one global order, rare ones first. Per text, the lists of its ``n - ceil(0.8 n) + 1``
first shingles are the short lists: a pair that misses all of them cannot share T. Only short
lists are built and merged, by Spark's sort on the shingle, and occurrences in them are counted.
The long lists of the DivideSkip method are never built: whether a candidate stands in the long
lists of a text is a binary probe of its own sorted shingles.

Lists are not multiplied out. First each list compares all members with one, which a hash picks
anew for each list, so a group of near copies falls together after a number of comparisons
linear in its postings. Then only pairs of different components are left. Lists that have their
member of least hash in common are brought together. Where few sets meet there, a pair is passed on
only if what it shares there, and could share elsewhere, reaches T; the sums over all short lists
decide which pairs are compared. Where many meet, no pair is listed: the sets are cut into blocks,
each pair of blocks counts what its sets share, and gives back a spanning forest of the links
between components.

After that all similar pairs lie within components. Components whose pairs were not all found are
cut into blocks as well, and each pair of blocks counts what its sets share: frequent shingles by a
matrix product, rare ones pair by pair. Only link counts leave a block, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.llm import blobs
from domloom.llm.components import components
from domloom.session import checkpointed

WORDS = 5
PERCENT = 80

#: Counters per row of the count sketch that orders shingles; two rows, 8 MB, whatever the input.
SKETCH_BITS = 19

#: Members of a list handled as one piece; longer lists are split by a hash of the document.
PIECE = 50_000

#: Sets under one key whose pairs are listed; more are compared in blocks.
FEW = 16

#: Members of one text compared in one piece.
UNIT = 500

#: Sets, and shingles of all its sets, of a block in which links are counted.
BLOCK_SETS = 1000
BLOCK_SHINGLES = 2_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts.

    Texts are hashed together, about ``BLOCK`` bytes at a time, without an object per word: the
    hash of a word is a difference of prefix sums of its bytes times powers of a base, divided
    by the power at which it begins (the base is odd and has an inverse modulo 2**64), then mixed.
    """

    BLOCK = 1 << 20

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = self.inverses = np.zeros(0, dtype=np.uint64)

    def each(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The shingles of each text, in order."""
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            # On bytes, lower() is A-Z only.
            data = text.encode("utf-8", "surrogatepass").lower() if text else b""
            if len(data) > self.BLOCK:
                yield from self._block(waiting)
                waiting, size = [], 0
                yield self._distinct(np.concatenate([self._words(part)[0] for part in self._parts(data)]))
                continue
            waiting.append(data)
            size += len(data)
            if size > self.BLOCK:
                yield from self._block(waiting)
                waiting, size = [], 0
        yield from self._block(waiting)

    def _parts(self, data: bytes) -> Iterator[bytes]:
        """A long text, cut at white space."""
        begin = 0
        while begin < len(data):
            end = begin + self.BLOCK
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            yield data[begin:end]
            begin = end

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        hashed, starts = self._words(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        bounds = [0, *np.searchsorted(starts, ends).tolist()]
        shingles = self._shingles(hashed, self.words)
        for low, high in zip(bounds, bounds[1:]):
            if high - low < self.words:
                yield self._distinct(hashed[low:high])
            else:
                yield self._sorted(shingles[low : high - self.words + 1])

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words, cut at ASCII white space."""
        if len(data) > len(self.powers):
            size = max(len(data), self.BLOCK + 4096)
            self.powers = np.cumprod(np.full(size, BASE, dtype=np.uint64))
            self.inverses = np.cumprod(np.full(size, pow(int(BASE), -1, 2**64), dtype=np.uint64))
        chars = np.frombuffer(data, dtype=np.uint8)
        gap = np.ones(len(chars) + 2, dtype=bool)
        gap[1:-1] = (chars == 32) | (chars - np.uint8(9) <= np.uint8(4))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.powers[: len(chars)], out=sums[1:])
        hashed = (sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * OTHER
        return _mixed(hashed), starts

    @staticmethod
    def _shingles(hashed: np.ndarray, k: int) -> np.ndarray:
        count = max(0, len(hashed) - k + 1)
        shingles = np.full(count, k, dtype=np.uint64)
        for j in range(k):
            shingles ^= hashed[j : j + count]
            shingles *= BASE
            shingles ^= shingles >> np.uint64(29)
        return shingles

    def _distinct(self, hashed: np.ndarray) -> np.ndarray:
        return self._sorted(self._shingles(hashed, min(self.words, len(hashed))) if len(hashed) else hashed)

    @staticmethod
    def _sorted(values: np.ndarray) -> np.ndarray:
        values = np.sort(values)
        return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) > 1 else values


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * OTHER
    return values ^ (values >> np.uint64(29))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of its ``n`` shingles that a text shares with any similar one."""
    return -(-percent * n // 100)


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    piece: int = PIECE, block_sets: int = BLOCK_SETS, few: int = FEW, count_links: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, n_links, component_id``.

    Without ``count_links`` only components are looked for, and ``n_links`` is null.

    Nodes are the different pairs of an id and a shingle set. ``n_links`` is the number of other
    nodes whose sets are similar to the row's own set, equal sets included. Equal sets are searched
    for once, under a fingerprint of 64 bits, and count by their number of ids. The search is exact:
    no list, candidate or text is cut short.

    The passes over the documents move no text; texts that share a short list with another are
    shuffled once by set, once per comparison, and once per pair of blocks that counts links.
    Counting is quadratic in the sets of a component, as its links are. Every table of the search
    is written to the shared folder once.

    Null and empty texts, and texts without words, have no shingles and no links. Texts of fewer
    than ``words`` words are one shingle. Rows that repeat an id are one document: each row has the
    links of its own text, and all have one component. Rows with a null id are not linked and have
    a null component. Other columns are ignored. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = checkpointed(texts.mapInArrow(_measure(words), _MEASURED))
    sizes = measured.where("slice IS NULL")
    sketch = blobs.summed(measured.where("slice IS NOT NULL").select("slice", "salt", "counts"), 2 << SKETCH_BITS)
    named = checkpointed(sizes.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "node", "n").distinct())
    sets = checkpointed(named.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))

    shipped = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))
    postings = texts.mapInArrow(_post(shipped, words, percent, piece), _POSTING)
    merged = checkpointed(_merge(postings, percent))
    # Pieces of a split list meet through the members they were compared with.
    heads = checkpointed(_merge(merged.where("kind = 'head'").select(
        "token", F.lit(0).alias("salt"), F.lit(False).alias("split"), F.col("a").alias("node"), "n"), percent))
    first = checkpointed(_pairs(merged).unionByName(_pairs(heads)).distinct())
    members = merged.where("kind = 'member'").select("token", F.col("a").alias("node"), F.col("b").alias("head"), "n")

    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    candidates = checkpointed(
        texts.where("doc_id IS NOT NULL").mapInArrow(_by_node(words), "node bigint, text string")
        .join(nodes, ["node"], "left_semi").dropDuplicates(["node"]))
    links = checkpointed(_compare(first, candidates, words, percent))

    parts = components(links)
    light, heavy = _crossing_rows(_labelled(members, parts), few)
    counted = light.mapInArrow(_crossing(percent), "a bigint, b bigint, n_a int, n_b int, seen int").groupBy("a", "b").agg(
        F.sum("seen").alias("seen"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    # T-occurrence: what both share is at most what they share in the short lists and all long
    # lists of the text whose short lists end first.
    total = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    long_lists = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("n_a", "n_b")])
    second = checkpointed(counted.where(F.col("seen") + long_lists >= total).select("a", "b").join(first, ["a", "b"], "left_anti"))
    joined = checkpointed(_joined_blocks(heavy, candidates, words, percent, block_sets))
    found_more = not second.isEmpty()
    if found_more:
        links = links.unionByName(_compare(second, candidates, words, percent))
    if found_more or not joined.isEmpty():
        links = checkpointed(links.unionByName(joined).distinct())
        parts = components(links)

    degrees = sets.limit(0).select("node", F.lit(0).cast("bigint").alias("links")) if not count_links else checkpointed(_degrees(links, parts, sets, candidates, words, percent, block_sets))
    same_id = checkpointed(named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b"))
    if not same_id.isEmpty():
        parts = components(links.unionByName(
            named.join(same_id.select("doc_id", "a"), ["doc_id"]).select("a", F.col("node").alias("b")).where("a <> b")))
    grouped = sets.join(parts.withColumnRenamed("id", "node"), ["node"], "left")
    lowest = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = checkpointed(
        grouped.where("component IS NOT NULL OR copies > 1").join(lowest, ["component"], "left").join(degrees, ["node"], "left").select(
            "node", F.coalesce("component_id", "first_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    n_links = F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None).cast("bigint")
    placed = sizes.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.col("node")).alias("node"))
    return placed.join(found, ["node"], "left").select(
        "doc_id", "n_shingles", n_links.alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


_MEASURED = "doc_id bigint, n int, node bigint, slice int, salt int, counts binary"
_POSTING = "token bigint, salt int, split boolean, node bigint, n int"
_MERGED = "kind string, token bigint, a bigint, b bigint, n int"


def _fingerprint(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(shingles.tobytes())[:8], "big", signed=True)


def _counters(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles in the two rows of the sketch."""
    shift = np.uint64(64 - SKETCH_BITS)
    return (shingles >> shift).astype(np.int64), ((shingles * OTHER) >> shift).astype(np.int64) + (1 << SKETCH_BITS)


def _measure(words: int):
    """Size and fingerprint of each text, and per task how often shingles occur."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, waiting, size = Shingler(words), set(), [], 0
        counts = np.zeros(2 << SKETCH_BITS, dtype=np.int64)

        def count() -> None:
            for places in _counters(np.concatenate(waiting)) if waiting else ():
                counts[:] += np.bincount(places, minlength=len(counts))

        empty = {"slice": pa.int32(), "salt": pa.int32(), "counts": pa.binary()}
        for batch in batches:
            n, nodes = [], []
            for shingles in shingler.each(batch.column(1).to_pylist()):
                mark = _fingerprint(shingles)
                n.append(len(shingles))
                nodes.append(mark)
                if mark not in seen:
                    seen.add(mark)
                    waiting.append(shingles)
                    size += len(shingles)
                    if size > 1_000_000:
                        count()
                        waiting, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(nodes, pa.int64()),
                 *[pa.nulls(len(n), t) for t in empty.values()]],
                names=["doc_id", "n", "node", *empty],
            )
        count()
        for part in blobs.sliced(counts, TaskContext.get().partitionId()):
            blank = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, *part.columns], names=["doc_id", "n", "node", *empty])

    return measure


def _by_node(words: int):
    """Texts under their nodes, each once per task."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            nodes, fresh = [], []
            for shingles in shingler.each(batch.column(1).to_pylist()):
                mark = _fingerprint(shingles)
                nodes.append(mark)
                fresh.append(len(shingles) > 0 and mark not in seen)
                seen.add(mark)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(1)], names=["node", "text"]).filter(
                pa.array(fresh, pa.bool_()))

    return named


def _post(shipped, words: int, percent: int, piece: int):
    """Postings of the short lists: rare shingles by the sketch, ties by hash."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, sketch = Shingler(words), set(), shipped.value
        usual = int(sketch[: 1 << SKETCH_BITS].mean())
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["token", "salt", "split", "node", "n"])

        for batch in batches:
            for doc_id, shingles in zip(batch.column(0).to_pylist(), shingler.each(batch.column(1).to_pylist())):
                n = len(shingles)
                if n == 0 or doc_id is None:
                    continue
                mark = _fingerprint(shingles)
                if mark in seen:
                    continue
                seen.add(mark)
                one, two = _counters(shingles)
                often = np.minimum(sketch[one], sketch[two])
                short = n - int(needed(n, percent)) + 1
                rare = np.lexsort((shingles, often))[:short]
                pieces = np.maximum(often[rare].astype(np.int64) - usual, 0) // piece + 1
                own = (mark * int(BASE) & (2**64 - 1)) >> 33
                for column, values in zip(out, (
                    shingles[rare].view(np.int64), (own % pieces).astype(np.int32), pieces > 1,
                    np.full(short, mark), np.full(short, n, dtype=np.int32),
                )):
                    column.append(values)
                size += short
                if size > 200_000:
                    yield flush()
                    out, size = [[], [], [], [], []], 0
        yield flush()

    return post


def _merge(postings: DataFrame, percent: int) -> DataFrame:
    """Lists of at least two members, merged by Spark's sort: ``pair`` rows of each member with the
    one picked, ``member`` rows (with the one picked) of lists in which other pairs remain, ``head``
    rows of split lists."""
    lists = postings.withColumn("pick", F.xxhash64("token", "node")).repartition("token", "salt").sortWithinPartitions(
        "token", "salt", "pick", "node")
    return lists.mapInArrow(_stars(percent), _MERGED)


def _stars(percent: int):
    names = ("kind", "token", "a", "b", "n")

    def rows(kind: str, token, a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(token), pa.string()), pa.array(token, pa.int64()), pa.array(a, pa.int64()),
             pa.nulls(len(token), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n, pa.int32())], names=names)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, 2):
            # A set that several tasks have read stands in a list once.
            token, salt, _, doc, *_ = columns
            once = np.concatenate([[True], (np.diff(token) != 0) | (np.diff(salt) != 0) | (np.diff(doc) != 0)])
            token, salt, split, doc, n, _ = (c[once] for c in columns)
            new = np.flatnonzero((np.diff(token) != 0) | (np.diff(salt) != 0)) + 1
            begins = np.concatenate([[0], new])
            lengths = np.diff(np.concatenate([begins, [len(token)]]))
            head = np.repeat(begins, lengths)
            small, large = np.minimum(n, n[head]), np.maximum(n, n[head])
            use = (doc != doc[head]) & (100 * small.astype(np.int64) >= percent * large.astype(np.int64))
            a, b = np.minimum(doc, doc[head])[use], np.maximum(doc, doc[head])[use]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.zeros(0, dtype=bool)
            yield rows("pair", np.zeros(fresh.sum(), dtype=np.int64), a[fresh], b[fresh], np.zeros(fresh.sum(), dtype=np.int32))
            more = np.repeat((lengths > 2) | split[begins], lengths)
            yield rows("member", token[more], doc[more], doc[head][more], n[more])
            heads = begins[split[begins]]
            yield rows("head", token[heads], doc[heads], None, n[heads])

    return stars


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows equal in the first ``keys`` columns stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        changed = np.zeros(len(columns[0]) - 1, dtype=bool)
        for column in columns[:keys]:
            changed |= np.diff(column) != 0
        cuts = np.flatnonzero(changed)
        cut = cuts[-1] + 1 if len(cuts) else 0
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _pairs(merged: DataFrame) -> DataFrame:
    return merged.where("kind = 'pair'").select("a", "b")


def _labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of open lists with the component found so far."""
    return checkpointed(members.join(parts.withColumnRenamed("id", "node"), ["node"], "left").select(
        "token", F.coalesce("component", "node").alias("part"), "node", "head", "n"))


def _crossing_rows(labelled: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """Lists that still hold several components: rows by list of keys under which at most ``few``
    sets meet, sorted by key, and ``(key, node, part, n)`` of the other keys.

    The key of a list is its member of least hash, which the lists of a group of similar texts
    mostly have in common, so that a task sees most of what a pair shares. A pair that meets under
    a key of the second kind is settled there, whatever else it shares.
    """
    lists = labelled.groupBy("token").agg(
        F.min("part").alias("low"), F.max("part").alias("high"),
        F.min(F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("key"))).alias("least"),
    ).where("low <> high").select("token", F.col("least.key").alias("key"))
    keyed = checkpointed(labelled.join(lists, ["token"]))
    members = checkpointed(keyed.groupBy("key", "node").agg(F.max("part").alias("part"), F.max("n").alias("n")))
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > few).select("key")
    light = keyed.join(many, ["key"], "left_anti")
    # Pairs that are left share only lists of this kind.
    shared = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    rows = light.join(shared, ["node"]).repartition("key").sortWithinPartitions("key", "token", "node").select(
        "key", "token", "part", "node", "head", "n", "shared")
    return rows, members.join(many, ["key"], "left_semi")


def _pieces(rows: DataFrame, node: str = "node") -> DataFrame:
    """Rows with a number of ``blocks``, dealt into blocks by node and sent to every pair of blocks
    that has theirs: ``piece``, and whether the block is the pair's ``low`` one and its ``high`` one."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.least(x, "block") * F.col("blocks").cast("bigint") + F.greatest(x, "block"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")).withColumn("piece", F.explode(pairs))
    return dealt.withColumn("low", F.col("block") == F.expr("piece div blocks")).withColumn("high", F.col("block") == F.expr("piece % blocks"))


def _joined_blocks(heavy: DataFrame, candidates: DataFrame, words: int, percent: int, block_sets: int) -> DataFrame:
    """Links between components among the sets under a key: a spanning forest per pair of blocks."""
    blocks = heavy.groupBy("key").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / block_sets, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sent = _pieces(heavy.join(blocks, ["key"])).select("key", "piece", "low", "high", "node", "part")
    units = candidates.join(sent, ["node"]).repartition("key", "piece").sortWithinPartitions("key", "piece")
    return units.select("key", "piece", "low", "high", "node", "part", "text").mapInArrow(
        _by_unit(words, _forest(percent)), "a bigint, b bigint").distinct()


def _forest(percent: int):
    def forest(held: list[tuple]) -> pa.RecordBatch:
        rows, columns, near = _near(held, percent)
        nodes, parts = (np.array(c) for c in list(zip(*held))[2:4])
        left, right = np.nonzero(near)
        left, right = rows[left], columns[right]
        _, own = np.unique(parts, return_inverse=True)
        # One link for each two components, then only those that join what was apart.
        one, two = np.minimum(own[left], own[right]), np.maximum(own[left], own[right])
        _, first = np.unique(one * len(held) + two, return_index=True)
        root = list(range(int(own.max()) + 1))
        chosen = []
        for k in first[one[first] != two[first]].tolist():
            x, y = int(one[k]), int(two[k])
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[y] = x
                chosen.append(k)
        a, b = nodes[left[chosen]], nodes[right[chosen]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return forest


def _near(held: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the low and in the high block, and which of their sets are similar. Rows of ``held``
    begin with ``low`` and ``high`` and end with the set."""
    low, high = (np.array(c) for c in list(zip(*held))[:2])
    sets = [h[-1] for h in held]
    rows, columns = np.flatnonzero(low), np.flatnonzero(high)
    if not len(rows) or not len(columns):
        return rows, columns, np.zeros((len(rows), len(columns)), dtype=bool)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = shared_counts([sets[i] for i in rows], [sets[i] for i in columns]).astype(np.int64)
    near = (both > 0) & (100 * both >= percent * (size[rows][:, None] + size[columns] - both))
    return rows, columns, near & (rows[:, None] != columns)


def _by_unit(words: int, result):
    """``result`` of the rows of each unit, whose texts are replaced by their sets; the first two
    columns name the unit, the last is the text."""

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, key, held = Shingler(words), None, []
        for batch in batches:
            *columns, texts = (c.to_pylist() for c in batch.columns)
            for one, two, *row, own in zip(*columns, shingler.each(texts)):
                if (one, two) != key:
                    if held:
                        yield result(held)
                    key, held = (one, two), []
                held.append((*row, own))
        if held:
            yield result(held)

    return by_unit


def _crossing(percent: int):
    """Pairs of different components with the number of lists of a key they share, unless they were
    compared as member and pick of a list, or sizes or counts rule them out."""

    def found(part, doc, head, token, n, shared) -> Iterator[pa.RecordBatch]:
        ids, first, rows = np.unique(doc, return_index=True, return_inverse=True)
        own, size, lists = part[first], n[first].astype(np.int64), shared[first].astype(np.int64)
        local = np.bincount(rows)
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.concatenate([begins[1:], [len(token)]])
        at = np.repeat(np.arange(len(begins)), ends - begins)
        picked = np.searchsorted(ids, head)
        picked = np.where(ids[np.minimum(picked, len(ids) - 1)] == head, picked, -1)
        by_doc = np.split(at[np.argsort(rows, kind="stable")], np.cumsum(local)[:-1])
        # ceil(percent * n / 100) - 1 shingles stand in long lists
        rest = needed(size, percent) - 1
        values, counts = np.unique(own, return_counts=True)
        few = own != values[counts.argmax()]
        for i in np.flatnonzero(few):
            seen = np.bincount(np.concatenate([rows[begins[t] : ends[t]] for t in by_doc[i]]), minlength=len(ids))
            use = (seen > 0) & (own != own[i]) & ~(few & (ids <= ids[i]))
            use &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            use[picked[(rows == i) & (picked >= 0)]] = False
            use[rows[picked == i]] = False
            total = -(-percent * (size + size[i]) // (100 + percent))
            elsewhere = np.minimum(lists - local, lists[i] - local[i])
            use &= seen + elsewhere + np.maximum(rest, rest[i]) >= total
            others = np.flatnonzero(use)
            if len(others):
                first_one = ids[others] > ids[i]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.where(first_one, ids[i], ids[others]), pa.int64()), pa.array(np.where(first_one, ids[others], ids[i]), pa.int64()),
                    pa.array(np.where(first_one, size[i], size[others]), pa.int32()), pa.array(np.where(first_one, size[others], size[i]), pa.int32()),
                    pa.array(seen[others], pa.int32()),
                ], names=["a", "b", "n_a", "n_b", "seen"])

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, token, part, doc, head, n, shared in whole_groups(batches, 1):
            cuts = np.flatnonzero(np.diff(key) != 0) + 1
            for low, high in zip([0, *cuts], [*cuts, len(key)]):
                span = slice(low, high)
                yield from found(part[span], doc[span], head[span], token[span], n[span], shared[span])

    return crossing


def _compare(pairs: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that reach the similarity. Each ``a`` is a unit that its ``b`` are sent to, in
    pieces of about ``UNIT``, sorted so that a task holds the shingles of one ``a`` at a time."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pieces = checkpointed(pairs.join(degree, ["a"]).select(
        F.col("a").alias("unit"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / UNIT)).cast("int").alias("piece"), F.col("b").alias("node")))
    sent = pieces.select("unit", "piece", F.lit(True).alias("probe"), "node").unionByName(
        pieces.select("unit", "piece", F.lit(False).alias("probe"), F.col("unit").alias("node")).distinct())
    units = candidates.join(sent, ["node"]).repartition("unit", "piece").sortWithinPartitions("unit", "piece", "probe")
    return units.select("unit", "piece", "probe", "node", "text").mapInArrow(_probe(words, percent), "a bigint, b bigint").distinct()


def _probe(words: int, percent: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, key, held = Shingler(words), None, []
        for batch in batches:
            a, b = [], []
            *columns, texts = (c.to_pylist() for c in batch.columns)
            for unit, piece, is_probe, node, own in zip(*columns, shingler.each(texts)):
                if (unit, piece) != key:
                    key, held = (unit, piece), []
                if not is_probe:
                    held.append(own)
                elif any(similar(own, other, percent) for other in held):
                    a.append(unit)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return probe


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough: the smaller is probed in the larger by bisection."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _degrees(
    links: DataFrame, parts: DataFrame, sets: DataFrame, candidates: DataFrame, words: int, percent: int, block_sets: int,
) -> DataFrame:
    """``(node, links)``: the number of ids under the sets similar to that of each linked node.

    Where links were found between all pairs of a component, they are added up. Other components
    are dealt into blocks, and every pair of blocks is compared as a whole.
    """
    placed = checkpointed(parts.withColumnRenamed("id", "node").join(sets.select("node", "copies", "n"), ["node"]))
    pairs = links.join(parts.withColumnRenamed("id", "a"), ["a"]).groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    found = placed.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).join(pairs, ["component"])
    whole = F.col("pairs") == F.expr("m * (m - 1) / 2")
    blocks = F.ceil(F.greatest(F.col("m") / block_sets, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    marked = checkpointed(placed.join(found.select("component", whole.alias("whole"), blocks.alias("blocks")), ["component"]))

    closed = marked.where("whole")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    added = both.join(closed.select(F.col("node").alias("b"), "copies"), ["b"]).select(F.col("a").alias("node"), F.col("copies").alias("links"))

    sent = _pieces(marked.where("NOT whole")).select("component", "piece", "low", "high", "node", "copies")
    units = candidates.join(sent, ["node"]).repartition("component", "piece").sortWithinPartitions("component", "piece")
    counted = units.select("component", "piece", "low", "high", "node", "copies", "text").mapInArrow(
        _by_unit(words, _link_counts(percent)), "node bigint, links bigint")
    return added.unionByName(counted).groupBy("node").agg(F.sum("links").alias("links"))


def _link_counts(percent: int):
    def links(held: list[tuple]) -> pa.RecordBatch:
        rows, columns, near = _near(held, percent)
        nodes, copies = (np.array(c) for c in list(zip(*held))[2:4])
        counts = np.zeros(len(held), dtype=np.int64)
        counts[rows] += near @ copies[columns]
        if not np.intersect1d(rows, columns).size:
            counts[columns] += copies[rows] @ near
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64())], names=["node", "links"])

    return links


def shared_counts(rows: Sequence[np.ndarray], columns: Sequence[np.ndarray], step: int = 1024, most: int = 1 << 19) -> np.ndarray:
    """How many elements each of the sets ``rows`` shares with each of ``columns``."""
    shape = (len(rows), len(columns))
    values, at = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    owner = np.repeat(np.arange(sum(shape)), [len(s) for s in (*rows, *columns)])
    is_row = owner < shape[0]
    sides = []
    for mine, first in ((is_row, 0), (~is_row, shape[0])):
        order = np.argsort(at[mine], kind="stable")
        sides.append((at[mine][order], owner[mine][order] - first, np.bincount(at[mine], minlength=len(values))))
    (row_at, row_of, row_n), (column_at, column_of, column_n) = sides
    pairs = row_n * column_n
    total = np.zeros(shape, dtype=np.int32)

    # Frequent elements: products of indicator matrices, ``step`` elements at a time.
    often = pairs * 100 > shape[0] * shape[1]
    often &= pairs > 100
    number = np.cumsum(often) - 1
    for begin in range(0, int(often.sum()), step):
        parts = []
        for place, of, n in ((row_at, row_of, shape[0]), (column_at, column_of, shape[1])):
            use = often[place] & (number[place] >= begin) & (number[place] < begin + step)
            part = np.zeros((n, step), dtype=np.float32)
            part[of[use], number[place[use]] - begin] = 1
            parts.append(part)
        total += (parts[0] @ parts[1].T).astype(np.int32)

    # The others pair by pair: each place in ``rows`` meets those of the element in ``columns``.
    use = ~often[row_at] & (column_n[row_at] > 0)
    row_at, row_of = row_at[use], row_of[use]
    begins = (np.cumsum(column_n) - column_n)[row_at]
    lengths = column_n[row_at]
    ends = np.cumsum(lengths)
    low = 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        n = lengths[low:high]
        met = np.repeat(begins[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cells = np.repeat(row_of[low:high] * shape[1], n) + column_of[met]
        total += np.bincount(cells, minlength=shape[0] * shape[1]).reshape(shape).astype(np.int32)
        low = high
    return total

"""Divergence of sources within a language, from exact term counts.

A text is tokenised without a pattern: one table lowers A-Z and blanks every separator byte in a
single pass, ``bytes.split`` cuts at the blanks, and a ``Counter`` per document gives occurrences
and document frequencies. Tasks add up documents of a group before anything is shuffled. All that
follows works on the sparse counts: what terms that a source lacks add to a sum depends on the other
side's count alone, so it is summed over counts, not over the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domloom.llm.text import or_empty
from domloom.session import checkpointed

MIN_DOCUMENTS = 10
TOP = 10

# Terms are runs of bytes outside 00-40, 5B-60 and 7B-7F; A-Z become a-z.
_BLANKED = (range(0x00, 0x41), range(0x5B, 0x61), range(0x7B, 0x80))
TABLE = bytes(
    0x20 if any(byte in span for span in _BLANKED) else byte + 0x20 if 0x41 <= byte <= 0x5A else byte for byte in range(256)
)

#: Terms a task holds before it passes its sums on, and bytes of a text taken at a time.
HELD, PIECE = 400_000, 1 << 20

ONE = 1_000_000_000

_COUNTED = "lang string, source string, term binary, count bigint, docs bigint"


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` for every pair of language and source that occurs.

    Terms are kept per language if they are in at least ``min_docs`` of its documents. With ``count``
    the occurrences of a kept term in a group, ``N`` their sum and ``V`` the number of kept terms,
    ``p = 1 + floor(10**9 (count + 2) / (N + 2 V))``, and ``f = floor((p - q)**2 / (p + q))``.

    Part ``pair``: each other source of the language, with ``f`` summed over all kept terms, 0 where
    none is kept. Part ``term``: the ``top`` kept terms that occur in the group and have ``p`` above
    the whole language's ``q``, by ``f``. Ranks go by value, then by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty ones. A text without terms makes its group
    occur. Repeated rows and ids count each time. Other columns are ignored. An empty table gives
    no rows. All arithmetic is in whole numbers.
    """
    counts = checkpointed(term_counts(docs, text_col, lang_col, source_col))
    groups = counts.select("lang", "source").distinct()
    known = counts.where("term IS NOT NULL")
    kept = checkpointed(known.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(
        F.col("docs") >= min_docs).select("lang", "term", "total"))
    overall = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("total").alias("lang_n"))
    own = known.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "total")
    sized = groups.join(
        own.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms")), ["lang", "source"], "left",
    ).join(overall, ["lang"], "left").na.fill(0, ["n", "terms", "V", "lang_n"])
    # A group's share of a term it lacks.
    sizes = checkpointed(sized.withColumn("none", F.when(F.col("V") > 0, _share(F.lit(0), F.col("n"), F.col("V")))))
    shares = checkpointed(own.join(sizes, ["lang", "source"]).select(
        "lang", "source", "term", "none", _share(F.col("count"), F.col("n"), F.col("V")).alias("p"),
        _share(F.col("total"), F.col("lang_n"), F.col("V")).alias("q")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"),
    ).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(shares, sizes).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, count, docs)`` of all documents; each group also has a row with a null
    term, so that one without terms is not lost."""
    rows = docs.select(
        or_empty(F.col(lang_col)).alias("lang"), or_empty(F.col(source_col)).alias("source"), or_empty(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(_count, _COUNTED).groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order; those of a long one in pieces cut at blanks."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        while end < len(text) and TABLE[text[end]] != 0x20:
            end += 1
        yield text[begin:end].translate(TABLE).split()
        begin = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and document frequencies per group, summed over documents until ``HELD`` is reached."""
    counts: dict[tuple[str, str], Counter] = {}
    documents: dict[tuple[str, str], Counter] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *terms], pa.binary()),
                 pa.array([0, *terms.values()], pa.int64()), pa.array([0, *map(documents[lang, source].__getitem__, terms)], pa.int64())],
                names=["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            group = (lang, source)
            if group not in counts:
                counts[group], documents[group] = Counter(), Counter()
            own: Counter = Counter()
            total = counts[group]
            before = len(total)
            for terms in terms_of(text):
                own.update(terms)
                total.update(terms)  # the sum of all documents' counters, without a loop over their keys
            documents[group].update(own.keys())
            held += len(total) - before
            if held > HELD:
                yield from rows()
                counts, documents, held = {}, {}, 0
    yield from rows()


def _share(count: Column, n: Column, terms: Column) -> Column:
    """Parts of ``ONE``, exact for counts of any size: the product is a decimal."""
    return F.lit(1).cast("bigint") + F.call_function(
        "div", (count + 2).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(10,0)"), (n + 2 * terms).cast("decimal(19,0)"))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """``f`` of each two sources of a language, summed over its kept terms.

    Terms that both have are joined. Those of one side alone meet the other's share of a missing
    term: they are summed over all terms of that side, by share, and the joined ones taken off.
    """
    one, two = (sizes.select("lang", *[F.col(c).alias(f"{side}_{c}") for c in ("source", "terms", "none")]) for side in ("one", "two"))
    others = one.join(two, ["lang"]).where("one_source <> two_source")
    vocabulary = sizes.select("lang", "V").distinct()

    spread = shares.groupBy("lang", F.col("source").alias("one_source"), "p").agg(F.count(F.lit(1)).alias("m"))
    alone = spread.join(others, ["lang", "one_source"]).groupBy("lang", "one_source", "two_source").agg(
        F.sum(F.col("m") * _gap(F.col("p"), F.col("two_none"))).alias("alone"))

    left, right = (shares.select("lang", "term", *[F.col(c).alias(f"{side}_{c}") for c in ("source", "p", "none")]) for side in ("one", "two"))
    both = left.join(right, ["lang", "term"]).where("one_source < two_source")
    change = (_gap(F.col("one_p"), F.col("two_p")) - _gap(F.col("one_p"), F.col("two_none"))
              - _gap(F.col("one_none"), F.col("two_p")) + _gap(F.col("one_none"), F.col("two_none")))
    shared = checkpointed(both.groupBy("lang", "one_source", "two_source").agg(F.sum(change).alias("shared")))
    turned = shared.select("lang", F.col("two_source").alias("one_source"), F.col("one_source").alias("two_source"), "shared")

    key = ["lang", "one_source", "two_source"]
    alone = checkpointed(alone)
    back = alone.select("lang", F.col("two_source").alias("one_source"), F.col("one_source").alias("two_source"), F.col("alone").alias("back"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    neither = F.when(F.col("V") > 0, (F.col("V") - F.col("one_terms") - F.col("two_terms")) * _gap(F.col("one_none"), F.col("two_none")))
    return others.join(vocabulary, ["lang"]).join(alone, key, "left").join(back, key, "left").join(
        shared.unionByName(turned), key, "left",
    ).select(
        "lang", F.col("one_source").alias("source"), F.lit("pair").alias("part"), F.col("two_source").alias("item"),
        (zero("alone") + zero("back") + zero("shared") + F.coalesce(neither, F.lit(0).cast("bigint"))).alias("value"))

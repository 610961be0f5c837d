"""Small Column helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain Column used inside a lambda would be evaluated for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


STRIP = r"(?U)\A\s+|\s+\z"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, STRIP, "")


def tally(items: Column) -> Column:
    """Rows to explode for counting: ``(item, seen)``.

    Each distinct item comes once with ``seen`` true, then every occurrence with ``seen``
    false. Counting the two kinds per item gives rows and occurrences with plain partial
    sums, where ``count(distinct row)`` would shuffle every (item, row) pair. The work is
    linear in the number of items, which therefore have to be strings or numbers.
    """

    def marked(xs: Column, seen: bool) -> Column:
        return F.transform(xs, lambda x: F.struct(x.alias("item"), F.lit(seen).alias("seen")))

    return let(items, lambda xs: F.concat(marked(F.array_distinct(xs), True), marked(xs, False)))


def step_prefix(low: Column, high: Column) -> Column:
    """Longest common step prefix of two paths.

    The common prefix of a whole set of strings is the one of its minimum and maximum, so a
    group needs only ``min`` and ``max``, never its list of paths.
    """
    low, high = F.split(low, "/"), F.split(high, "/")
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b))
    length = F.coalesce(
        F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(low).cast("long")
    )
    return F.array_join(F.slice(low, F.lit(1), length.cast("int")), "/")


# -- SQL text ------------------------------------------------------------------------------
# A schema of many sections compiles to thousands of Column calls, each a round trip to the
# JVM. Those operators write SQL expressions instead, which Spark parses in one call.


def sql_literal(value: str | None) -> str:
    """A string literal that reads the same whatever the parser's escape settings are."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if re.fullmatch(r"[^'\\]*", value):
        return f"'{value}'"
    return f"decode(unhex('{value.encode().hex()}'), 'UTF-8')"


def sql_let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_replace(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, {sql_literal(pattern)}, {sql_literal(replacement)})"


def sql_strip(text: str) -> str:
    return sql_replace(text, STRIP)


def sql_whole_tags(text: str) -> str:
    """``text`` in which every ``<`` has a ``>`` behind it: after the last ``>`` no tag can end, and
    ``<`` becomes a reference there. Without that each ``<`` would make the matcher look for a
    ``>`` up to the end of the page."""
    rest = f"substring_index({text}, '>', -1)"
    shielded = f"concat(substring({text}, 1, length({text}) - length({rest})), replace({rest}, '<', '&lt;'))"
    return f"CASE WHEN contains({rest}, '<') THEN {shielded} ELSE {text} END"

"""URL functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domloom.functions.columns import let

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def url_path(url: Column) -> Column:
    """Path without query, fragment and the last segment's ``;parameters``."""
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 3), r";[^/]*$", "")


def url_valid(url: Column) -> Column:
    """Scheme and host are both present; an unbalanced ``[`` in the host is a parse failure."""
    host = url_netloc(url)
    return F.coalesce(
        (url_scheme(url) != "")
        & (host != "")
        & (host.contains("[") == host.contains("]")),
        F.lit(False),
    )


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-.]", "_")


def url_filename(url: Column, position: Column) -> Column:
    """File name for a downloaded URL; ``position`` is its 1-based place in the list."""
    number = F.when(position < 1000, F.lpad(position.cast("string"), 3, "0")).otherwise(
        position.cast("string")
    )

    def from_segments(parts: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        return (
            F.when(F.size(parts) == 0, F.concat(F.replace(url_netloc(url), F.lit("."), F.lit("_")), F.lit("_"), number))
            .when((F.size(parts) >= 2) & (F.length(last) < 5), F.concat_ws("_", F.get(parts, F.size(parts) - 2), last))
            .otherwise(last)
        )

    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    return let(
        safe_name(let(parts, from_segments)),
        lambda name: let(
            F.when(F.length(name) < 3, F.concat(F.lit("page_"), number)).otherwise(name),
            lambda n: F.when(n.endswith(".html"), n).otherwise(F.concat(n, F.lit(".html"))),
        ),
    )


def result_filename(name: Column) -> Column:
    """JSON file name for a page file name."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.html\z", ""), r"\.htm\z", "")
    return safe_name(F.concat(stem, F.lit(".json")))


def markdown_filename(result_name: Column) -> Column:
    """Markdown file name for a result file name: the stem and ``.md``."""
    return F.concat(F.regexp_replace(result_name, r"(?<=.)\.[^.]+\z", ""), F.lit(".md"))

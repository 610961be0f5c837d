"""Text normalisation shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the words of a text are its longest runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Word pattern for matching passages: runs of letters, digits and underscores.
TOKEN = re.compile(r"\w+")


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts, the bulk of most corpora, take the fast path."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that only ``key`` and ``seed`` decide: the first 52 bits of an MD5.

    Other SQL engines compute the same number, which a hash of Spark's own would not allow.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))

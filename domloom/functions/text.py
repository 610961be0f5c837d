"""Text functions over HTML source, entirely native (no Python worker).

Arguments are column names or SQL expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from domloom.functions.columns import (
    sql_let,
    sql_literal,
    sql_replace,
    sql_strip,
    sql_whole_tags,
)

# Names first that pages use most: the lookup scans in this order.
_FREQUENT = ("amp", "quot", "lt", "gt", "nbsp", "copy", "middot", "apos")
_NAMED = {n: html5[f"{n};"] for n in (*_FREQUENT, *sorted(n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in _FREQUENT))}
# Names HTML also accepts without the closing semicolon; the longest one wins.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))

_CLOSED_ENTITY = r"\A&([A-Za-z][A-Za-z0-9]*);"
_OPEN_ENTITY = r"\A&(" + "|".join(map(re.escape, _OPEN_NAMES)) + ")"
_DECIMAL = r"\A&#([0-9]+);?"
_HEX = r"\A&#[xX]([0-9A-Fa-f]+);?"

# HTML reads references to 128-159 as windows-1252, where that has a character.
_C1 = ", ".join(str(ord(bytes([c]).decode("cp1252", "ignore") or chr(c))) for c in range(128, 160))

# The rest of a start or end tag. A quote hides ``>`` up to its match; where a quote has none, or a
# tag begins outside quotes, the first ``>`` ends the tag. A quote swaps two of the three states a
# place can have (outside, in double, in single quotes), so looks ahead from different tags never
# come to the same state, and at most two of them pass any place: the search is linear.
TAG_END = r"(?:(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
COMMENT = r"<!--.*?(?:-->|\z)"
SCRIPT_STYLE = rf"<(script|style)(?=[\s/>]){TAG_END}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
DECLARATION = r"<[!?/][^>]*+>"
TAG = rf"</?[a-z]{TAG_END}"
#: All that is no text. Patterns are to be used with ``(?is)``, on text with whole tags.
MARKUP = rf"(?is){COMMENT}|{SCRIPT_STYLE}|{TAG}|{DECLARATION}"
#: The first body outside comments, scripts and other tags.
_BODY = rf"(?is)\A(?:[^<]++|{COMMENT}|{SCRIPT_STYLE}|(?!<body[\s/>]){TAG}|{DECLARATION}|<(?!body[\s/>]))*+(<body{TAG_END}.*+)"


def _split(words: Iterable[str]) -> str:
    return f"split({sql_literal(chr(1).join(words))}, {sql_literal(chr(1))})"


# Folded to one constant when a query is planned.
_NAMES = f"map_from_arrays({_split(_NAMED)}, {_split(_NAMED.values())})"


def _code_point(n: str) -> str:
    """SQL for the character of a number; a null is a number too large to be one."""
    point = """CASE WHEN n IS NULL OR n <= 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN 65533L
        WHEN n BETWEEN 128 AND 159 THEN CAST(get(array(%s), CAST(n - 128 AS INT)) AS BIGINT) ELSE n END""" % _C1
    return sql_let(n, "n", f"decode(unhex(lpad(hex({point}), 8, '0')), 'UTF-32')")


def decode_entities_sql(text: str) -> str:
    def group(pattern: str) -> str:
        return f"regexp_extract(p, {sql_literal(pattern)}, 1)"

    closed, open_name = f"names[{group(_CLOSED_ENTITY)}]", group(_OPEN_ENTITY)
    decimal, hexadecimal = group(_DECIMAL), group(_HEX)
    piece = f"""CASE
        WHEN NOT startswith(p, '&') THEN p
        WHEN {closed} IS NOT NULL THEN concat({closed}, {sql_replace('p', _CLOSED_ENTITY)})
        WHEN {open_name} != '' THEN concat(names[{open_name}], {sql_replace('p', _OPEN_ENTITY + ';?')})
        WHEN {decimal} != '' THEN concat({_code_point(f"try_cast({decimal} AS BIGINT)")}, {sql_replace('p', _DECIMAL)})
        WHEN {hexadecimal} != '' THEN concat({_code_point(f"try_cast(conv({hexadecimal}, 16, 10) AS BIGINT)")}, {sql_replace('p', _HEX)})
        ELSE p END"""
    pieces = f"transform(split(t, '(?=&)'), p -> {piece})"
    decoded = sql_let(_NAMES, "names", f"array_join({pieces}, '')")
    return sql_let(text, "t", f"CASE WHEN NOT contains(t, '&') THEN t ELSE {decoded} END")


def decode_entities(text: str) -> Column:
    """HTML character references to characters, in one pass (``&amp;lt;`` gives ``&lt;``)."""
    return F.expr(decode_entities_sql(text))


def text_content(html: str) -> Column:
    """Visible text: script and style dropped, strings stripped and joined by one blank."""
    pieces = f"split(h, {sql_literal(MARKUP)})"
    stripped = f"transform({pieces}, s -> {sql_strip(decode_entities_sql('s'))})"
    text = f"array_join(filter({stripped}, s -> s != ''), ' ')"
    return F.expr(f"coalesce({sql_let(sql_whole_tags(html), 'h', text)}, '')")


def body_content(html: str) -> Column:
    """Outer HTML of ``body``, to its last end tag if it has one; the whole input where there is none."""
    rest = f"substring_index({html}, '>', -1)"
    tagged = f"substring({html}, 1, length({html}) - length({rest}))"
    found = f"regexp_extract({tagged}, {sql_literal(_BODY)}, 2)"
    closed = f"regexp_extract(b, {sql_literal(r'(?is)\A.*</body\s*+>')}, 0)"
    body = sql_let(found, "b", f"CASE WHEN b = '' THEN {html} ELSE coalesce(nullif({closed}, ''), concat(b, {rest})) END")
    return F.expr(body)


def truncate_html(html: str, max_chars: int = 500_000, marker: str = "\n... [truncated]") -> Column:
    """Longer input is cut to ``max_chars`` characters and marked as cut."""
    cut = f"concat(substring({html}, 1, {max_chars}), {sql_literal(marker)})"
    return F.expr(f"CASE WHEN length({html}) > {max_chars} THEN {cut} ELSE {html} END")

"""HTML to Markdown as a chain of native expressions.

Only expressions whose repetitions are over single characters are used: the JVM matcher
recurses on repeated groups and would overflow its stack on long pages. Arguments are
column names or SQL expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from domloom.functions.columns import (
    sql_let,
    sql_literal,
    sql_replace,
    sql_strip,
    sql_whole_tags,
)
from domloom.functions.text import COMMENT, DECLARATION, SCRIPT_STYLE, TAG, decode_entities_sql

# Stripped text of an element; what was tried once is not tried again in another way.
_INNER = r"\s*+((?>[^<]*[^<\s]))\s*+"

# The conversion table, applied in this order.
INLINE_RULES: list[tuple[str, str]] = [
    (r"(?i)<br(?=[\s/>])[^>]*>", "\n"),
    (rf"(?i)<code(?=[\s/>])[^>]*+>{_INNER}</code>", "`$1`"),
    (rf"(?i)<(?:strong|b)(?:\s[^>]*+)?+>{_INNER}</(?:strong|b)>", "**$1**"),
    (rf"(?i)<(?:em|i)(?:\s[^>]*+)?+>{_INNER}</(?:em|i)>", "*$1*"),
    (rf"(?i)<(?:strong|b)(?:\s[^>]*+)?+>{_INNER}</(?:strong|b)>", "**$1**"),
    (rf"(?i)<(?:em|i)(?:\s[^>]*+)?+>{_INNER}</(?:em|i)>", "*$1*"),
    (r"(?i)<a(?=[\s/>])(?>[^<>]*?\shref\s*=\s*[\"']?)([^\"'\s>]*+)[^<>]*+>\s*+((?>(?:[^<]*[^<\s])?))\s*+</a>", "[$2]($1)"),
]
BLOCK_RULES: list[tuple[str, str]] = [
    (r"(?i)<hr(?=[\s/>])[^>]*>", "\n\n---\n\n"),
    (
        r"(?i)</?(?:p|div|article|section|main|header|footer|aside|nav|table|figure|form|address|dl|dt|dd)(?=[\s/>])[^>]*>",
        "\n\n",
    ),
    (r"(?i)</?(?:thead|tbody|tfoot)(?=[\s/>])[^>]*+> ?", ""),
    (r"(?i)</tr\s*+> ?<tr(?=[\s/>])[^>]*+>", "\n"),
    (r"(?i)</?(?:tr|caption|figcaption)(?=[\s/>])[^>]*>", "\n"),
    (r"(?i) ?<(?:td|th)(?=[\s/>])[^>]*> ?", "\x03"),
]
ANY_TAG = r"<[!?/A-Za-z][^>]*>"
QUOTE_OPEN, QUOTE_CLOSE, CELL = "\x01", "\x02", "\x03"
#: A page as tags and the text between them.
_TOKENS = rf"(?is){TAG}|{DECLARATION}|[^<]++|<"


def _chain(text: str, rules: list[tuple[str, str]]) -> str:
    return reduce(lambda t, rule: sql_replace(t, *rule), rules, text)


def _images(text: str) -> str:
    tag = r"(?i)\A<img(?=[\s/>])[^>]*>"

    def attribute(name: str, value: str) -> str:
        return f"regexp_extract(tag, {sql_literal(rf'(?i)\s{name}\s*=\s*{value}')}, 1)"

    alt = attribute("alt", "[\"']([^\"']*)")
    src = attribute("src", "[\"']?([^\"'\\s>]*)")
    image = sql_let(
        f"regexp_extract(p, {sql_literal(tag)}, 0)", "tag",
        f"CASE WHEN tag = '' THEN p ELSE concat('![', {alt}, '](', {src}, ')', {sql_replace('p', tag)}) END",
    )
    parts = f"split(t, {sql_literal(r'(?i)(?=<img(?=[\s/>]))')})"
    return sql_let(
        text, "t",
        f"CASE WHEN NOT contains(lower(t), '<img') THEN t ELSE array_join(transform({parts}, p -> {image}), '') END",
    )


def _headings(text: str) -> str:
    """``#`` to ``######``; cut at heading tags, so that an open heading costs one look ahead."""
    tag = sql_literal(r"(?is)\A<h([1-6])(?=[\s/>])[^>]*>\s*(.*?)\s*</h\1\s*>")
    level = f"regexp_extract(p, {tag}, 1)"
    heading = (
        f"CASE WHEN {level} = '' THEN p ELSE concat(chr(10), chr(10), repeat('#', CAST({level} AS INT)), ' ', "
        f"regexp_extract(p, {tag}, 2), chr(10), chr(10), regexp_replace(p, {tag}, '')) END"
    )
    start = r"(?i)<h[1-6](?=[\s/>])"
    parts = f"split(t, {sql_literal(f'(?={start})')})"
    return sql_let(
        text, "t",
        f"CASE WHEN NOT rlike(t, {sql_literal(start)}) THEN t ELSE array_join(transform({parts}, p -> {heading}), '') END",
    )


def _lists(text: str) -> str:
    """Items get ``- `` or ``1. `` and two blanks per nesting level.

    The text is cut at list tags; a fold over the pieces tracks the open lists.
    """
    tag = r"(?i)\A<(/?(?:ul|ol|li))(?=[\s/>])[^>]*>"
    name = f"lower(regexp_extract(p, {sql_literal(tag)}, 1))"
    mark = """CASE name
        WHEN 'li' THEN concat(chr(10), repeat('  ', greatest(length(acc.open) - 1, 0)),
                              CASE WHEN endswith(acc.open, 'o') THEN '1. ' ELSE '- ' END)
        WHEN 'ul' THEN CASE WHEN acc.open = '' THEN concat(chr(10), chr(10)) ELSE '' END
        WHEN 'ol' THEN CASE WHEN acc.open = '' THEN concat(chr(10), chr(10)) ELSE '' END
        WHEN '/ul' THEN CASE WHEN length(acc.open) <= 1 THEN concat(chr(10), chr(10)) ELSE '' END
        WHEN '/ol' THEN CASE WHEN length(acc.open) <= 1 THEN concat(chr(10), chr(10)) ELSE '' END
        ELSE '' END"""
    now = """CASE
        WHEN name = 'ul' THEN concat(acc.open, 'u')
        WHEN name = 'ol' THEN concat(acc.open, 'o')
        WHEN name IN ('/ul', '/ol') THEN substring(acc.open, 1, greatest(length(acc.open) - 1, 0))
        ELSE acc.open END"""
    step = sql_let(name, "name", f"struct({now} AS open, concat(acc.marks, array({mark})) AS marks)")
    start = "struct('' AS open, CAST(array() AS ARRAY<STRING>) AS marks)"
    marks = f"aggregate(parts, {start}, (acc, p) -> {step}, acc -> acc.marks)"
    item = (
        f"CASE WHEN regexp_extract(p, {sql_literal(tag)}, 0) = '' THEN p "
        f"ELSE concat(m, {sql_replace('p', tag + r'[ \t\n]*')}) END"
    )
    convert = sql_let(
        f"split(t, {sql_literal(r'(?i)(?=</?(?:ul|ol|li)(?=[\s/>]))')})", "parts",
        f"array_join(zip_with({marks}, parts, (m, p) -> {item}), '')",
    )
    return sql_let(
        text, "t", f"CASE WHEN NOT rlike(t, {sql_literal(r'(?i)<(?:li|ul|ol)(?=[\s/>])')}) THEN t ELSE {convert} END"
    )


def _quotes(text: str) -> str:
    opening, closing = sql_literal(QUOTE_OPEN), sql_literal(QUOTE_CLOSE)
    change = f"CASE WHEN startswith(p, {opening}) THEN 1 WHEN startswith(p, {closing}) THEN -1 ELSE 0 END"
    depths = (
        f"aggregate(parts, array(0), (acc, p) -> concat(acc, array(element_at(acc, -1) + {change})), "
        "acc -> slice(acc, 2, size(acc)))"
    )
    body = sql_replace(sql_replace("p", f"[{QUOTE_OPEN}{QUOTE_CLOSE}]"), r"\n{3,}", "\n\n")
    lines = f"transform(split({sql_strip('body')}, chr(10)), line -> rtrim(concat(repeat('> ', d), line)))"
    quoted = sql_let(
        body, "body",
        f"""CASE WHEN d <= 0 THEN body WHEN {sql_strip('body')} = '' THEN ''
            ELSE concat(chr(10), chr(10), array_join({lines}, chr(10)), chr(10), chr(10)) END""",
    )
    convert = sql_let(
        f"split(t, {sql_literal(f'(?=[{QUOTE_OPEN}{QUOTE_CLOSE}])')})", "parts",
        f"array_join(zip_with(parts, {depths}, (p, d) -> {quoted}), '')",
    )
    return sql_let(text, "t", f"CASE WHEN NOT contains(t, {opening}) THEN t ELSE {convert} END")


def _prose(html: str) -> str:
    text = _images(sql_replace(html, r"[ \t\r\n]+", " "))
    text = _chain(text, INLINE_RULES)
    text = sql_replace(text, r"(?i)<blockquote(?=[\s/>])[^>]*>", QUOTE_OPEN)
    text = sql_replace(text, r"(?i)</blockquote\s*>", QUOTE_CLOSE)
    text = _chain(_headings(text), BLOCK_RULES)
    text = sql_replace(text, r" *\n *", "\n")
    # Cells of a row are kept apart, and the first begins the line.
    text = sql_replace(sql_replace(text, rf"(\A|\n){CELL}", "$1"), CELL, " | ")
    text = sql_replace(_lists(text), ANY_TAG)
    text = sql_replace(text, r" +\n", "\n")
    return decode_entities_sql(_quotes(text))


def _plain_tags(text: str) -> str:
    """``text`` whose tags hold no ``<`` or ``>`` but their own: those in attributes become references.

    Rules can then take the next ``>`` for the end of a tag.
    """
    inside = "replace(replace(substring(p, 2, length(p) - 2), '<', '&lt;'), '>', '&gt;')"
    token = f"CASE WHEN length(p) > 2 AND startswith(p, '<') THEN concat('<', {inside}, '>') ELSE p END"
    tokens = f"regexp_extract_all(t, {sql_literal(_TOKENS)}, 0)"
    # A tag with a quote in which one of them comes before the quote ends.
    hidden = sql_literal(r"(?i)</?[a-z](?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+(?:\"[^\"<>]*+|'[^'<>]*+)[<>]")
    return sql_let(text, "t", f"CASE WHEN rlike(t, {hidden}) THEN array_join(transform({tokens}, p -> {token}), '') ELSE t END")


def html_to_markdown(html: str) -> Column:
    """Markdown for an HTML fragment or page; null stays null."""
    return F.expr(html_to_markdown_sql(html))


def html_to_markdown_sql(html: str) -> str:
    inner = sql_replace(sql_replace("c", r"(?i)\A<pre(?=[\s/>])[^>]*>\n?|</pre\s*>"), ANY_TAG)
    code = decode_entities_sql(sql_replace(inner, r"\n+\z"))
    chunk = f"""CASE WHEN rlike(c, {sql_literal(r'(?i)\A<pre(?=[\s/>])')})
        THEN concat({sql_literal(chr(10) * 2 + '```' + chr(10))}, {code}, {sql_literal(chr(10) + '```' + chr(10) * 2)})
        ELSE {_prose('c')} END"""
    clean = sql_whole_tags(sql_replace(html, f"[{QUOTE_OPEN}{QUOTE_CLOSE}{CELL}]"))
    clean = _plain_tags(sql_replace(clean, rf"(?is){SCRIPT_STYLE}|{COMMENT}"))
    chunks = f"split(h, {sql_literal(r'(?i)(?=<pre(?=[\s/>]))|(?<=</pre>)')})"
    joined = f"array_join(transform({chunks}, c -> {chunk}), '')"
    return sql_strip(sql_replace(sql_let(clean, "h", joined), r"\n{3,}", "\n\n"))


MARKUP = r"([\\`*_{}\[\]()#+.!-])"
BACKSLASHED = r"\\$1"


def markdown_escape(text: str) -> Column:
    """Backslash before every character Markdown would read as markup."""
    return F.expr(sql_replace(text, MARKUP, BACKSLASHED))


def list_items(items: str, html: bool) -> Column:
    """A Markdown list of the texts of an array that are not empty. With ``html`` those with tags are
    converted and their further lines indented; all others are escaped."""
    item = sql_replace("v", MARKUP, BACKSLASHED)
    if html:
        converted = f"replace({html_to_markdown_sql('v')}, chr(10), concat(chr(10), '  '))"
        item = f"CASE WHEN rlike(v, {sql_literal(r'</?[A-Za-z][^>]*+>')}) THEN {converted} ELSE {item} END"
    return F.expr(f"array_join(transform(filter({items}, v -> v != ''), v -> concat('- ', {item})), chr(10))")

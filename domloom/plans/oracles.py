"""The same results in ANSI SQL over the raw tables, without the parser or the operators.

Elements are found with regular expressions on the page source, which works because the
given pages follow one template; the library itself assumes no template.
"""

from __future__ import annotations

from domloom.plans import inputs
from domloom.plans.inputs import SNIPPETS, quoted


CODE = inputs.CODE


def decoded(text: str) -> str:
    """The entities the pages use; ``&amp`` last, all of them also without semicolon."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return text


def stripped(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '')"


def nodes(html: str = "html", more: str = "") -> str:
    """CTEs up to ``nodes(page_id, nid, tag, cls, seg, last_nid, gpath, xpath, text_head, full_text)``."""
    return rf"""
src AS (SELECT page_id, url, {html} AS html FROM pages{more}),
opens AS (
  SELECT page_id,
         unnest(regexp_extract_all(html, '<[a-z][^>]*>[^<]*')) AS open,
         generate_subscripts(regexp_extract_all(html, '<[a-z][^>]*>[^<]*'), 1) AS nid,
         regexp_extract(html, '<script>(.*?)</script>', 1) AS script
  FROM src),
tags AS (
  SELECT page_id, CAST(nid AS INT) AS nid, regexp_extract(open, '^<([a-z0-9]+)', 1) AS tag,
         nullif(regexp_extract(open, ' class="([^"]*)"', 1), '') AS cls,
         nullif(regexp_extract(open, ' href="([^"]*)"', 1), '') AS href,
         CASE WHEN open LIKE '<script>%' THEN script
              ELSE {decoded("regexp_extract(open, '>([^<]*)$', 1)")} END AS seg
  FROM opens),
marks AS (
  SELECT *,
    count(*) FILTER (tag = 'li') OVER w AS li_no,
    count(*) FILTER (tag = 'p') OVER w AS p_no,
    count(*) FILTER (tag = 'li') OVER q AS n_li,
    count(*) FILTER (tag = 'p') OVER q AS n_p,
    max(nid) OVER q AS n_all,
    max(nid) FILTER (tag = 'body') OVER q AS body_nid,
    max(nid) FILTER (tag = 'div') OVER q AS div_nid,
    max(nid) FILTER (tag IN ('footer', 'address')) OVER q AS footer_nid,
    max(CASE WHEN tag = 'main' THEN 'main' WHEN tag = 'article' THEN 'article' END) OVER q AS box,
    min(nid) FILTER (tag = 'p') OVER (PARTITION BY page_id ORDER BY nid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_p
  FROM tags
  WINDOW w AS (PARTITION BY page_id ORDER BY nid), q AS (PARTITION BY page_id)),
placed AS (
  SELECT *,
    coalesce(footer_nid - 1, n_all) AS box_end,
    CASE tag
      WHEN 'html' THEN 'html' WHEN 'head' THEN 'html/head' WHEN 'body' THEN 'html/body'
      WHEN 'meta' THEN 'html/head/meta' WHEN 'title' THEN 'html/head/title'
      WHEN 'style' THEN 'html/head/style' WHEN 'script' THEN 'html/head/script'
      WHEN 'nav' THEN 'html/body/nav' WHEN 'ul' THEN 'html/body/nav/ul'
      WHEN 'li' THEN 'html/body/nav/ul/li' WHEN 'a' THEN 'html/body/nav/ul/li/a'
      WHEN 'div' THEN 'html/body/div' WHEN 'footer' THEN 'html/body/footer' WHEN 'address' THEN 'html/body/address'
      WHEN 'article' THEN 'html/body/article' WHEN 'main' THEN 'html/body/main'
      WHEN 'h1' THEN 'html/body/' || box || '/h1' WHEN 'p' THEN 'html/body/' || box || '/p'
      WHEN 'b' THEN 'html/body/' || box || '/p/b' WHEN 'br' THEN 'html/body/' || box || '/p/b/br' END AS gpath,
    'li' || CASE WHEN n_li > 1 THEN '[' || li_no || ']' ELSE '' END AS li_step,
    'p' || CASE WHEN n_p > 1 THEN '[' || p_no || ']' ELSE '' END AS p_step
  FROM marks),
ranged AS (
  SELECT *,
    '/' || CASE tag
      WHEN 'li' THEN 'html/body/nav/ul/' || li_step WHEN 'a' THEN 'html/body/nav/ul/' || li_step || '/a'
      WHEN 'p' THEN 'html/body/' || box || '/' || p_step
      WHEN 'b' THEN 'html/body/' || box || '/' || p_step || '/b'
      WHEN 'br' THEN 'html/body/' || box || '/' || p_step || '/b/br'
      ELSE gpath END AS xpath,
    CASE WHEN tag IN ('html', 'body') THEN n_all WHEN tag = 'head' THEN body_nid - 1
      WHEN tag IN ('nav', 'ul') THEN div_nid - 1 WHEN tag IN ('article', 'main') THEN box_end
      WHEN tag = 'p' THEN coalesce(next_p - 1, box_end) WHEN tag IN ('li', 'b') THEN nid + 1 ELSE nid END AS last_nid,
    nullif(seg, '') AS text_head
  FROM placed),
nodes AS (
  SELECT r.*, (SELECT string_agg(s.seg, '' ORDER BY s.nid) FROM tags s
               WHERE s.page_id = r.page_id AND s.nid BETWEEN r.nid AND r.last_nid) AS full_text
  FROM ranged r)"""


VARIED = inputs.VARIED_HTML
N = f"WITH {nodes()}"
EMPTY_ROWS = " UNION ALL " + inputs.EMPTY_ROWS.format(text="VARCHAR", pages="pages")
NV = f"WITH {nodes(VARIED, EMPTY_ROWS)}"

# name, type, description, tags, child tags of the box for lists of paragraphs
SECTION_ROWS = """
rules AS (SELECT * FROM (VALUES
  ('title', 'title', 'Main heading or document title', 'h1'),
  ('body', 'body', 'Main content', 'article'), ('body', 'body', 'Main content', 'main'),
  ('body_paragraphs', 'body', 'Paragraphs of the main content', 'p'),
  ('navigation', 'other', 'Navigation block', 'nav'), ('nav_links', 'other', 'Navigation links', 'a'),
  ('footer', 'other', 'Page footer', 'footer'), ('ad', 'other', 'Advertisement', 'div')
) AS t(section, type, description, tag)),
hits AS (SELECT n.*, section, type, description, row_number() OVER (PARTITION BY page_id, section ORDER BY nid) AS hit
         FROM nodes n JOIN rules USING (tag)),
sections AS (
  SELECT page_id, section, any_value(type) AS type, any_value(description) AS description,
         max(xpath) FILTER (hit = 1) AS xpath, max(gpath) FILTER (hit = 1) AS gpath, max(cls) FILTER (hit = 1) AS cls,
         count(*) > 1 AS is_list, count(*) AS n_matches, max(full_text) FILTER (hit = 1) AS full_text
  FROM hits GROUP BY page_id, section),
total AS (SELECT count(*) AS total FROM pages),
variants AS (
  SELECT section, gpath, any_value(type) AS type, any_value(description) AS description,
         count(DISTINCT page_id) AS pages, count(*) AS matches,
         count(*) FILTER (hit = 1) AS lead_pages,
         count(*) FILTER (hit = 1 AND many) AS lead_list_pages, max(cls) AS cls
  FROM (SELECT *, max(hit) OVER (PARTITION BY page_id, section) > 1 AS many FROM hits) GROUP BY section, gpath)"""

EMPTY_PAGES = "SELECT page_id FROM src WHERE html IS NULL"


def _extraction(full: bool) -> str:
    text = stripped("full_text") if full else "text_head"

    def scalar(name: str, where: str, xpath: str) -> str:
        return f"""SELECT s.page_id, '{name}' AS section, false AS is_list, max({text}) AS value,
          CAST(NULL AS VARCHAR) AS "values", CAST(NULL AS INT) AS n_values,
          CASE WHEN count(n.nid) > 0 THEN '{xpath.replace("'", "''")}' END AS source_xpath
          FROM src s LEFT JOIN nodes n ON n.page_id = s.page_id AND {where} WHERE s.html IS NOT NULL GROUP BY s.page_id"""

    def listed(name: str, where: str, xpath: str) -> str:
        return f"""SELECT s.page_id, '{name}' AS section, true AS is_list, CAST(NULL AS VARCHAR) AS value,
          coalesce(string_agg(coalesce({text}, ''), chr(31) ORDER BY n.nid) FILTER (n.nid IS NOT NULL), '') AS "values",
          CAST(count(n.nid) AS INT) AS n_values,
          CASE WHEN count(n.nid) > 0 THEN '{xpath.replace("'", "''")}' END AS source_xpath
          FROM src s LEFT JOIN nodes n ON n.page_id = s.page_id AND {where} WHERE s.html IS NOT NULL GROUP BY s.page_id"""

    return " UNION ALL ".join([
        scalar("title", "n.tag = 'h1'", "//h1"),
        scalar("doc_title", "n.tag = 'title'", "/html/head/title"),
        listed("links", "n.tag = 'a'", "//nav/ul/li/a"),
        listed("paragraphs", "n.tag = 'p' AND n.box = 'article'", "//article/p"),
        scalar("ad", "n.tag = 'div' AND n.cls = 'ad'", "//div[@class='ad']"),
        scalar("footer", "n.tag = 'footer'", "//footer"),
        scalar("subtitle", "false", "//h2"),
        listed("tags", "false", "//ul[@id='tags']/li"),
    ])


LONG = f"{NV}, long AS ({_extraction(False)})"
LONG_COLUMNS = 'page_id, section, is_list, value, "values", n_values, source_xpath'

PROFILE = """, profile AS (
  SELECT section, count(*) AS records, count(*) FILTER (chars > 0) AS filled,
         count(*) FILTER (chars > 0) / count(*) AS fill_rate,
         CASE WHEN sum(items) > 0 THEN sum(chars) / sum(items) ELSE 0.0 END AS avg_length,
         CAST(max(longest) AS INT) AS max_length, sum(items) / count(*) AS avg_items,
         CASE WHEN bool_or(source_xpath LIKE '%/footer%' OR source_xpath LIKE '%/nav/%') THEN 'structural'
              WHEN section = 'title' OR (NOT bool_or(is_list)
                   AND (CASE WHEN sum(items) > 0 THEN sum(chars) / sum(items) ELSE 0.0 END) < 200) THEN 'metadata'
              ELSE 'main' END AS role,
         CASE WHEN bool_or(is_list) THEN 'list'
              WHEN bool_or(regexp_matches(value, '</?[A-Za-z][^>]*>')) THEN 'html' ELSE 'text' END AS field_type,
         coalesce(bool_or(regexp_matches(coalesce(value, "values"), '</?[A-Za-z][^>]*>')), false) AS tagged
  FROM (
    SELECT *, CASE WHEN is_list THEN len(list_filter(string_split("values", chr(31)), lambda x: x != ''))
                   WHEN coalesce(value, '') != '' THEN 1 ELSE 0 END AS items,
           CASE WHEN is_list THEN length(replace("values", chr(31), '')) ELSE length(coalesce(value, '')) END AS chars,
           CASE WHEN is_list THEN coalesce(list_max(list_transform(string_split("values", chr(31)), lambda x: length(x))), 0)
                ELSE length(coalesce(value, '')) END AS longest
    FROM long) GROUP BY section)"""

# Two spellings of one document: the fields in the order their roles give.
MARKDOWN = r""", wide AS (
  SELECT page_id,
    max(escaped) FILTER (section = 'title') AS title, max(escaped) FILTER (section = 'doc_title') AS doc_title,
    max(escaped) FILTER (section = 'ad') AS ad, max(escaped) FILTER (section = 'footer') AS footer,
    max(escaped) FILTER (section = 'links') AS links, max(escaped) FILTER (section = 'paragraphs') AS paragraphs
  FROM (SELECT *, regexp_replace(CASE WHEN is_list THEN "values" ELSE value END, '([\\`*_{}\[\]()#+.!-])', '\\\1', 'g') AS escaped FROM long)
  GROUP BY page_id),
bullets AS (
  SELECT *, array_to_string(list_transform(list_filter(string_split(links, chr(31)), lambda x: x != ''), lambda x: '- ' || x), chr(10)) AS link_list,
    array_to_string(list_transform(list_filter(string_split(paragraphs, chr(31)), lambda x: x != ''), lambda x: '- ' || x), chr(10)) AS p_list
  FROM wide),
documents_md AS (
  SELECT page_id, CASE WHEN page_id IN (SELECT page_id FROM wide) THEN concat_ws(chr(10) || chr(10),
    '# ' || title, '**doc_title**: ' || doc_title, '**ad**: ' || ad,
    CASE WHEN p_list != '' THEN '## paragraphs' || chr(10) || chr(10) || p_list END,
    CASE WHEN link_list != '' THEN '## links' || chr(10) || chr(10) || link_list END,
    '## footer' || chr(10) || chr(10) || footer) END AS markdown
  FROM src LEFT JOIN bullets USING (page_id))"""


def _interface_rows() -> str:
    """What the fixed snippets are known to violate."""
    rows = {
        1: [("issue", "ForbiddenFunction", "high"), ("issue", "MissingHTMLExtractorClass", "high"),
            ("warning", "MissingSchemaConstant", "low")],
        2: [("issue", "MissingSchemaParameter", "high"), ("issue", "InvalidExtractParameters", "high"),
            ("issue", "InvalidReturnType", "high"), ("issue", "InvalidReturnType", "high"),
            ("issue", "ForbiddenMethodName", "high"), ("warning", "MissingSchemaConstant", "low")],
        4: [("issue", "MissingHTMLExtractorClass", "high"), ("warning", "MissingSchemaConstant", "low")],
        5: [("warning", "MissingTypeHint", "medium"), ("issue", "MissingReturnType", "high")],
    }
    values = ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, v in rows.items() for a, b, c in v)
    return f"(VALUES {values}) AS known(snippet, kind, type, severity)"


def _lint(code_table: str) -> str:
    """Text rules as one SELECT over ``code_table(subject_id, code)``."""
    calls = " + ".join(
        f"len(regexp_extract_all(code, '{p}'))"
        for p in (r"\.xpath\s*\(", r"etree\.XPath\s*\(", r"findall\s*\(", r"find\s*\(")
    )
    none = (r"len(regexp_extract_all(code, '\bif\s+.*\s+is\s+not\s+None\b|\bif\s+.*\s+is\s+None\b"
            r"|\bif\s+.*\s+!=\s+None\b|\bif\s+.*\s+==\s+None\b'))")
    empty = r"len(regexp_extract_all(code, 'len\s*\(\s*\w+\s*\)\s*(==|>)\s*0|\w+\s+if\s+\w+\s+else'))"
    not_imported = " OR ".join(
        f"(({' OR '.join(f'contains(code, $${w}$$)' for w in words)}) AND NOT contains(code, 'import {m}') AND NOT contains(code, 'from {m}'))"
        for m, words in {"lxml": ("lxml", "etree"), "json": ("json",), "logging": ("logging", "logger")}.items()
    )
    escape = "$$" + r"""[^r]"[^"]*\\[^\\"nrtbf]|[^r]'[^']*\\[^\\'nrtbf]""" + "$$"
    exempt = "$$" + r"""^\s*(#|\"\"\"|''')""" + "$$"
    fixed_path = "$$" + r"""[CD]:\\[^"]*|/.*/[^"]*\.html""" + "$$"

    def rule(group: str, kind: str, type_: str, severity: str | None, where: str) -> str:
        level = f"'{severity}'" if severity else "CAST(NULL AS VARCHAR)"
        return (f"SELECT subject_id, '{group}' AS check_group, '{kind}' AS kind, '{type_}' AS type, "
                f"{level} AS severity, CAST(NULL AS INT) AS line FROM {code_table} WHERE {where}")

    extracts = "contains(code, 'def extract')"
    return " UNION ALL ".join([
        f"""SELECT subject_id, 'syntax' AS check_group, 'warning' AS kind, 'InvalidEscapeSequence' AS type,
            CAST(NULL AS VARCHAR) AS severity, CAST(no AS INT) AS line
            FROM (SELECT subject_id, unnest(string_split(code, chr(10))) AS text,
                         generate_subscripts(string_split(code, chr(10)), 1) AS no FROM {code_table})
            WHERE NOT regexp_matches(text, {exempt}) AND regexp_matches(text, {escape})""",
        rule("syntax", "warning", "JSONBooleanInPython", None, r"regexp_matches(code, ':\s*(true|false)\s*[,}]')"),
        rule("robustness", "issue", "MissingErrorHandling", "high",
             f"{extracts} AND NOT (contains(code, 'try') AND contains(code, 'except'))"),
        rule("robustness", "issue", "MissingNoneCheck", "medium", f"{calls} > 0 AND {calls} > {none}"),
        rule("robustness", "warning", "MissingEmptyCheck", "medium",
             f"{calls} > 0 AND (contains(code, 'xpath') OR contains(code, 'findall')) AND {empty} < 2"),
        rule("robustness", "issue", "MissingFileErrorHandling", "high",
             "(contains(code, 'open(') OR contains(code, 'read_file') OR contains(code, 'Path(')) "
             "AND NOT regexp_matches(code, 'FileNotFoundError|IOError|OSError|except.*:')"),
        rule("robustness", "issue", "MissingImports", "high", not_imported),
        rule("robustness", "issue", "HardcodedPath", "medium", f"regexp_matches(code, {fixed_path})"),
        rule("robustness", "warning", "LimitedReturnPaths", "low",
             rf"{extracts} AND len(regexp_extract_all(code, 'return\s+')) < 2"),
        rule("robustness", "warning", "MissingInputValidation", "medium",
             rf"{extracts} AND NOT regexp_matches(code, 'if\s+.*\s+is\s+None|if\s+not\s+.*|assert\s+')"),
    ])


CODES = f"codes AS (SELECT page_id AS subject_id, {CODE} AS code FROM pages)"
ISSUES = f"""{CODES}, issues AS (
  SELECT * FROM ({_lint('codes')})
  UNION ALL SELECT subject_id, 'interface', kind, type, severity, NULL FROM codes
    JOIN {_interface_rows()} ON subject_id % {len(SNIPPETS)} = snippet
  UNION ALL SELECT subject_id, 'syntax', 'issue', 'SyntaxError', NULL, 1 FROM codes WHERE subject_id % {len(SNIPPETS)} = 3)"""


def _fix_bools(code: str) -> str:
    return (rf"regexp_replace(regexp_replace({code}, ':\s*false\s*([,}}])', ': False\1', 'g'), "
            rf"':\s*true\s*([,}}])', ': True\1', 'g')")


REVIEWS = inputs.REVIEWS
REVIEW_ROWS = f"reviews AS (SELECT page_id AS subject_id, {CODE} AS code, {REVIEWS} AS review FROM pages)"

_URL_PARTS = r"""
parts AS (SELECT *, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS host,
    list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x != '') AS segs FROM forms),
raw AS (SELECT *, CASE WHEN len(segs) = 0 THEN replace(host, '.', '_') || '_' || CASE WHEN position < 1000 THEN lpad(CAST(position AS VARCHAR), 3, '0') ELSE CAST(position AS VARCHAR) END
    WHEN len(segs) >= 2 AND length(segs[-1]) < 5 THEN segs[-2] || '_' || segs[-1] ELSE segs[-1] END AS r FROM parts),
cleaned AS (SELECT *, regexp_replace(r, '[^\w.-]', '_', 'g') AS c FROM raw),
named AS (SELECT page_id, position, u AS url,
    CASE WHEN length(c) < 3 THEN 'page_' || CASE WHEN position < 1000 THEN lpad(CAST(position AS VARCHAR), 3, '0') ELSE CAST(position AS VARCHAR) END ELSE c END AS f FROM cleaned),
files AS (SELECT page_id, position, url, CASE WHEN f LIKE '%.html' THEN f ELSE f || '.html' END AS filename FROM named)"""


def _files(forms: str) -> str:
    return f"WITH forms AS (SELECT page_id, page_id + 1 AS position, {forms} AS u FROM pages), {_URL_PARTS}"


# Copies get the numbers whose names nobody owns, smallest first.
_DEDUP = r"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY position) - 1 AS copy FROM files),
bases AS (SELECT filename, max(copy) AS copies,
   (SELECT count(DISTINCT o.filename) FROM files o
    WHERE starts_with(o.filename, regexp_replace(ranked.filename, '\.html$', '') || '_')) AS owned
   FROM ranked WHERE copy > 0 GROUP BY filename),
numbers AS (SELECT filename, unnest(generate_series(1, copies + owned)) AS k FROM bases),
free AS (SELECT filename, k, row_number() OVER (PARTITION BY filename ORDER BY k) AS copy FROM (
   SELECT filename, k, regexp_replace(filename, '\.html$', '') || '_' || k || '.html' AS target FROM numbers)
   WHERE target NOT IN (SELECT filename FROM files)),
unique_files AS (SELECT r.page_id, r.url, r.filename AS "natural",
   CASE WHEN r.copy = 0 THEN r.filename ELSE regexp_replace(r.filename, '\.html$', '') || '_' || free.k || '.html' END AS filename
   FROM ranked r LEFT JOIN free ON free.filename = r.filename AND free.copy = r.copy)"""

PAGE_RESULT = "'page_' || page_id || '.json'"


def _salvage(mode: str) -> tuple[str, str]:
    """(strategy, json) expressions for one mode over ``text``."""
    fenced, any_fence = r"(?s)```json\s*(\{.*?\})\s*```", r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
    outer = r"(?s)\{.*\}"
    steps = {"analyzer": [("fenced", fenced, 1)], "schema": [("fenced", fenced, 1), ("outermost", outer, 0)],
             "synthesis": [], "content": [("fenced", any_fence, 1)], "visual": [("outermost", outer, 0)]}[mode]
    strategy = json = "CASE "
    if mode != "visual":
        strategy += "WHEN json_valid(text) THEN 'whole' "
        json += "WHEN json_valid(text) THEN text "
    for name, pattern, group in steps:
        found = f"regexp_extract(text, '{pattern}', {group})"
        bad = "raw" if mode == "visual" else "error"
        strategy += f"WHEN {found} != '' THEN CASE WHEN json_valid({found}) THEN '{name}' ELSE '{bad}' END "
        json += f"WHEN {found} != '' THEN CASE WHEN json_valid({found}) THEN {found} END "
    return strategy + "ELSE 'raw' END", (json + "ELSE NULL END" if json != "CASE " else "CAST(NULL AS VARCHAR)")


_MODES = ("analyzer", "schema", "synthesis", "content", "visual")
_LINES = f"lines AS (SELECT page_id AS line_no, trim({inputs.URL_LINES}) AS url FROM pages)"
_VALID = r"regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"
_HREFS = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""


def _markdown_chain() -> str:
    text = "html"
    for pattern, to in (
        (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""), (r"(?s)<!--.*?-->", ""), (r"[ \t\r\n]+", " "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    text = rf"""regexp_replace({text}, '<br>', chr(10), 'g')"""
    text = rf"""regexp_replace({text}, '<a href="([^"]*)">\s*([^<]*?)\s*</a>', '[\2](\1)', 'g')"""
    text = rf"""regexp_replace({text}, '<h1>\s*(.*?)\s*</h1>', chr(10) || chr(10) || '# \1' || chr(10) || chr(10), 'g')"""
    text = rf"""regexp_replace({text}, '</?(p|div|article|footer|nav)\b[^>]*>', chr(10) || chr(10), 'g')"""
    text = rf"""regexp_replace({text}, ' *\n *', chr(10), 'g')"""
    text = rf"""regexp_replace({text}, '</?ul>', chr(10) || chr(10), 'g')"""
    text = rf"""regexp_replace({text}, '<li>', chr(10) || '- ', 'g')"""
    text = rf"""regexp_replace({text}, '<[!?/A-Za-z][^>]*>', '', 'g')"""
    text = rf"""regexp_replace({text}, ' +\n', chr(10), 'g')"""
    text = rf"""regexp_replace({decoded(text)}, '\n{{3,}}', chr(10) || chr(10), 'g')"""
    return stripped(text)


_LAYOUT = """layout AS (
  SELECT *, CASE WHEN tag IN ('article', 'main') THEN 'body' WHEN tag = 'footer' THEN 'footer'
                 WHEN tag = 'nav' OR tag = 'div' THEN 'other' END AS role,
         CASE WHEN (nid - 1) * 3 < n_all THEN 'top' WHEN (nid - 1) * 3 < n_all * 2 THEN 'middle' ELSE 'bottom' END AS position
  FROM nodes WHERE tag IN ('article', 'main', 'footer', 'nav', 'div'))"""

_SECTIONS_RANKED = f"""{NV}, {SECTION_ROWS},
best AS (SELECT section, arg_min(gpath, (-pages, length(gpath), gpath)) AS gpath,
  arg_min(cls, (-pages, length(gpath), gpath)) AS cls, any_value(type) AS type, any_value(description) AS description,
  string_agg('/' || gpath, '|' ORDER BY pages DESC, length(gpath), gpath) AS xpath_list,
  sum(lead_pages) AS pages, sum(lead_list_pages) AS lists, count(*) AS paths FROM variants GROUP BY section)"""


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["load_pages"] = "SELECT page_id, coalesce(url, 'unknown') AS identifier, CAST(length(html) AS BIGINT) AS n_chars FROM pages"
    o["load_html_dir"] = """SELECT CASE WHEN page_id % 7 <> 0 THEN md5(replace(html, chr(13) || chr(10), chr(10)) || chr(10)) END AS html_md5,
        CASE WHEN page_id % 7 = 0 THEN 'not valid UTF-8' END AS error, count(*) AS n_files FROM pages WHERE html <> '' GROUP BY ALL"""
    o["load_urls"] = f"WITH {_LINES} SELECT line_no, url FROM lines WHERE url != '' AND url NOT LIKE '#%' AND {_VALID}"
    o["rejected_urls"] = f"WITH {_LINES} SELECT line_no, url, 'invalid URL' AS reason FROM lines WHERE url != '' AND url NOT LIKE '#%' AND NOT {_VALID}"
    o["url_valid"] = f"WITH t AS (SELECT page_id, {inputs.URL_FORMS} AS url FROM pages) SELECT page_id, url AS candidate, {_VALID} AS valid FROM t"
    o["url_filename"] = f"{_files(inputs.NAMED_URLS)} SELECT page_id, url, filename FROM files"
    o["filename_dedup"] = f'{_files(inputs.CROWDED_URLS)} {_DEDUP} SELECT page_id, "natural", filename FROM unique_files'
    o["attach_url"] = f"""{_files('url')} {_DEDUP} SELECT page_id,
        CASE WHEN url LIKE '%spam-farm%' THEN 'lost_' || filename ELSE filename END AS name,
        CASE WHEN url LIKE '%spam-farm%' THEN NULL ELSE url END AS url, url NOT LIKE '%spam-farm%' AS matched FROM unique_files"""
    backlog = f"""WITH lines AS (SELECT url FROM pages UNION ALL SELECT {inputs.BARE} FROM pages),
        b AS (SELECT url, count(*) AS n_lines, url IN (SELECT url FROM pages) AS fetched FROM lines GROUP BY url)"""
    o["fetch_backlog"] = f"{backlog} SELECT * FROM b"
    o["fetch_coverage"] = f"{backlog} SELECT fetched, count(*) AS urls, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM b GROUP BY fetched"
    o["result_filename"] = rf"""WITH t AS (SELECT page_id, {inputs.FILE_NAMES} AS name FROM pages),
        r AS (SELECT *, regexp_replace(regexp_replace(name, '\.html?$', '') || '.json', '[^\w.-]', '_', 'g') AS result_file FROM t)
        SELECT *, regexp_replace(result_file, '\.json$', '.md') AS markdown_file FROM r"""
    o["write_extractions"] = f"""{LONG} SELECT s.page_id, 'page_' || s.page_id || '.json' AS result_file,
        max(value) FILTER (section = 'title') AS title, max(value) FILTER (section = 'footer') AS footer,
        max(string_split("values", chr(31))[2]) FILTER (section = 'links') AS second_link
        FROM src s LEFT JOIN long USING (page_id) GROUP BY s.page_id"""
    o["write_markdown"] = f"{LONG} {MARKDOWN} SELECT page_id, 'page_' || page_id || '.md' AS markdown_file, markdown FROM documents_md WHERE markdown IS NOT NULL"
    o["markdown_files"] = f"{LONG} {MARKDOWN} SELECT 'page_' || page_id || '.md' AS markdown_file, markdown FROM documents_md WHERE markdown IS NOT NULL"
    o["changed_files"] = """SELECT md5(replace(html, chr(13) || chr(10), chr(10)) || chr(10)) AS html_md5, CAST(strlen(html) + 1 AS BIGINT) AS bytes,
        count(*) AS n_files FROM pages WHERE html <> '' AND strlen(html) % 2 = 0 GROUP BY ALL"""
    o["step_tables"] = f"{N}, {SECTION_ROWS} SELECT section, count(*) AS n_rows FROM sections GROUP BY section"

    o["page_nodes"] = f"""{N} SELECT page_id, nid, coalesce((SELECT max(a.nid) FROM nodes a WHERE a.page_id = n.page_id
        AND a.nid < n.nid AND a.last_nid >= n.nid), 0) AS parent_nid, CAST(len(string_split(gpath, '/')) AS INT) AS depth, tag, gpath, text_head FROM nodes n"""
    o["tag_counts"] = "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag"
    o["node_text_full"] = f"{N} SELECT page_id, nid, tag, full_text AS text FROM nodes"
    o["node_outer_html"] = r"""SELECT page_id, 'nav' AS tag, regexp_extract(html, '<nav>.*</nav>') AS outer_html FROM pages
        UNION ALL SELECT page_id, 'h1', regexp_extract(html, '<h1>.*</h1>') FROM pages"""
    pieces = r"string_split_regex(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '<x>', 'g'), '<[^>]*>')"
    clean = stripped(decoded("x"))
    o["text_content"] = f"""SELECT page_id, array_to_string(list_filter(list_transform({pieces}, lambda x: {clean}), lambda x: x != ''), ' ') AS text FROM pages"""
    o["body_content"] = """SELECT page_id, CASE WHEN html LIKE '%</body>%' THEN regexp_extract(html, '(?is)<body.*</body>')
        ELSE regexp_extract(html, '(?is)<body.*') END AS body FROM pages"""
    o["node_xpath"] = f"{N} SELECT page_id, nid, xpath FROM nodes"

    def named(name: str, where: str, value: str = "text_head") -> str:
        return f"SELECT page_id, '{name}' AS name, nid, xpath, {value} AS value FROM nodes WHERE {where}"

    o["select_xpath"] = f"{N} " + " UNION ALL ".join([
        named("headings", "tag = 'h1'"), named("links", "tag = 'a'"), named("hrefs", "tag = 'a'", "href"),
        named("second_item", "tag = 'a' AND li_no = 2"), named("last_item", "tag = 'a' AND li_no = n_li"),
        named("ad", "cls = 'ad'"), named("ad_token", "cls = 'ad'"), named("bold", "tag = 'b'"),
        named("title_text", "tag = 'title'"), named("ends", "tag IN ('h1', 'footer')"),
        named("with_items", "tag = 'ul' AND n_li > 0"), named("bare_items", "tag = 'li' AND cls IS NULL"),
        named("after_heading", "tag = 'p'"), named("next_to_heading", "tag = 'p' AND p_no = 1 AND box = 'article'"),
        named("own_text", "tag = 'a' AND (text_head = 'The' OR href = '/and')"),
        named("first_ad", "cls = 'ad'"), named("early_items", "tag = 'a' AND li_no < 3"), named("first_of_page", "tag = 'a' AND li_no = 1"),
        named("first_in_body", "tag = 'nav'"), named("below_nested", "tag = 'a'"),
    ])
    o["unsupported_xpaths"] = """SELECT page_id, unnest(['menu', 'words']) AS section,
        unnest([$$//a/ancestor::nav: unsupported: syntax at '/ancestor::nav'$$, $$count(//p): unsupported: syntax at '/count(//p)'$$]) AS reason
        FROM pages WHERE html IS NOT NULL"""
    o["xpath_text"] = f"{N} SELECT page_id, nid, {stripped('full_text')} AS text FROM nodes WHERE tag IN ('h1', 'li', 'footer')"
    o["common_xpath"] = f"""{N}, steps AS (SELECT tag, unnest(string_split(xpath, '/')) AS step, generate_subscripts(string_split(xpath, '/'), 1) AS pos FROM nodes),
        n AS (SELECT tag, count(*) AS n FROM nodes GROUP BY tag),
        same AS (SELECT tag, pos, min(step) AS step, count(*) = any_value(n.n) AND count(DISTINCT step) = 1 AS ok FROM steps JOIN n USING (tag) GROUP BY tag, pos)
        SELECT n.tag, n.n, coalesce(string_agg(step, '/' ORDER BY pos) FILTER (ok AND pos < (SELECT coalesce(min(b.pos), 999) FROM same b WHERE b.tag = same.tag AND NOT b.ok)), '') AS common
        FROM n JOIN same USING (tag) GROUP BY n.tag, n.n"""
    o["suggest_xpath"] = f"""{N}, found AS (SELECT page_id, xpath, row_number() OVER (PARTITION BY page_id ORDER BY nid) AS rank FROM nodes
        WHERE contains(substr(lower({stripped('full_text')}), 1, 100), 'the')) SELECT page_id, CAST(rank AS INT) AS rank, xpath FROM found WHERE rank <= 5"""
    o["truncate_html"] = "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '... [truncated]' ELSE text END AS text_cut FROM documents"

    o["page_sections"] = f"""{NV}, {SECTION_ROWS} SELECT page_id, CAST(NULL AS VARCHAR) AS error, section, type, xpath, is_list,
        CASE WHEN is_list THEN '/' || gpath END AS list_xpath, substr({stripped('full_text')}, 1, 100) AS content_sample,
        CAST(n_matches AS INT) AS n_matches, cls FROM sections
        UNION ALL SELECT page_id, 'No HTML content available', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({EMPTY_PAGES})"""
    o["class_id_patterns"] = """SELECT 'class' AS kind, token, count(*) AS occurrences, count(DISTINCT page_id) AS pages,
        count(DISTINCT page_id) / (SELECT count(*) FROM pages) AS support
        FROM (SELECT page_id, unnest(string_split(cls, ' ')) AS token FROM (
          SELECT page_id, unnest(regexp_extract_all(html, ' class="([^"]*)"', 1)) AS cls FROM pages)) GROUP BY token"""
    o["structural_patterns"] = f"""{N} SELECT gpath, count(*) AS occurrences, count(DISTINCT page_id) AS pages,
        count(*) / count(DISTINCT page_id) AS avg_per_page, count(DISTINCT page_id) / (SELECT count(*) FROM pages) AS support FROM nodes GROUP BY gpath"""
    o["repeating_patterns"] = """WITH t AS (SELECT page_id, 'html/body/nav/ul/li' AS gpath, len(regexp_extract_all(html, '<li>')) AS n FROM pages
        UNION ALL SELECT page_id, 'html/body/article/p', len(regexp_extract_all(html, '<p>')) FROM pages)
        SELECT gpath, '' AS cls, count(*) AS groups, CAST(sum(n) AS BIGINT) AS items, count(DISTINCT page_id) AS pages FROM t WHERE n >= 3 GROUP BY gpath"""
    o["layout_roles"] = f"{NV}, {_LAYOUT} SELECT page_id, nid, tag AS name, role AS type, position, xpath, coalesce('.' || cls, '') AS hints FROM layout"
    o["layout_summary"] = f"{NV}, {_LAYOUT} SELECT role AS type, position, count(*) AS regions FROM layout GROUP BY ALL"
    o["merge_analyses"] = f"""{NV}, {SECTION_ROWS}, {_LAYOUT} SELECT coalesce(s.page_id, l.page_id) AS page_id, coalesce(s.xpath, l.xpath) AS xpath,
        s.section, s.type AS section_type, l.role AS region_type, l.position, s.page_id IS NOT NULL AS in_text, l.page_id IS NOT NULL AS in_layout
        FROM sections s FULL JOIN layout l ON s.page_id = l.page_id AND s.xpath = l.xpath"""
    o["merge_without_layout"] = f"""{NV}, {SECTION_ROWS} SELECT page_id, xpath, section, type AS section_type, CAST(NULL AS VARCHAR) AS region_type,
        CAST(NULL AS VARCHAR) AS position, true AS in_text, false AS in_layout FROM sections"""
    o["common_patterns"] = f"""{NV}, {SECTION_ROWS} SELECT section, CAST(sum(lead_pages) AS BIGINT) AS pages, CAST(sum(matches) AS BIGINT) AS matches,
        sum(lead_pages) / (SELECT total FROM total) AS coverage FROM variants GROUP BY section HAVING sum(lead_pages) / (SELECT total FROM total) >= 0.9"""
    o["xpath_coverage"] = f"""{NV}, {SECTION_ROWS} SELECT section, '/' || gpath AS xpath, pages, matches, pages / (SELECT total FROM total) AS coverage,
        matches / pages AS matches_per_page, rank() OVER (PARTITION BY section ORDER BY pages DESC) AS rank FROM variants"""
    o["inconsistencies"] = f"""{NV}, {SECTION_ROWS}, per AS (SELECT section, (SELECT total FROM total) - sum(lead_pages) AS missing, sum(lead_pages) AS found,
          count(*) AS paths, sum(lead_list_pages) AS lists FROM variants GROUP BY section)
        SELECT section, 'missing_pages' AS kind, CAST(missing AS BIGINT) AS n FROM per WHERE missing > 0
        UNION ALL SELECT section, 'path_variants', paths FROM per WHERE paths > 1
        UNION ALL SELECT section, 'mixed_is_list', CAST(lists AS BIGINT) FROM per WHERE lists > 0 AND lists < found"""
    o["missing_pages"] = f"""{NV}, {SECTION_ROWS} SELECT page_id, section FROM src, (VALUES ('title'), ('footer'), ('body'), ('header')) AS w(section)
        WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.page_id = src.page_id AND s.section = w.section)"""
    o["infer_schema"] = f"""{_SECTIONS_RANKED} SELECT section AS name, type, description, '/' || gpath AS xpath, xpath_list, lists * 2 > pages AS is_list, cls,
        'on ' || CAST(pages AS BIGINT) || ' pages, ' || paths || ' paths' AS notes FROM best"""
    o["schema_document"] = f"""{_SECTIONS_RANKED}, numbered AS (SELECT *, row_number() OVER (ORDER BY section) AS r, count(*) OVER () AS n FROM best)
        SELECT '1.0' AS schema_version, max(n) AS total_sections, max(section) FILTER (r = 1) AS first_section,
        max('/' || gpath) FILTER (r = 2) AS second_xpath, max(nullif(string_split(xpath_list, '|')[2], '')) FILTER (r = 2) AS second_alternative FROM numbered"""
    o["simplify_schema"] = f"""WITH l AS (SELECT page_id, url, {_HREFS} AS links FROM pages)
        SELECT page_id, '1.0' AS schema_version, 'same' AS name, url AS description, links[1] AS xpath, true AS is_list, CAST(NULL AS VARCHAR) AS xpath_list FROM l
        UNION ALL SELECT page_id, '1.0', 'other', url, '//nav', false, array_to_string(links[1:3], '|') FROM l
        UNION ALL SELECT page_id, '1.0', '', url, '', false, NULL FROM l"""

    o["extract_sections"] = f"{LONG} SELECT {LONG_COLUMNS} FROM long"
    o["extract_text_mode"] = f"{NV} {_extraction(True)}"
    o["incremental_extract"] = f"{N} {_extraction(False)}"
    o["xpath_fallback"] = f"""{NV}, lists AS (SELECT s.page_id, any_value(n.box) AS box,
          string_agg(coalesce(text_head, ''), chr(31) ORDER BY nid) FILTER (tag = 'p') AS ps, count(*) FILTER (tag = 'p') AS n_p,
          count(*) FILTER (tag = 'p' AND text_head IS NOT NULL) AS filled,
          max(text_head) FILTER (tag = 'h1') AS h1, max(text_head) FILTER (tag = 'title') AS title,
          max(text_head) FILTER (tag = 'footer') AS footer, max(text_head) FILTER (tag = 'div') AS ad
        FROM src s JOIN nodes n USING (page_id) GROUP BY s.page_id)
        SELECT page_id, 'heading' AS section, false AS is_list, CASE WHEN box = 'article' THEN h1 ELSE title END AS value, CAST(NULL AS VARCHAR) AS "values",
          CAST(NULL AS INT) AS n_values, CASE WHEN box = 'article' THEN '//article/h1' ELSE '//title' END AS source_xpath FROM lists
        UNION ALL SELECT page_id, 'main_text', true, NULL, CASE WHEN box = 'article' AND filled = 0 THEN '' ELSE ps END,
          CAST(CASE WHEN box = 'article' AND filled = 0 THEN 0 ELSE n_p END AS INT),
          CASE WHEN box = 'article' AND filled = 0 THEN NULL WHEN box = 'article' THEN '//article/p' ELSE '//main/p' END FROM lists
        UNION ALL SELECT page_id, 'closing', false, coalesce(footer, ad), NULL, NULL,
          CASE WHEN footer IS NOT NULL THEN '//footer' ELSE '//div[@class=''ad'']' END FROM lists"""
    o["extraction_records"] = f"""{LONG} SELECT s.page_id, max(value) FILTER (section = 'title') AS title, max(value) FILTER (section = 'doc_title') AS doc_title,
        max(value) FILTER (section = 'ad') AS ad, max(value) FILTER (section = 'footer') AS footer, max(value) FILTER (section = 'subtitle') AS subtitle,
        max("values") FILTER (section = 'links') AS links, max("values") FILTER (section = 'paragraphs') AS paragraphs,
        max("values") FILTER (section = 'tags') AS tags, count(long.page_id) > 0 AS json_has_title
        FROM src s LEFT JOIN long USING (page_id) GROUP BY s.page_id"""
    status = f"""WITH src AS (SELECT page_id, url, {VARIED} AS html FROM pages{EMPTY_ROWS}), st AS (SELECT page_id, 'page_' || page_id || '.html' AS file,
        CASE WHEN html IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN html IS NULL THEN 'No HTML content available' END AS error,
        CASE WHEN html IS NOT NULL THEN {PAGE_RESULT} END AS result_file FROM src)"""
    summary = """SELECT count(*) AS total_files, count(*) FILTER (status = 'success') AS processed_files,
        count(*) FILTER (status = 'failed') AS failed_files FROM st"""
    o["extract_status"] = f"{status} SELECT * FROM st"
    o["extraction_summary"] = f"{status} {summary}"
    o["schema_transfer"] = f"""{NV}, roles AS (SELECT page_id, html, CASE WHEN url LIKE '%/en/%' THEN 'learning' ELSE 'spread' END AS role FROM src),
        sec AS (SELECT * FROM (VALUES ('title', 'html/body/article/h1'), ('body', 'html/body/article'), ('body_paragraphs', 'html/body/article/p'),
          ('navigation', 'html/body/nav'), ('nav_links', 'html/body/nav/ul/li/a'), ('footer', 'html/body/footer'), ('ad', 'html/body/div')) AS t(section, gpath))
        SELECT role, section, count(DISTINCT r.page_id) AS pages,
          count(DISTINCT r.page_id) FILTER ({stripped('n.full_text')} != '') AS filled,
          count(DISTINCT r.page_id) FILTER ({stripped('n.full_text')} != '') / count(DISTINCT r.page_id) AS fill_rate
        FROM roles r JOIN sec ON r.html IS NOT NULL LEFT JOIN nodes n ON n.page_id = r.page_id AND n.gpath = sec.gpath GROUP BY role, section"""

    o["validate_schema"] = f"""WITH l AS (SELECT page_id AS schema_id, unnest({_HREFS}) AS href,
          generate_subscripts({_HREFS}, 1) - 1 AS position, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label FROM pages),
        r AS (SELECT schema_id, CAST(position AS INT) AS position, CASE WHEN length(label) > 2 THEN label END AS name,
          CASE WHEN length(label) = 3 THEN '' WHEN length(label) = 4 THEN 'bad' ELSE 'ok' END AS xpath FROM l)
        SELECT schema_id, position, 'MissingName' AS type, 'high' AS severity FROM r WHERE coalesce(name, '') = ''
        UNION ALL SELECT schema_id, position, 'MissingXPath', 'medium' FROM r WHERE xpath = ''
        UNION ALL SELECT schema_id, position, 'InvalidXPath', 'high' FROM r WHERE xpath = 'bad'
        UNION ALL SELECT schema_id, NULL, 'WrongTotal', 'low' FROM r GROUP BY schema_id HAVING count(*) != 5"""
    o["validate_extractions"] = f"""{LONG}
        SELECT page_id, 'ad' AS section, 'MissingField' AS type FROM long WHERE section = 'ad' AND length(value) > 60
        UNION ALL SELECT page_id, 'links', 'NullList' FROM long WHERE section = 'links' AND n_values = 4
        UNION ALL SELECT page_id, 'footer', 'MissingField' FROM long WHERE section = 'footer' AND value IS NULL
        UNION ALL SELECT page_id, 'closing', 'UnexpectedField' FROM long WHERE section = 'footer' AND value IS NULL
        UNION ALL SELECT page_id, section, 'MissingField' FROM ({EMPTY_PAGES}) CROSS JOIN (SELECT DISTINCT section FROM long)"""
    o["code_lint"] = f"WITH {CODES} {_lint('codes')}"
    o["code_syntax"] = f"SELECT page_id AS subject_id, 'SyntaxError' AS type, 1 AS line FROM pages WHERE page_id % {len(SNIPPETS)} = 3"
    o["code_interface"] = f"SELECT page_id AS subject_id, kind, type, severity FROM pages JOIN {_interface_rows()} ON page_id % {len(SNIPPETS)} = snippet"
    o["fix_json_bools"] = f"WITH {CODES} SELECT subject_id, {_fix_bools('code')} AS code FROM codes"
    o["issue_rollup"] = f"""WITH {ISSUES}, r AS (SELECT c.subject_id,
          count(*) FILTER (kind = 'issue' AND check_group = 'syntax') AS syntax_issues,
          count(*) FILTER (kind = 'issue' AND check_group = 'robustness') AS robustness_issues,
          count(*) FILTER (kind = 'issue' AND check_group = 'interface') AS interface_issues,
          count(*) FILTER (kind = 'warning') AS warnings,
          count(*) FILTER (kind = 'warning' AND check_group = 'robustness') AS robustness_warnings
        FROM codes c LEFT JOIN issues i ON i.subject_id = c.subject_id GROUP BY c.subject_id)
        SELECT *, syntax_issues + robustness_issues + interface_issues = 0 AS valid,
          syntax_issues + robustness_issues + interface_issues + robustness_warnings > 0 AS needs_review FROM r"""
    o["top_issues"] = f"""WITH {ISSUES}, r AS (SELECT subject_id, check_group, type, row_number() OVER w AS rank, count(*) OVER (PARTITION BY subject_id, check_group) AS total
          FROM issues WHERE kind = 'issue' WINDOW w AS (PARTITION BY subject_id, check_group ORDER BY line NULLS LAST, type))
        SELECT subject_id, check_group, CAST(rank AS INT) AS rank, type, total FROM r WHERE rank <= 3"""
    o["revalidation_diff"] = f"""WITH {CODES}, fixed AS (SELECT subject_id, 'from lxml import etree' || chr(10) || {_fix_bools('code')} AS code FROM codes),
        b AS (SELECT subject_id, type, count(*) AS n FROM ({_lint('codes')}) GROUP BY ALL),
        a AS (SELECT subject_id, type, count(*) AS n FROM ({_lint('fixed')}) GROUP BY ALL)
        SELECT coalesce(b.subject_id, a.subject_id) AS subject_id, coalesce(b.type, a.type) AS type, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after,
          CASE WHEN a.n IS NULL THEN 'fixed' WHEN b.n IS NULL THEN 'new' ELSE 'remaining' END AS state
        FROM b FULL JOIN a ON a.subject_id = b.subject_id AND a.type = b.type"""

    columns = ", ".join(
        f"{s} AS {m}_strategy, {j} AS {m}_json" for m in _MODES for s, j in [_salvage(m)]
    )
    o["salvage_json"] = f"WITH r AS (SELECT event_id, {inputs.RESPONSES} AS text FROM events) SELECT event_id, {columns} FROM r"
    o["extract_fenced_code"] = f"""WITH {REVIEW_ROWS} SELECT subject_id, {stripped(
        "CASE WHEN contains(review, '```') THEN regexp_extract(review, '(?s)```(?:python3|python)?" + chr(92) + "s*(.*?)```', 1) ELSE review END")} AS code FROM reviews"""
    o["extract_reviewed_code"] = f"""WITH {REVIEW_ROWS} SELECT subject_id, CASE WHEN subject_id % 5 = 1 THEN {stripped(quoted(SNIPPETS[0]))} ELSE code END AS code,
        subject_id % 5 = 1 AS fixed FROM reviews"""
    o["review_suggestions"] = f"""WITH {REVIEW_ROWS}, l AS (SELECT subject_id, list_filter(list_transform(string_split(review, chr(10)), lambda x: {stripped('x')}),
          lambda x: starts_with(x, '-') OR starts_with(x, '*')) AS found FROM reviews)
        SELECT subject_id, CAST(generate_subscripts(found, 1) - 1 AS INT) AS pos, unnest(found) AS suggestion FROM l"""

    o["sample_records"] = f"{LONG} SELECT page_id, (SELECT max(value) FROM long l WHERE l.page_id = s.page_id AND section = 'title') AS title FROM src s ORDER BY page_id LIMIT 5"
    o["field_profile"] = f"{LONG} {PROFILE} SELECT * FROM profile"
    o["content_hierarchy"] = f"""{LONG} {PROFILE}, p AS (SELECT arg_max(section, (avg_length * avg_items * records, section)) FILTER (role = 'main') AS best FROM profile)
        SELECT string_agg(section, '|' ORDER BY section) FILTER (role = 'main') AS main_content_fields,
          string_agg(section, '|' ORDER BY section) FILTER (role = 'metadata') AS metadata_fields,
          string_agg(section, '|' ORDER BY section) FILTER (role = 'structural') AS structural_fields,
          string_agg(section, '|' ORDER BY section) FILTER (role = 'main' AND section != (SELECT best FROM p)) AS secondary, (SELECT best FROM p) AS "primary" FROM profile"""
    o["html_to_markdown"] = f"SELECT page_id, {_markdown_chain()} AS markdown FROM pages"
    o["markdown_escape"] = r"SELECT doc_id, regexp_replace(text, '([\\`*_{}\[\]()#+.!-])', '\\\1', 'g') AS escaped FROM documents"
    o["records_to_markdown"] = f"{LONG} {MARKDOWN} SELECT page_id, markdown FROM documents_md"
    md_status = status.replace("AS result_file FROM src)", "AS result_file FROM src), x AS (SELECT 1)")
    o["markdown_status"] = f"""{md_status} SELECT page_id, {PAGE_RESULT} AS json_file,
        CASE WHEN status = 'success' THEN 'page_' || page_id || '.md' END AS markdown_file, status, error FROM st"""
    o["markdown_summary"] = f"{status} {summary}"

    o["run_manifest"] = """SELECT 1 AS run_id, 'text_analysis' AS step, (SELECT count(*) FROM pages) AS rows
        UNION ALL SELECT 2, 'schema', NULL"""
    o["next_run_id"] = f"""SELECT coalesce(max(TRY_CAST(regexp_extract({inputs.RUN_DIRS}, '^flow([0-9]+)$', 1) AS BIGINT)), 0) + 1 AS next_run_id FROM events"""
    o["latest_state"] = """SELECT user_id, event_type AS field, arg_max(props, event_id) AS value, max(event_id) AS run_id
        FROM events WHERE event_id % 3 != 0 AND props IS NOT NULL GROUP BY ALL"""
    o["completed_steps"] = """SELECT user_id, CAST(CASE WHEN event_id % 9 = 6 THEN 6 ELSE event_id % 9 + 1 END AS INT) AS step_number, max(event_id) AS run_id
        FROM events WHERE event_id % 9 <= 6 GROUP BY ALL"""
    o["pending_pages"] = "SELECT page_id FROM pages WHERE url LIKE '%/es/%' OR url LIKE '%/fr/%' OR url LIKE '%/de/%'"
    o["pending_pages_html"] = "SELECT page_id, url, md5(html) AS html_md5 FROM pages WHERE url LIKE '%/es/%' OR url LIKE '%/fr/%' OR url LIKE '%/de/%'"
    o["regenerate_fallback"] = """WITH r AS (SELECT page_id AS subject_id, url, CASE WHEN url LIKE '%#top%' THEN '' WHEN url LIKE '%/de/%' THEN '# fallback template: ' || url ELSE url END AS result FROM pages),
        x AS (SELECT subject_id, result, CASE WHEN url LIKE '%spam-farm%' THEN 'failed' WHEN result = '' THEN 'missing' WHEN result LIKE '# fallback%' THEN 'fallback' END AS reason FROM r)
        SELECT * FROM x WHERE reason IS NOT NULL"""
    return o


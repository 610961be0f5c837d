"""Inputs the queries derive from the given tables, always over every row.

Some operators work on data the tables do not hold as such: URL lists with comments, model
responses, source code, run manifests. Each is a projection of a whole table, so its size
grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.sources.pages import read_pages, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
BARE = "regexp_replace(url, '[?#].*$', '')"

# German pages use <main>, French pages have an <address> for their <footer>. Spam hosts serve a second
# time, and then nothing: rows of their own, with negative numbers.
VARIED_HTML = """CASE
  WHEN url LIKE '%/de/%' THEN replace(replace(html, '<article>', '<main>'), '</article>', '</main>')
  WHEN url LIKE '%/fr/%' THEN replace(replace(html, '<footer>', '<address>'), '</footer>', '</address>')
  ELSE html END"""
EMPTY_ROWS = "SELECT -1 - page_id AS page_id, url, CAST(NULL AS {text}) AS html FROM {pages} WHERE url LIKE '%spam-farm%'"

URL_LINES = """CASE page_id % 6
  WHEN 1 THEN concat('  ', url, ' ')
  WHEN 2 THEN concat('# ', url)
  WHEN 3 THEN regexp_replace(url, '^[a-z]+://', '')
  WHEN 4 THEN '   '
  ELSE url END"""

URL_FORMS = f"""CASE page_id % 5
  WHEN 1 THEN regexp_replace(url, '^[a-z]+:', '')
  WHEN 2 THEN concat('https:///', {PATH})
  WHEN 3 THEN concat('ftp', regexp_replace(url, '^[a-z]+', ''))
  WHEN 4 THEN concat('mailto:info@', {HOST})
  ELSE url END"""

NAMED_URLS = f"""CASE page_id % 4
  WHEN 1 THEN concat('https://', {HOST})
  WHEN 2 THEN concat({BARE}, '/article-', page_id, '(text)/?v=1')
  WHEN 3 THEN concat('https://', {HOST}, '/', page_id, '#top')
  ELSE url END"""

# A third of the list shares one file name, and some names look like numbered copies of it.
CROWDED_URLS = f"""CASE
  WHEN page_id % 3 = 0 THEN concat('https://', {HOST}, '/archive/index.html')
  WHEN page_id % 10 = 1 THEN concat('https://', {HOST}, '/archive/index_', page_id, '.html')
  ELSE url END"""

FILE_NAMES = """CASE page_id % 4
  WHEN 0 THEN concat('page_', page_id, '.html')
  WHEN 1 THEN concat('page ', page_id, ' (old).htm')
  WHEN 2 THEN concat('page_', page_id, '.xhtml')
  ELSE concat('Page-', page_id) END"""


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = pages(spark, sf_dir)
    empty = spark.sql(EMPTY_ROWS.format(text="STRING", pages="{pages}"), pages=page_urls(spark, sf_dir))
    return whole.select("page_id", "url", F.expr(VARIED_HTML).alias("html")).unionByName(empty)


# Source snippets that fire different rules, chosen by page.
SNIPPETS: tuple[str, ...] = (
    # complete and clean
    "from lxml import etree\nimport json\nimport logging\n\nSCHEMA = {}\n\nclass HTMLExtractor:\n"
    "    def __init__(self, schema: dict):\n        self.schema = schema\n\n"
    "    def extract(self, html_content: str = None) -> dict:\n        if html_content is None:\n"
    "            return {}\n        try:\n            return {'a': 1}\n        except Exception:\n            return {}\n",
    # standalone function, JSON booleans, lookups without checks
    "def extract_content(html):\n    opts = {\"list\": true, \"deep\":  false}\n"
    "    return tree.xpath('//h1') + tree.findall('p')\n",
    # wrong names and types, files without error handling
    "class HTMLExtractor:\n    def __init__(self, config):\n        pass\n\n"
    "    def extract(self, data) -> List[str]:\n        return open(data).read()\n\n"
    "    def extract_from_file(self, path):\n        return json.loads(path)\n",
    # does not parse
    "def extract(html_content:\n    return {\"a\": true}\n",
    # fixed paths and doubtful escapes
    "import logging\nlogger = logging.getLogger('x')\nROOT = '/data/pages/a.html'\npattern = \"a\\d+\"\n"
    "def run():\n    logger.info(ROOT)\n",
    # untyped method, schema without hint
    "SCHEMA = {'x': 1}\nclass HTMLExtractor:\n    def __init__(self, schema):\n        assert schema\n\n"
    "    def extract(self, file_path):\n        try:\n            x = self.find('a')\n            if x is None:\n"
    "                return None\n            return x\n        except OSError:\n            return None\n",
)

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def quoted(text: str) -> str:
    """A SQL string built without escapes, so that Spark and ANSI SQL read it alike."""
    parts = []
    for i, line in enumerate(text.split("\n")):
        if i:
            parts.append("chr(10)")
        for j, piece in enumerate(line.split("\\")):
            if j:
                parts.append("chr(92)")
            if piece:
                parts.append("'" + "',chr(39),'".join(piece.split("'")) + "'")
    return f"concat({', '.join(p for p in parts)})"


def _snippet_case() -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SNIPPETS))
    return f"CASE page_id % {len(SNIPPETS)} {cases} END"


# The whole page, on one line.
PAGE = "replace(replace(html, chr(13), ' '), chr(10), ' ')"
CODE = f"concat({_snippet_case()}, '# ', {PAGE}, chr(10))"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.col("page_id").alias("subject_id"), F.expr(CODE).alias("code"))


FENCE = "'```'"
RESPONSES = f"""CASE event_id % 8
  WHEN 0 THEN props
  WHEN 1 THEN concat('Result:', chr(10), {FENCE}, 'json', chr(10), props, chr(10), {FENCE})
  WHEN 2 THEN concat({FENCE}, chr(10), props, chr(10), {FENCE}, ' done')
  WHEN 3 THEN concat('The answer is ', props, ' as asked')
  WHEN 4 THEN concat(props, ' and ', props)
  WHEN 5 THEN concat({FENCE}, 'json', chr(10), '{{', event_type, chr(10), '}}', chr(10), {FENCE})
  WHEN 6 THEN event_type
  ELSE concat('{{"n": ', props) END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), "event_id")
    return events.select("event_id", F.expr(RESPONSES).alias("text"))


REVIEWS = f"""CASE page_id % 5
  WHEN 0 THEN concat('Looks fine.', chr(10), '- add tests', chr(10), '  * rename ', {PAGE}, chr(10), 'end')
  WHEN 1 THEN concat('Use this:', chr(10), {FENCE}, 'python', chr(10), {quoted(SNIPPETS[0])}, {FENCE}, chr(10), '- fixed')
  WHEN 2 THEN concat({FENCE}, chr(10), 'x = 1', chr(10), {FENCE})
  WHEN 3 THEN concat({FENCE}, 'python', chr(10), {quoted(SNIPPETS[3] * 3)}, {FENCE}, chr(10), '* broken')
  ELSE concat('Fixed code:', chr(10), {quoted(SNIPPETS[5].strip())}, chr(10), chr(10), 'bye') END"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("subject_id"), F.expr(CODE).alias("code"), F.expr(REVIEWS).alias("review")
    )


RUN_DIRS = """CASE event_type
  WHEN 'error' THEN concat('flow', CASE WHEN user_id % 7 = 0 THEN 'X' ELSE '' END, user_id)
  WHEN 'view' THEN concat('flow', user_id)
  WHEN 'click' THEN concat('run', user_id)
  ELSE concat('flow', user_id, '_tmp') END"""


def run_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(RUN_DIRS).alias("run_dir"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a state record: its user's run ``event_id`` set a field to a value."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id AS run_id", "event_type AS field",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS value",
    )


STEP_OF = """CASE event_id % 9
  WHEN 0 THEN 'text_analysis' WHEN 1 THEN 'visual_analysis' WHEN 2 THEN 'synthesized' WHEN 3 THEN 'schema'
  WHEN 4 THEN 'code_generated' WHEN 5 THEN 'code_validated' WHEN 6 THEN 'code' WHEN 7 THEN 'markdown'
  ELSE 'other' END"""

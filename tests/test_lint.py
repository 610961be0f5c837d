import tracemalloc

import pyarrow as pa
import pytest

from domloom.operators import lint

# rule: (source that fires it, source that does not)
TEXT_RULES = {
    "InvalidEscapeSequence": ('x = "a\\d"', 'x = r"a\\d"'),
    "JSONBooleanInPython": ('{"a": true}', '{"a": True}'),
    "MissingErrorHandling": ("def extract(x): pass", "def extract(x):\n  try: pass\n  except E: pass"),
    "MissingNoneCheck": ("a.xpath('x')", "a.xpath('x')\nif a is None: pass"),
    "MissingEmptyCheck": ("t.xpath('x')", "t.xpath('x')\nlen(a) == 0 and len( b ) > 0"),
    "MissingFileErrorHandling": ("open('x')", "open('x')\nexcept OSError: pass"),
    "MissingImports": ("json.loads(x)", "import json\njson.loads(x)"),
    "HardcodedPath": ("p = '/a/b/c.html'", "p = 'c.html'"),
    "LimitedReturnPaths": ("def extract(): return 1", "def extract():\n return 1\n return 2"),
    "MissingInputValidation": ("def extract(x): pass", "def extract(x):\n if not x: pass"),
}


def codes(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "subject_id bigint, code string")


@pytest.fixture(scope="module")
def text_issues(spark):
    sources = [s for pair in TEXT_RULES.values() for s in pair]
    found: dict[int, set] = {}
    for r in lint.code_lint(codes(spark, *sources)).collect():
        found.setdefault(r.subject_id, set()).add(r.type)
    return found


@pytest.mark.parametrize("rule", TEXT_RULES)
def test_text_rule(text_issues, rule):
    i = list(TEXT_RULES).index(rule) * 2
    assert rule in text_issues.get(i, set()) and rule not in text_issues.get(i + 1, set())


def test_messages_and_lines(spark):
    rows = lint.code_lint(codes(spark, "a = 1\n# x = '\\d'\ny = (\"\\q\")\nlxml, logger")).collect()
    by_type = {r.type: r for r in rows}
    assert by_type["InvalidEscapeSequence"].line == 3
    assert by_type["MissingImports"].message == "Not imported: lxml, logging"
    assert by_type["MissingImports"].suggestion == "Add: import lxml, import logging"


CLASS = "class HTMLExtractor:\n    def __init__(self{init}){ret}:\n        pass\n    def extract(self, {params}){returns}:\n        pass\n"


def make(init=", schema: dict", ret="", params="html_content", returns=" -> dict", extra="", constant="SCHEMA = 1\n"):
    return constant + CLASS.format(init=init, ret=ret, params=params, returns=returns) + extra


INTERFACE_RULES = {
    "clean": (make(), []),
    "schema parameter": (make(init=""), ["MissingSchemaParameter"]),
    "type hint": (make(init=", schema"), ["MissingTypeHint"]),
    "hint not needed with a return type": (make(init=", schema", ret=" -> None"), []),
    "parameters": (make(params="data"), ["InvalidExtractParameters"]),
    "file_path is enough": (make(params="file_path"), []),
    "no return type": (make(returns=""), ["MissingReturnType"]),
    "typing Dict": (make(returns=" -> Dict[str, Any]"), []),
    "wrong return type": (make(returns=" -> str"), ["InvalidReturnType"]),
    "forbidden return type": (make(returns=" -> List[dict]"), ["InvalidReturnType"]),
    "both return rules": (make(returns=" -> Tuple[str]"), ["InvalidReturnType", "InvalidReturnType"]),
    "standalone function": (make(extra="def extract_content(): pass\n"), ["ForbiddenFunction"]),
    "nested function": (make(extra="def f():\n    def extract_content(): pass\n"), ["ForbiddenFunction"]),
    "method name": (make(extra="    def extract_from_file(self): pass\n"), ["ForbiddenMethodName"]),
    "no class": ("SCHEMA = 1", ["MissingHTMLExtractorClass"]),
    "no constant": (make(constant=""), ["MissingSchemaConstant"]),
    "syntax error": ("def (", []),
}


@pytest.fixture(scope="module")
def interface_issues(spark):
    facts = lint.code_facts(codes(spark, *[s for s, _ in INTERFACE_RULES.values()]))
    found: dict[int, list] = {}
    for r in lint.code_interface(facts).collect():
        found.setdefault(r.subject_id, []).append(r.type)
    return found


@pytest.mark.parametrize("rule", INTERFACE_RULES)
def test_interface_rule(interface_issues, rule):
    assert sorted(interface_issues.get(list(INTERFACE_RULES).index(rule), [])) == sorted(INTERFACE_RULES[rule][1])


def test_interface_with_other_names(spark):
    source = "class MarkdownConverter:\n    def __init__(self): pass\n    def convert(self, json_data) -> str: pass\n"
    names = dict(class_name="MarkdownConverter", method="convert", init_params=(), method_params=("json_data",), returns="str", constant=None)
    assert lint.code_interface(lint.code_facts(codes(spark, source)), **names).count() == 0
    bad = source.replace("json_data", "data").replace("-> str", "-> dict")
    got = lint.code_interface(lint.code_facts(codes(spark, bad)), **names).collect()
    assert sorted(r.type for r in got) == ["InvalidExtractParameters", "InvalidReturnType"]


def test_syntax(spark):
    rows = lint.code_syntax(lint.code_facts(codes(spark, "x = 1", "x = (\n", None, "def f(:\n  pass"))).collect()
    assert {r.subject_id for r in rows} == {1, 3} and all(r.type == "SyntaxError" and r.line == 1 for r in rows)


def test_facts_hold_a_few_sources_at_a_time():
    """A batch of sources far above the bound: neither its texts nor its facts are in memory at once."""
    sources = ["def f(a): return 1\n# " + "ü" * 100_000, "x = (\n", None] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(sources, pa.string())], names=["subject_id", "code"])
    names, rows, held = [], 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for part in lint._fact_batches(iter([batch])):
        assert part.column(1).equals(batch.column(1).slice(rows, part.num_rows)) and part.num_rows < 40
        assert pa.total_allocated_bytes() - held < 1_000_000
        names += [[f["name"] for f in x] for x in part.column(3).to_pylist()]
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == [["f"], [], []] * 100 and peak < 5_000_000


def test_rollup_top_and_diff(spark):
    table = codes(spark, make(), "open('x')\njson.loads(1)\n'/a/b/c.html'\nlogger.xpath(1)", "x = (", "y = 1\nSCHEMA = 2")
    issues = lint.all_issues(table)
    rows = {r.subject_id: r for r in lint.issue_rollup(table, issues).collect()}
    assert rows[0].robustness_issues == 1 and not rows[0].valid  # extraction without error handling
    assert rows[2].syntax_issues == 1 and rows[2].interface_issues == 0 and not rows[2].valid
    assert rows[3].interface_issues == 1
    top = [r for r in lint.top_issues(issues).collect() if r.subject_id == 1 and r.check_group == "robustness"]
    assert sorted(r["rank"] for r in top) == [1, 2, 3] and {r.total for r in top} == {4}
    assert [r.type for r in sorted(top, key=lambda r: r["rank"])] == ["HardcodedPath", "MissingFileErrorHandling", "MissingImports"]
    after = lint.code_lint(codes(spark, make(), "import json\njson.loads(1)\n{'a': true}\nlogger.xpath(1)"))
    diff = {(r.subject_id, r.type): r.state for r in lint.revalidation_diff(lint.code_lint(table), after).collect()}
    assert diff[1, "HardcodedPath"] == "fixed" and diff[1, "JSONBooleanInPython"] == "new" and diff[1, "MissingImports"] == "remaining"


def test_warnings_alone_stay_valid(spark):
    table = codes(spark, "")
    warning = spark.createDataFrame(
        [(0, "syntax", "warning", "JSONBooleanInPython", None, "m", None, None)],
        "subject_id bigint, check_group string, kind string, type string, severity string, message string, suggestion string, line int",
    )
    row = lint.issue_rollup(table, warning).first()
    assert row.valid and not row.needs_review and row.warnings == 1


def test_settle_review(spark):
    good = "def f():\n" + "    x = 1\n" * 20
    rows = [(1, "old", f"```python\n{good}```"), (2, "old", "```python\n" + "def f(:\n" * 30 + "```"), (3, "old", "no code")]
    table = spark.createDataFrame(rows, "subject_id bigint, code string, review string")
    got = {r.subject_id: (r.code, r.fixed) for r in lint.settle_review(table).collect()}
    assert got == {1: (good.strip(), True), 2: ("old", False), 3: ("old", False)}

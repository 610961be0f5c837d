"""Checks on a table of Python sources ``(subject_id, code)``.

Text rules and interface rules are Catalyst predicates. Python only parses the source
into facts (classes, functions, assigned names), in Arrow batches; it never runs it.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domloom.functions.columns import sql_let, sql_literal
from domloom.functions.responses import reviewed_code

# The patterns and words the text rules look for.
BAD_ESCAPES = (r"""[^r]"[^"]*\\[^\\"nrtbf]""", r"""[^r]'[^']*\\[^\\'nrtbf]""")
JSON_BOOL = r"(?U):\s*(true|false)\s*[,}]"
LOOKUP_CALLS = (r"(?U)\.xpath\s*\(", r"(?U)etree\.XPath\s*\(", r"(?U)findall\s*\(", r"(?U)find\s*\(")
NONE_CHECK = (
    r"(?Ud)\bif\s+.*\s+is\s+not\s+None\b|\bif\s+.*\s+is\s+None\b"
    r"|\bif\s+.*\s+!=\s+None\b|\bif\s+.*\s+==\s+None\b"
)
EMPTY_CHECK = r"(?U)len\s*\(\s*\w+\s*\)\s*==\s*0|len\s*\(\s*\w+\s*\)\s*>\s*0|\w+\s+if\s+\w+\s+else"
FILE_WORDS = ("open(", "read_file", "Path(")
FILE_ERRORS = r"(?d)FileNotFoundError|IOError|OSError|except.*:"
MODULE_WORDS = {"lxml": ("lxml", "etree"), "json": ("json",), "logging": ("logging", "logger")}
FIXED_PATHS = (r"""(?d)[CD]:\\[^"]*""", r"""(?d)/.*/[^"]*\.html""")
INPUT_CHECK = r"(?Ud)if\s+.*\s+is\s+None|if\s+not\s+.*|assert\s+"
FORBIDDEN_METHODS = ("extract_from_string", "extract_from_file")
FORBIDDEN_RETURNS = ("ExtractionResult", "dataclass", "List[", "Tuple[")


def _any(code: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({code}, {sql_literal(w)})" for w in words) + ")"


def _matches(code: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"rlike({code}, {sql_literal(p)})" for p in patterns) + ")"


def _count(code: str, pattern: str) -> str:
    return f"regexp_count({code}, {sql_literal(pattern)})"


def _issue(
    group: str, kind: str, type_: str, severity: str | None, message: str, suggestion: str | None, line: str = "NULL"
) -> str:
    """SQL for one issue; ``message`` and ``suggestion`` are plain text unless they start with ``=``."""

    def text(value: str | None) -> str:
        return value[1:] if value and value.startswith("=") else sql_literal(value)

    return (
        f"struct({sql_literal(group)} AS check_group, {sql_literal(kind)} AS kind, {sql_literal(type_)} AS type, "
        f"{sql_literal(severity)} AS severity, {text(message)} AS message, {text(suggestion)} AS suggestion, "
        f"CAST({line} AS INT) AS line)"
    )


def _fired(*rules: tuple[str, str]) -> str:
    found = ", ".join(f"CASE WHEN {condition} THEN {issue} END" for condition, issue in rules)
    return f"filter(array({found}), i -> i IS NOT NULL)"


def text_rules(code: str = "code") -> str:
    """SQL for the array of issues and warnings found in the text of a source column.

    Lookups, their checks and missing imports are found once per source, not once per use.
    """
    extracts = f"contains({code}, 'def extract')"
    counted = {
        "lookups": "(" + " + ".join(_count(code, p) for p in LOOKUP_CALLS) + ")",
        "none_checks": f"CASE WHEN lookups > 0 THEN {_count(code, NONE_CHECK)} ELSE 0 END",
    }
    lookups, none_checks, missing = "lookups", "none_checks", "missing"
    counted["missing"] = "filter(array({}), m -> m IS NOT NULL)".format(", ".join(
        f"CASE WHEN {_any(code, words)} AND NOT {_any(code, (f'import {m}', f'from {m}'))} THEN {sql_literal(m)} END"
        for m, words in MODULE_WORDS.items()
    ))
    exempt = r"""(?U)\A\s*(?:#|\"\"\"|''')"""
    lines = f"transform(split({code}, chr(10)), (x, i) -> struct(x AS text, i + 1 AS no))"
    bad_lines = f"filter({lines}, x -> NOT rlike(x.text, {sql_literal(exempt)}) AND {_matches('x.text', BAD_ESCAPES)})"
    escapes = "transform({}, x -> {})".format(bad_lines, _issue(
        "syntax", "warning", "InvalidEscapeSequence", None,
        "=concat('Escape sequence may be invalid in line ', x.no)", "Use a raw string or double the backslash", "x.no",
    ))
    rest = _fired(
        (f"rlike({code}, {sql_literal(JSON_BOOL)})",
         _issue("syntax", "warning", "JSONBooleanInPython", None, "JSON true/false in Python source", "Write True or False")),
        (f"{extracts} AND NOT (contains({code}, 'try') AND contains({code}, 'except'))",
         _issue("robustness", "issue", "MissingErrorHandling", "high",
                "Extraction functions handle no errors", "Catch parse, file and XPath errors")),
        (f"{lookups} > 0 AND {lookups} > {none_checks}",
         _issue("robustness", "issue", "MissingNoneCheck", "medium",
                f"=concat({lookups}, ' lookups but ', {none_checks}, ' None checks')", "Test results for None")),
        (f"{lookups} > 0 AND {_any(code, ('xpath', 'findall'))} AND {_count(code, EMPTY_CHECK)} < 2",
         _issue("robustness", "warning", "MissingEmptyCheck", "medium",
                "Lookups may give empty lists", "Test the length before use")),
        (f"{_any(code, FILE_WORDS)} AND NOT rlike({code}, {sql_literal(FILE_ERRORS)})",
         _issue("robustness", "issue", "MissingFileErrorHandling", "high",
                "File operations handle no errors", "Catch file errors")),
        (f"size({missing}) > 0",
         _issue("robustness", "issue", "MissingImports", "high",
                f"=concat('Not imported: ', array_join({missing}, ', '))",
                f"=concat('Add: ', array_join(transform({missing}, m -> concat('import ', m)), ', '))")),
        # The second pattern looks far ahead from every slash; without its last word it cannot match.
        (f"({_matches(code, FIXED_PATHS[:1])} OR contains({code}, '.html') AND {_matches(code, FIXED_PATHS[1:])})",
         _issue("robustness", "issue", "HardcodedPath", "medium", "Fixed file path in source", "Build paths with pathlib")),
        (f"{extracts} AND {_count(code, r'(?U)return\s+')} < 2",
         _issue("robustness", "warning", "LimitedReturnPaths", "low",
                "Too few return paths for the edge cases", "Return a value on every path")),
        (f"{extracts} AND NOT rlike({code}, {sql_literal(INPUT_CHECK)})",
         _issue("robustness", "warning", "MissingInputValidation", "medium",
                "Input parameters are not validated", "Test inputs for None and emptiness")),
    )
    found = f"concat({escapes}, {rest})"
    for name, value in reversed(counted.items()):
        found = sql_let(value, name, found)
    return found


def code_lint(codes: DataFrame) -> DataFrame:
    """Text rules over every row: one row per issue or warning."""
    return codes.selectExpr("subject_id", f"inline({text_rules()})")


FACTS_SCHEMA = """
subject_id bigint, code string,
error struct<type: string, message: string, line: int, offset: int, text: string>,
functions array<struct<class_name: string, name: string, params: array<string>,
    annotated: array<string>, returns: string>>,
classes array<string>, assigned array<string>
"""
# Facts are returned for about this many characters of sources at a time.
BATCH_CHARS = 1024 * 1024
_TEXTS = pa.list_(pa.string())
_FACTS_ARROW = pa.schema([
    ("subject_id", pa.int64()),
    ("code", pa.string()),
    ("error", pa.struct([("type", pa.string()), ("message", pa.string()), ("line", pa.int32()),
                         ("offset", pa.int32()), ("text", pa.string())])),
    ("functions", pa.list_(pa.struct([("class_name", pa.string()), ("name", pa.string()), ("params", _TEXTS),
                                      ("annotated", _TEXTS), ("returns", pa.string())]))),
    ("classes", _TEXTS),
    ("assigned", _TEXTS),
])


def _facts(code: str | None) -> dict:
    facts: dict = {"error": None, "functions": [], "classes": [], "assigned": []}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # doubtful escapes are a text rule of their own
            tree = ast.parse(code or "")
    except SyntaxError as exc:
        facts["error"] = {"type": "SyntaxError", "message": str(exc), "line": exc.lineno,
                          "offset": exc.offset, "text": exc.text}
        return facts
    except Exception as exc:
        facts["error"] = {"type": "ParseError", "message": f"Failed to parse code: {exc}"}
        return facts
    owner: dict[int, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            facts["classes"].append(node.name)
            owner.update((id(child), node.name) for child in node.body)
        elif isinstance(node, ast.FunctionDef):
            facts["functions"].append({
                "class_name": owner.get(id(node)),
                "name": node.name,
                "params": [a.arg for a in node.args.args],
                "annotated": [a.arg for a in node.args.args if a.annotation is not None],
                "returns": ast.unparse(node.returns) if node.returns is not None else None,
            })
        elif isinstance(node, ast.Assign):
            facts["assigned"].extend(t.id for t in node.targets if isinstance(t, ast.Name))
    return facts


def _fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts a few sources at a time; the sources themselves are passed on as they came."""
    for batch in batches:
        sources, start, chars, facts = batch.column(1), 0, 0, []
        for k, source in enumerate(sources):
            code = source.as_py()
            facts.append(_facts(code))
            chars += len(code or "")
            if chars >= BATCH_CHARS or k + 1 == len(sources):
                given = batch.slice(start, k + 1 - start)
                found = [pa.array([f[name] for f in facts], _FACTS_ARROW.field(name).type) for name in _FACTS_ARROW.names[2:]]
                yield pa.RecordBatch.from_arrays([*given.columns, *found], names=_FACTS_ARROW.names)
                start, chars, facts = k + 1, 0, []


def code_facts(codes: DataFrame) -> DataFrame:
    """Parse every source once; one row per source with its error or its facts."""
    return codes.select(F.col("subject_id").cast("bigint"), "code").mapInArrow(_fact_batches, FACTS_SCHEMA)


def code_syntax(facts: DataFrame) -> DataFrame:
    """One row per source that does not parse."""
    return facts.filter(F.col("error").isNotNull()).select("subject_id", "error.*")


def interface_rules(
    class_name: str = "HTMLExtractor",
    method: str = "extract",
    init_params: tuple[str, ...] = ("schema",),
    method_params: tuple[str, ...] = ("html_content", "file_path"),
    returns: str = "dict",
    constant: str | None = "SCHEMA",
) -> str:
    """SQL for the array of interface issues over the fact columns of ``code_facts``."""
    owner = sql_literal(class_name)
    mine = f"filter(functions, f -> f.class_name <=> {owner})"
    others = f"filter(functions, f -> NOT f.class_name <=> {owner})"
    inits = f"filter({mine}, f -> f.name = '__init__')"
    methods = f"filter({mine}, f -> f.name = {sql_literal(method)})"
    # only the last definition of the method counts for the forbidden types
    last = f"slice({methods}, greatest(size({methods}), 1), 1)"
    accepted = "array(" + ", ".join(map(sql_literal, method_params)) + ")"
    names = ", ".join(method_params)

    def each(found: str, condition: str, type_: str, severity: str, message: str, suggestion: str, kind: str = "issue") -> str:
        issue = _issue("interface", kind, type_, severity, message, suggestion)
        return f"transform(filter({found}, f -> {condition}), f -> {issue})"

    def with_return(text: str) -> str:
        return f"=concat({sql_literal(text)}, f.returns)"

    groups: list[str] = []
    for p in init_params:
        param = sql_literal(p)
        groups += [
            each(inits, f"NOT array_contains(f.params, {param})", "MissingSchemaParameter", "high",
                 f"{class_name}.__init__() needs parameter {p}", f"Add {p}"),
            each(inits, f"array_contains(f.params, {param}) AND NOT array_contains(f.annotated, {param}) AND f.returns IS NULL",
                 "MissingTypeHint", "medium", f"Parameter {p} has no type hint", f"Annotate {p}", "warning"),
        ]
    groups += [
        each(methods, f"NOT arrays_overlap(f.params, {accepted})", "InvalidExtractParameters", "high",
             f"{method}() must accept one of: {names}", f"Add one of: {names}"),
        each(methods, "f.returns IS NULL", "MissingReturnType", "high",
             f"{method}() has no return annotation", f"Annotate the return as {returns}"),
        each(methods, f"NOT contains(lower(f.returns), {sql_literal(returns)})", "InvalidReturnType", "high",
             with_return(f"{method}() must return {returns}, found: "), f"Annotate the return as {returns}"),
        each(others, "f.name = 'extract_content'", "ForbiddenFunction", "high",
             "Function extract_content() is not allowed", f"Use {class_name}.{method}()"),
        each(mine, f"f.name IN ({', '.join(map(sql_literal, FORBIDDEN_METHODS))})", "ForbiddenMethodName", "high",
             "=concat('Method is not allowed: ', f.name)", f"Name it {method}"),
        _fired((f"NOT array_contains(classes, {owner})",
                _issue("interface", "issue", "MissingHTMLExtractorClass", "high",
                       f"Class {class_name} is not defined", f"Define {class_name} with {method}()"))),
    ]
    for word in FORBIDDEN_RETURNS:
        groups.append(each(last, f"contains(f.returns, {sql_literal(word)})", "InvalidReturnType", "high",
                           with_return(f"{method}() must return a plain {returns}, found: "), f"Return a plain {returns}"))
    if constant:
        groups.append(_fired((f"NOT array_contains(assigned, {sql_literal(constant)})",
                              _issue("interface", "warning", "MissingSchemaConstant", "low",
                                     f"Constant {constant} is not defined", f"Define {constant}"))))
    return f"concat({', '.join(groups)})"


def code_interface(facts: DataFrame, **names) -> DataFrame:
    """Interface rules over parsed facts; sources with syntax errors give no row.

    The same rules with other names serve the Markdown converter
    (``class_name='MarkdownConverter', method='convert', init_params=(),
    method_params=('json_data',), returns='str', constant=None``).
    """
    return facts.filter(F.col("error").isNull()).selectExpr("subject_id", f"inline({interface_rules(**names)})")


def all_issues(codes: DataFrame, **names) -> DataFrame:
    """Syntax errors, text rules and interface rules; every source is parsed once."""
    syntax = _fired(
        ("error IS NOT NULL", _issue("syntax", "issue", "SyntaxError", None, "=error.message", None, "error.line"))
    )
    interface = f"filter({interface_rules(**names)}, i -> error IS NULL)"
    return code_facts(codes).selectExpr(
        "subject_id", f"inline(concat({syntax}, {text_rules()}, {interface}))"
    )


def issue_rollup(codes: DataFrame, issues: DataFrame) -> DataFrame:
    """Per source: counts, ``valid`` (no issue) and ``needs_review``.

    Sources without any row in ``issues`` appear as valid. Warnings leave a source valid;
    only robustness warnings ask for a review.
    """
    is_issue = F.col("kind") == "issue"
    per_subject = issues.groupBy("subject_id").agg(
        *[
            F.count_if(is_issue & (F.col("check_group") == g)).alias(f"{g}_issues")
            for g in ("syntax", "robustness", "interface")
        ],
        F.count_if(F.col("kind") == "warning").alias("warnings"),
        F.count_if((F.col("kind") == "warning") & (F.col("check_group") == "robustness")).alias("robustness_warnings"),
    )
    counts = [c for c in per_subject.columns if c != "subject_id"]
    joined = codes.select("subject_id").join(per_subject, "subject_id", "left").na.fill(0, counts)
    any_issue = F.col("syntax_issues") + F.col("robustness_issues") + F.col("interface_issues") > 0
    return joined.select(
        "subject_id", *counts,
        (~any_issue).alias("valid"),
        (any_issue | (F.col("robustness_warnings") > 0)).alias("needs_review"),
    )


def top_issues(issues: DataFrame, limit: int = 3) -> DataFrame:
    """First ``limit`` issues per source and group, with the group's total.

    The rank filter is applied before the shuffle as well, so a source with very many
    issues sends only ``limit`` rows per task; its total is a partial count.
    """
    keys = ["subject_id", "check_group"]
    order = [F.col("line").asc_nulls_last(), "type", "message"]
    real = issues.filter(F.col("kind") == "issue")
    totals = real.groupBy(*keys).agg(F.count("*").alias("total"))
    ranked = real.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit).join(totals, keys).select(
        *keys, "rank", "type", "severity", "message", "line", "total"
    )


def revalidation_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues ``fixed``, ``remaining`` or ``new`` after a fix, per source and type."""
    def counted(issues: DataFrame, name: str) -> DataFrame:
        return issues.groupBy("subject_id", "type").agg(F.count("*").alias(name))

    both = counted(before, "n_before").join(counted(after, "n_after"), ["subject_id", "type"], "full_outer")
    return both.select(
        "subject_id", "type",
        F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"),
        F.when(F.col("n_after").isNull(), "fixed")
        .when(F.col("n_before").isNull(), "new")
        .otherwise("remaining")
        .alias("state"),
    )


def settle_review(reviews: DataFrame) -> DataFrame:
    """``(subject_id, code, review)`` to the code to use: the review's fix if it parses."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subject_id, code, fixed = batch.columns
            good = pa.array([f is not None and _facts(f)["error"] is None for f in fixed.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [subject_id, pc.if_else(good, fixed, code), good], names=["subject_id", "code", "fixed"]
            )

    offered = reviews.select(F.col("subject_id").cast("bigint"), "code", reviewed_code(F.col("review")).alias("fixed"))
    return offered.mapInArrow(settle, "subject_id bigint, code string, fixed boolean")

"""Reading JSON, code and suggestions out of raw model-response text, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domloom.functions.columns import let, strip

JSON_FENCE = r"(?s)```json\s*(\{.*?\})\s*```"
ANY_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
OUTER_OBJECT = r"(?s)\{.*\}"
CODE_FENCE = r"(?s)```(?:python3|python)?\s*(.*?)```"
AFTER_MARKER = r"(?is)(?:fixed code|corrected code|updated code|here.*?code)[:\n]+(.*?)(?:\n\n|\z)"
# Text that makes a snippet look like Python, and the least length accepted.
CODE_WORDS = ("def ", "import ", "class ", "from ", "if ", "return ")
LEAST_CODE = 100

# Strategies after parsing the whole text, in order: (name, pattern, group). A pattern that
# matches decides the outcome, whether or not its text parses, except in ``visual``.
MODES: dict[str, tuple[tuple[str, str, int], ...]] = {
    "analyzer": (("fenced", JSON_FENCE, 1),),
    "schema": (("fenced", JSON_FENCE, 1), ("outermost", OUTER_OBJECT, 0)),
    "synthesis": (),
    "content": (("fenced", ANY_FENCE, 1),),
    "visual": (("outermost", OUTER_OBJECT, 0),),
}


def is_json(text: Column) -> Column:
    """Whether ``text`` is exactly one JSON value.

    The parsers stop after the first value, so trailing text has to be ruled out: only a
    single value is valid both as the one element of an array and as the one member of an
    object.
    """
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    as_member = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}"))))
    may_be_json = text.rlike(r'^\s*[\[{"tfn0-9-]')
    return F.coalesce(may_be_json & as_element & (as_member == 1), F.lit(False))


def salvage_json(text: Column, mode: str) -> Column:
    """``struct(strategy, json, raw)``.

    ``strategy`` is ``whole``, ``fenced``, ``outermost``, ``raw`` (nothing looked like JSON)
    or ``error`` (the part that looked like JSON does not parse). ``json`` is the part that
    parsed, ``raw`` the input where none did.
    """
    def outcome(strategy: str, json: Column | None) -> Column:
        return F.struct(
            F.lit(strategy).alias("strategy"),
            (json if json is not None else F.lit(None).cast("string")).alias("json"),
            (F.lit(None).cast("string") if json is not None else text).alias("raw"),
        )

    result = outcome("raw", None)
    for name, pattern, group in reversed(MODES[mode]):
        found = F.regexp_extract(text, pattern, group)
        failed = outcome("raw" if mode == "visual" else "error", None)
        result = F.when(found != "", F.when(is_json(found), outcome(name, found)).otherwise(failed)).otherwise(result)
    if mode != "visual":
        result = F.when(is_json(text), outcome("whole", text)).otherwise(result)
    return result


def extract_fenced_code(text: Column) -> Column:
    """Body of the first code fence, or the whole text, stripped."""
    return strip(F.when(text.rlike(CODE_FENCE), F.regexp_extract(text, CODE_FENCE, 1)).otherwise(text))


def reviewed_code(text: Column) -> Column:
    """Code a review offers as the fix, or null where it offers none worth parsing."""
    fenced = strip(F.regexp_extract(text, CODE_FENCE, 1))
    fenced = F.regexp_replace(F.regexp_replace(fenced, r"(?m)^```+\s*", ""), r"(?m)\s*```+$", "")
    marked = F.regexp_extract(text, AFTER_MARKER, 1)
    marked = strip(F.regexp_replace(F.regexp_replace(strip(marked), r"```(?:python3|python)?\s*", ""), r"```\s*", ""))

    def choose(code: Column) -> Column:
        looks_like_code = F.lit(False)
        for word in CODE_WORDS:
            looks_like_code = looks_like_code | code.contains(word)
        return F.when(
            ~looks_like_code & (code != "") & (F.length(marked) > LEAST_CODE), marked
        ).otherwise(code)

    return let(let(strip(fenced), choose), lambda code: F.when(F.length(code) >= LEAST_CODE, code))


def review_suggestions(text: Column) -> Column:
    """Bullet lines of a review, stripped, in order."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(lines, lambda line: line.startswith("-") | line.startswith("*"))


def fix_json_bools(code: Column) -> Column:
    """JSON ``true``/``false`` values in Python source to ``True``/``False``."""
    code = F.regexp_replace(code, r"(?U):\s*false\s*([,}])", ": False$1")
    return F.regexp_replace(code, r"(?U):\s*true\s*([,}])", ": True$1")

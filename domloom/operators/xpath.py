"""XPath expressions compiled on the driver to Spark SQL over the node array.

Supported: child and descendant steps, ``following-sibling::`` and ``preceding-sibling::``, names and
``*``, unions with ``|``, a final ``/@a`` or ``/text()``, ``(path)[n]`` for a place among all matches
of the page, and any number of predicates per step:

* places among the siblings that pass the predicates before: ``[n]``, ``[last()]``, ``[last()-n]``,
  and ``position()`` compared with one of these; on sibling steps only ``[1]`` after the name
* ``@a``, ``text()``, ``.``, ``normalize-space()`` compared with a string by ``=`` or ``!=``, or searched by
  ``contains`` and ``starts-with``; the class token test ``contains(concat(' ',@class,' '),' v ')``
* existence: ``@a``, ``text()``, ``li``, ``li/a``, ``.//a``, ``a/@href``, and such a path compared with a string
* ``not()`` of one of them, and conjunctions and disjunctions without parentheses

Anything else compiles to an expression that matches nothing and carries a reason.

Everything is linear in the page but for a factor of its logarithm. A chain of child steps walks parent
pointers, which is one array access per step. What a step needs to know about other elements is
put into arrays by element number once per page: the elements below a set of contexts come from
their subtree intervals, contexts inside others left out by a running maximum; existence is a
semi-join on the parent's number, or a difference of running counts over an interval; places come
from neighbours in the order of parents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.functions.columns import sql_let, sql_literal, sql_strip, step_prefix
from domloom.operators.nodes import node_text_sql, path_sql

# A test turns the SQL name of a node into a SQL condition.
Test = Callable[[str], str]

_NAME = r"[A-Za-z_][\w.-]*"
_ATTRIBUTE = r"@[A-Za-z_][\w.:-]*"
_STRING = r"(?:'[^']*'|\"[^\"]*\")"
_INSIDE = rf"(?:\.//|\./)?(?:\*|{_NAME})(?:/(?:\*|{_NAME}))*(?:/{_ATTRIBUTE})?"
_TEXT = r"(?:normalize-space\(\s*(?:\.|text\(\))?\s*\)|text\(\)|\.)"
_PLACE = r"(?:\d+|last\(\)(?:\s*-\s*\d+)?)"
# What a predicate can hold, each as one pattern with the groups the compiler reads.
_HAS = rf"({_ATTRIBUTE}|text\(\)|{_INSIDE})"
_EQUALS = rf"({_ATTRIBUTE}|{_TEXT}|{_INSIDE})\s*(=|!=)\s*({_STRING})"
_SEARCH = rf"(contains|starts-with)\(\s*({_ATTRIBUTE}|{_TEXT})\s*,\s*({_STRING})\s*\)"
_TOKEN = (
    r"contains\(\s*concat\(\s*['\"] ['\"]\s*,\s*(?:normalize-space\(\s*@class\s*\)|@class)\s*,"
    r"\s*['\"] ['\"]\s*\)\s*,\s*['\"] ([^\s'\"]+) ['\"]\s*\)"
)
_POSITION = rf"position\(\)\s*(=|!=|<=|>=|<|>)\s*({_PLACE})"
_SIBLING = r"(following|preceding)-sibling::"

_PREDICATES = r"((?:\[(?:[^\]'\"]|'[^']*'|\"[^\"]*\")*\])*)"
_STEP = re.compile(rf"(//?)(?:{_SIBLING})?(\*|{_NAME}+)(?!\(|::){_PREDICATES}")
_PREDICATE = re.compile(r"\[((?:[^\]'\"]|'[^']*'|\"[^\"]*\")*)\]")
_TAIL = re.compile(r"(?:/text\(\)|(//?)@([A-Za-z_][\w.:-]*))\Z")
_GROUP_PLACE = re.compile(rf"\[\s*(?:({_PLACE})|{_POSITION})\s*\]")


def _shape() -> str:
    """The same grammar as one regular expression for ``rlike``, from the patterns above."""

    def predicate(*extra: str, places: str = "") -> str:
        atom = rf"(?:{'|'.join([_EQUALS, _SEARCH, _TOKEN, _HAS, *extra])})"
        part = rf"(?:{atom}|not\(\s*{atom}\s*\))"
        return rf"\[\s*(?:{places}{part}(?:\s+(?:and|or)\s+{part})*)\s*\]"

    step = rf"(?:\*|{_NAME})(?:{predicate(_POSITION, places=_PLACE + '|')})*"
    sibling = rf"/{_SIBLING}(?:\*|{_NAME})(?:\[\s*1\s*\])?(?:{predicate()})*"
    further = rf"(?://?{step}|{sibling})*"
    steps = rf"(?:\.?//?)?{step}{further}"
    grouped = rf"\(\s*{steps}(?:\s*\|\s*{steps})*\s*\)\[\s*(?:{_PLACE}|{_POSITION})\s*\]{further}"
    path = rf"(?:{grouped}|{steps})"
    tail = rf"(?:/text\(\)|//?{_ATTRIBUTE})"
    alone = rf"(?:(?:\./)?(?:text\(\)|{_ATTRIBUTE})|\.?//{_ATTRIBUTE})"
    return rf"(?U)\A\s*(?:{alone}|{path}{tail}?|{path}(?:\s*\|\s*{path})+)\s*\z"


#: What ``compile_xpath`` supports, for checks over large schema tables.
XPATH_SHAPE = _shape()


class Unsupported(ValueError):
    pass


@dataclass
class XPath:
    expression: str
    #: Arrays computed once per page, in order, and the matches in terms of them.
    bindings: list[tuple[str, str]] = field(default_factory=list)
    result: str = "filter(nodes, n -> false)"
    attribute: str | None = None
    text_only: bool = False
    fields: frozenset[str] = frozenset()
    reason: str | None = None

    @property
    def supported(self) -> bool:
        return self.reason is None

    def select(self) -> str:
        """SQL for the matching elements of ``nodes`` in document order."""
        hits, bindings = self.result, self.bindings
        if bindings and bindings[-1][0] == hits:
            *bindings, (_, hits) = bindings
        if self.attribute:
            hits = f"filter({hits}, n -> n.attrs[{sql_literal(self.attribute)}] IS NOT NULL)"
        for name, value in reversed(bindings):
            hits = sql_let(value, name, hits)
        return hits

    def value(self, n: str, full_text: bool = False, runs: str = "runs") -> str:
        """SQL for what the expression yields for the matching element ``n``."""
        if self.attribute:
            return f"{n}.attrs[{sql_literal(self.attribute)}]"
        if full_text and not self.text_only:
            return sql_strip(node_text_sql(n, runs))
        return f"{n}.text_head"


# -- arrays by element number --------------------------------------------------------------


def _marks(numbers: str) -> str:
    """Sorted distinct numbers as truth values by place."""
    return sql_let(
        f"concat(array(0), {numbers})", "s",
        "flatten(transform(slice(s, 2, greatest(size(s) - 1, 0)), (v, i) -> concat(array_repeat(false, v - s[i] - 1), array(true))))",
    )


def _sorted(numbers: str) -> str:
    return f"filter(array_sort(array_distinct({numbers})), v -> v > 0)"


def _running_counts(numbers: str) -> str:
    """How many of sorted distinct numbers are at most 0, 1, 2, ... up to the number of elements."""
    return sql_let(
        f"concat(array(0), {numbers})", "s",
        "flatten(transform(s, (v, i) -> array_repeat(i, coalesce(get(s, i + 1), size(nodes) + 1) - v)))",
    )


def _below(context: str, or_self: bool) -> str:
    """Truth values for all elements below those of ``context``, which are in document order.

    The running maximum of their intervals' ends takes one round per doubling of the distance. A
    context that ends before it lies inside another and adds nothing.
    """
    distances = ", ".join(str(1 << k) for k in range(27))
    ends = (
        f"aggregate(filter(array({distances}), d -> d < size({context})), transform({context}, c -> c.last_nid), "
        "(ends, d) -> transform(ends, (v, i) -> greatest(v, get(ends, i - d))))"
    )
    own = 1 if or_self else 0
    part = f"""CASE WHEN c.last_nid <= coalesce(get(ends, i - 1), 0) THEN CAST(array() AS ARRAY<BOOLEAN>)
        ELSE concat(array_repeat(false, c.nid - coalesce(get(ends, i - 1), 0) - {own}), array_repeat(true, c.last_nid - c.nid + {own})) END"""
    return sql_let(ends, "ends", f"flatten(transform({context}, (c, i) -> {part}))")


def _is(marks: str, number: str) -> str:
    return f"coalesce(get({marks}, {number} - 1), false)"


# -- the compiler --------------------------------------------------------------------------


def _unquoted(literal: str) -> str:
    return sql_literal(literal[1:-1])


def _place_test(operator: str, place: str, near: Callable[[str], str]) -> str:
    """SQL for a condition on a place; ``near`` tells whether there is another one so far from it."""
    number = re.fullmatch(r"\d+", place)
    if number:
        n = int(place)
        last = False
    else:
        n, last = int(re.sub(r"\D", "", place) or 0), True
    # Distance to the other end: the first place, or the last one.
    at_least = lambda k: "true" if k <= 0 else near(f"{'+' if last else '-'} {k}")
    k = n if last else n - 1
    exactly = f"({at_least(k)} AND NOT {at_least(k + 1)})" if k >= 0 else "false"
    beyond, from_here = f"{at_least(k + 1)}", at_least(k)
    if last:
        # position() < last() - n means that more than n follow.
        tests = {"<": beyond, "<=": from_here, ">": f"NOT {from_here}", ">=": f"NOT {beyond}"}
    else:
        tests = {">": beyond, ">=": from_here, "<": f"NOT {from_here}", "<=": f"NOT {beyond}"}
    return {"=": exactly, "!=": f"NOT {exactly}", **tests}[operator]


class _Compiler:
    """Gathers the arrays that an expression needs, and the node fields it reads."""

    def __init__(self) -> None:
        self.bindings: list[tuple[str, str]] = []
        self.fields = {"nid", "parent_nid", "tag"}

    def bind(self, value: str) -> str:
        name = f"x{len(self.bindings)}"
        self.bindings.append((name, value))
        return name

    # -- predicates ------------------------------------------------------------------------
    def _text_value(self, operand: str, n: str) -> str:
        """String value of the first node that ``operand`` stands for."""
        if operand.startswith("@"):
            if operand == "@id":
                self.fields.add("id")
                return f"{n}.id"
            self.fields.add("attrs")
            return f"{n}.attrs[{sql_literal(operand[1:])}]"
        inner = re.sub(r"\s", "", operand)
        if inner.endswith("text())") or inner == "text()":
            self.fields.add("own_texts")
            value = f"get({n}.own_texts, 0)"
        else:
            self.fields |= {"run_start", "run_end"}
            value = node_text_sql(n)
        if inner.startswith("normalize-space"):
            value = f"trim(regexp_replace(coalesce({value}, ''), {sql_literal(r'[ \t\r\n]+')}, ' '))"
        return value

    def _inside(self, path: str, compare: Test | None) -> Test:
        """Whether the path leads anywhere; with ``compare`` to a node whose value passes."""
        steps, _, attribute = path.partition("/@")
        below = steps.startswith(".//")
        names = steps.removeprefix(".//").removeprefix("./").split("/")
        conditions, at, top = [], "c", "c"
        for name in reversed(names):
            if name != "*":
                conditions.append(f"{at}.tag = {sql_literal(name)}")
            top, at = at, f"get(nodes, {at}.parent_nid - 1)"
        # Every step must exist, also an unnamed one.
        conditions.append(f"{top}.nid IS NOT NULL")
        if attribute:
            value = self._text_value(f"@{attribute}", "c")
            conditions.append(compare(value) if compare else f"{value} IS NOT NULL")
        elif compare:
            conditions.append(compare(self._text_value(".", "c")))
        ends = f"filter(nodes, c -> {' AND '.join(conditions)})"
        if not below:
            marks = self.bind(_marks(_sorted(f"transform({ends}, c -> {top}.parent_nid)")))
            return lambda n: _is(marks, f"{n}.nid")
        self.fields.add("last_nid")
        counts = self.bind(_running_counts(_sorted(f"transform({ends}, c -> {top}.nid)")))
        return lambda n: f"(get({counts}, {n}.last_nid) > get({counts}, {n}.nid))"

    def _places(self, candidates: list[Test], operator: str, place: str) -> Test:
        """A place among the siblings that pass ``candidates``: of those in the order of parents, the
        place is told by whether the neighbour so far away has the same parent."""
        passing = " AND ".join(test("n") for test in candidates) or "true"
        ordered = self.bind(
            f"array_sort(transform(filter(nodes, n -> {passing}), n -> struct(n.parent_nid AS parent, n.nid AS nid)))")
        condition = _place_test(operator, place, lambda d: f"coalesce(get({ordered}, i {d}).parent = e.parent, false)")
        marks = self.bind(_marks(_sorted(f"transform(filter({ordered}, (e, i) -> {condition}), e -> e.nid)")))
        return lambda n: _is(marks, f"{n}.nid")

    def _atom(self, source: str, candidates: list[Test] | None) -> Test:
        if m := re.fullmatch(_POSITION, source):
            if candidates is None:
                raise Unsupported("position on a sibling step")
            return self._places(candidates, m[1], m[2])
        if m := re.fullmatch(_TOKEN, source):
            self.fields.add("cls")
            return lambda n: f"array_contains({n}.cls, {sql_literal(m[1])})"
        if m := re.fullmatch(_EQUALS, source):
            operand, operator, value = m[1], m[2], _unquoted(m[3])
            compare = lambda v: f"{v} {operator} {value}"
            if operand == "text()":
                self.fields.add("own_texts")
                return lambda n: f"exists({n}.own_texts, t -> {compare('t')})"
            if re.fullmatch(rf"{_ATTRIBUTE}|{_TEXT}", operand):
                return lambda n: f"({compare(self._text_value(operand, n))})"
            return self._inside(operand, compare)
        if m := re.fullmatch(_SEARCH, source):
            function = "contains" if m[1] == "contains" else "startswith"
            # A missing node is an empty string, in which only the empty string is found.
            absent = "" if m[2].startswith("@") else ", ''"
            value = lambda n: f"coalesce({self._text_value(m[2], n)}{absent})"
            return lambda n: f"{function}({value(n)}, {_unquoted(m[3])})"
        if m := re.fullmatch(_HAS, source):
            if source == "text()":
                self.fields.add("own_texts")
                return lambda n: f"size({n}.own_texts) > 0"
            if source.startswith("@"):
                self.fields.add("attrs")
                return lambda n: f"{n}.attrs[{sql_literal(source[1:])}] IS NOT NULL"
            return self._inside(source, None)
        raise Unsupported(f"predicate [{source}]")

    def _condition(self, body: str, candidates: list[Test] | None) -> Test:
        """``or`` of ``and`` of atoms, each of which may be negated."""
        outside_quotes = r"(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*\Z)"
        alternatives: list[list[Test]] = []
        for alternative in re.split(rf"\s+or\s+{outside_quotes}", body):
            alternatives.append([])
            for part in re.split(rf"\s+and\s+{outside_quotes}", alternative):
                part = part.strip()
                if m := re.fullmatch(r"not\(\s*(.*?)\s*\)", part, re.S):
                    positive = self._atom(m[1], candidates)
                    alternatives[-1].append(lambda n, test=positive: f"NOT coalesce({test(n)}, false)")
                else:
                    alternatives[-1].append(self._atom(part, candidates))

        def combined(n: str) -> str:
            # A comparison with a missing value is false, which matters below a negation only.
            return "(" + " OR ".join(" AND ".join(t(n) for t in tests) for tests in alternatives) + ")"

        # What a test reads is known once it is written down.
        combined("n")
        return combined

    def _step_tests(self, name: str, predicates: str, sibling: bool) -> tuple[list[Test], bool]:
        """Conditions of a step, and whether a sibling step wants only the nearest match."""
        tests: list[Test] = [lambda n: f"{n}.tag = {sql_literal(name)}"] if name != "*" else []
        nearest = False
        for k, body in enumerate(_PREDICATE.findall(predicates)):
            body = body.strip()
            if not re.fullmatch(_PLACE, body):
                tests.append(self._condition(body, None if sibling else list(tests)))
            elif sibling:
                if k or body != "1":
                    raise Unsupported(f"predicate [{body}] on a sibling step")
                nearest = True
            elif not k and name != "*" and re.fullmatch(r"\d+|last\(\)", body):
                self.fields |= {"idx", "n_same"}
                place = "{n}.n_same" if body == "last()" else str(int(body))
                tests.append(lambda n, place=place: f"{n}.idx = {place.format(n=n)}")
            else:
                tests.append(self._places(list(tests), "=", body))
        return tests, nearest

    # -- paths -----------------------------------------------------------------------------
    def _chain(self, steps: list[list[Test]], anchor: Callable[[str], str] | None) -> str:
        """Elements that a chain of child steps leads to; ``anchor`` is a condition on its first."""
        conditions: list[str] = []
        at = top = "n"
        for tests in reversed(steps):
            conditions += [test(at) for test in tests] or [f"{at}.nid IS NOT NULL"]
            top, at = at, f"get(nodes, {at}.parent_nid - 1)"
        if anchor:
            conditions.append(anchor(top))
        return self.bind(f"filter(nodes, n -> {' AND '.join(conditions)})")

    def _siblings(self, context: str, following: bool, nearest: bool, tests: list[Test]) -> str:
        """Matches after (before) an element of ``context`` with the same parent."""
        passing = " AND ".join(test("n") for test in tests) or "true"
        number = "n.nid" if following else "-n.nid"
        events = (  # a context is seen after the same element as a match
            f"concat(transform({context}, n -> struct(n.parent_nid AS parent, {number} AS at, 1 AS kind)), "
            f"transform(filter(nodes, n -> {passing}), n -> struct(n.parent_nid AS parent, {number} AS at, 0 AS kind)))"
        )
        ordered = self.bind(f"array_sort({events})")
        if nearest:
            chosen = f"filter({ordered}, (e, i) -> e.kind = 0 AND get({ordered}, i - 1).kind = 1 AND get({ordered}, i - 1).parent = e.parent)"
        else:
            # The first context of a parent opens all that follows in it.
            first = self.bind(
                f"filter(filter({ordered}, e -> e.kind = 1), e -> e.parent > 0)")
            opening = self.bind(f"filter({first}, (e, i) -> NOT coalesce(get({first}, i - 1).parent = e.parent, false))")
            opens = self.bind(sql_let(
                f"concat(array(0), transform({opening}, e -> e.parent))", "s",
                f"flatten(transform({opening}, (e, i) -> concat(array_repeat(CAST(NULL AS INT), e.parent - s[i] - 1), array(e.at))))"))
            chosen = f"filter({ordered}, e -> e.kind = 0 AND e.at > get({opens}, e.parent - 1))"
        marks = self.bind(_marks(_sorted(f"transform({chosen}, e -> abs(e.at))")))
        return self.bind(f"filter(nodes, n -> {_is(marks, 'n.nid')})")

    def path(self, source: str, context: str | None, or_self: bool = False) -> str:
        """The array of what ``source`` selects, from the document or from ``context``."""
        chain: list[list[Test]] = []
        anchor: Callable[[str], str] | None = None
        at = 0
        while at < len(source):
            m = _STEP.match(source, at)
            if not m:
                raise Unsupported(f"syntax at {source[at:]!r}")
            at = m.end()
            deep, axis = m[1] == "//", m[2]
            tests, nearest = self._step_tests(m[3], m[4], bool(axis))
            if axis and deep:
                raise Unsupported("a sibling axis after //")
            if chain and (deep or axis):
                context, chain = self._chain(chain, anchor), []
            if axis:
                if context is None:
                    raise Unsupported("a sibling axis at the start")
                context = self._siblings(context, axis == "following", nearest, tests)
                continue
            if not chain:
                anchor = self._anchor(context, deep, or_self and at == len(source))
            chain.append(tests)
        return self._chain(chain, anchor) if chain else context

    def _anchor(self, context: str | None, deep: bool, or_self: bool) -> Callable[[str], str] | None:
        if context is None:
            return None if deep else (lambda top: f"{top}.parent_nid = 0")
        if deep:
            self.fields.add("last_nid")
            marks = self.bind(_below(context, or_self))
            return lambda top: _is(marks, f"{top}.nid")
        marks = self.bind(_marks(f"transform({context}, c -> c.nid)"))
        return lambda top: _is(marks, f"{top}.parent_nid")

    def group(self, source: str) -> tuple[str, str]:
        """``(path | path)[place]`` at the start of ``source``: its matches, and what follows."""
        end = _closing(source)
        m = _GROUP_PLACE.match(source, end + 1)
        if not m:
            raise Unsupported(f"syntax at {source[end + 1:]!r}")
        paths = [self.path(_absolute(part), None) for part in _split_union(source[1:end])]
        hits = paths[0] if len(paths) == 1 else self.bind(_united([f"transform({x}, n -> n.nid)" for x in paths]))
        test = _place_test(m[2] or "=", m[3] or m[1], lambda d: f"(i {d} >= 0 AND i {d} < size({hits}))")
        return self.bind(f"filter({hits}, (n, i) -> {test})"), source[m.end():]


def _united(numbers: list[str]) -> str:
    return f"transform(array_sort(array_distinct(concat({', '.join(numbers)}))), i -> get(nodes, i - 1))"


def _scan(source: str):
    """Characters outside quotes with the depth of brackets around them."""
    quote, depth = "", 0
    for i, c in enumerate(source):
        if quote:
            quote = "" if c == quote else quote
            continue
        if c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        yield i, c, depth


def _split_union(source: str) -> list[str]:
    cuts = [i for i, c, depth in _scan(source) if c == "|" and depth == 0]
    return [source[a + 1 : b].strip() for a, b in zip([-1, *cuts], [*cuts, len(source)])]


def _closing(source: str) -> int:
    for i, c, depth in _scan(source):
        if c == ")" and depth == 0:
            return i
    raise Unsupported("unbalanced parenthesis")


def _absolute(source: str) -> str:
    if not source:
        raise Unsupported("empty expression")
    if re.match(_SIBLING, source.removeprefix("./")):
        raise Unsupported("a sibling axis at the start")
    if source.startswith(".//"):
        return source[1:]
    if source.startswith("./"):
        return "/*/" + source[2:]
    return source if source.startswith("/") else "/*/" + source


def compile_xpath(expression: str) -> XPath:
    """Compile once on the driver; unsupported input gives an XPath with a ``reason``."""
    result = XPath(expression)
    source = (expression or "").strip()
    parts = _split_union(source)
    if len(parts) > 1:
        union = [compile_xpath(p) for p in parts]
        result.reason = next((x.reason for x in union if x.reason), None)
        if any(x.attribute or x.text_only for x in union):
            result.reason = result.reason or "unsupported: union of attributes or text"
        result.fields = frozenset().union(*(x.fields for x in union))
        if result.supported:
            result.result = _united([f"transform({x.select()}, n -> n.nid)" for x in union])
        return result
    compiler = _Compiler()
    try:
        if source.startswith("("):
            context, source = compiler.group(source)
        else:
            context, source = None, _absolute(source)
        below = False
        if tail := _TAIL.search(source):
            source = source[: tail.start()]
            result.attribute, result.text_only = tail[2], tail[2] is None
            if not source and tail[1] != "//" and context is None:
                raise Unsupported("the document itself has no attributes or text")
            # ``//@a`` starts at the elements it stands after.
            if below := tail[1] == "//":
                source += "//*"
            if result.attribute:
                compiler.fields.add("attrs")
        result.result = compiler.path(source, context, or_self=below)
        result.bindings = compiler.bindings
        result.fields = frozenset(compiler.fields)
    except Unsupported as exc:
        result.reason = f"unsupported: {exc}"
        result.attribute, result.text_only = None, False
    return result


def fields_for(expressions: Iterable[str], *extra: str) -> tuple[str, ...]:
    """Node fields the parser must emit for these expressions, plus ``extra``."""
    used = {"nid", "parent_nid", "tag", "text_head", *extra}
    for expression in expressions:
        used |= compile_xpath(expression).fields
    return tuple(sorted(used))


def select_xpath(parsed: DataFrame, expressions: Mapping[str, str], full_text: bool = False) -> DataFrame:
    """All matches of named expressions: ``(page_id, name, nid, xpath, value)``.

    Every expression is evaluated against the same parsed row, so any number of them costs
    one parse and no shuffle. Parse ``fields_for(expressions, *PATH_FIELDS)``.
    """

    def matches(name: str, xp: XPath) -> str:
        row = f"struct({sql_literal(name)} AS name, n.nid AS nid, {path_sql('n')} AS xpath, {xp.value('n', full_text)} AS value)"
        return f"transform({xp.select()}, n -> {row})"

    groups = ", ".join(matches(name, compile_xpath(x)) for name, x in expressions.items())
    return parsed.selectExpr("page_id", f"inline(concat({groups}))")


def xpath_text(parsed: DataFrame, expression: str) -> DataFrame:
    """Stripped text of every match: ``(page_id, nid, text)``."""
    xp = compile_xpath(expression)
    row = f"struct(n.nid AS nid, coalesce({xp.value('n', full_text=True)}, '') AS text)"
    return parsed.selectExpr("page_id", f"inline(transform({xp.select()}, n -> {row}))")


def common_xpath(nodes: DataFrame, *by: str) -> DataFrame:
    """Longest path that all elements of a group share: ``by`` columns, ``n, common``.

    Elements are counted by path first, which hashes and combines map-side, however many of
    them one group has; only distinct paths are sorted for the group's ends.
    """
    paths = nodes.groupBy(*by, "xpath").agg(F.count("*").alias("n"))
    ends = paths.groupBy(*by).agg(F.sum("n").alias("n"), F.min("xpath").alias("low"), F.max("xpath").alias("high"))
    return ends.select(*by, "n", step_prefix(F.col("low"), F.col("high")).alias("common"))


def unsupported_xpaths(spark: SparkSession, expressions: Mapping[str, str]) -> DataFrame:
    rows = [
        (name, x, compile_xpath(x).reason)
        for name, x in expressions.items()
        if not compile_xpath(x).supported
    ]
    return spark.createDataFrame(rows, "name string, xpath string, reason string")


def suggest_xpath(parsed: DataFrame, sample: str, window: int = 100, limit: int = 5) -> DataFrame:
    """First ``limit`` elements per page whose text has ``sample`` near its start.

    ``(page_id, rank, xpath)``; the comparison ignores case and looks at the first
    ``window`` characters of the stripped text.
    """
    text = sql_strip(node_text_sql("n"))
    near_start = f"contains(substring(lower({text}), 1, {window}), {sql_literal(sample.lower())})"
    hits = f"filter(nodes, n -> {near_start})"
    return parsed.select(
        "page_id",
        F.posexplode(F.expr(f"transform(slice({hits}, 1, {limit}), n -> {path_sql('n')})")).alias("pos", "xpath"),
    ).select("page_id", (F.col("pos") + 1).alias("rank"), "xpath")

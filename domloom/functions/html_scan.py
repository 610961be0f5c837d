"""One page of HTML to one list of elements in document order.

This is the only per-row Python in the hot path. It scans the source once with a single
token expression and keeps a stack of open elements; everything that can be computed from
the element list afterwards (XPath matching, text, sections, patterns) is Catalyst work.

Recovery rules, fixed here and pinned by golden tests:

* void elements never stay open; ``<br/>`` style self-closing is ignored on other tags
* a start tag closes the open elements it implies closed (``CLOSED_BY``), together with
  anything still open inside them; formatting tags are not re-opened afterwards
* fragments are wrapped in ``html`` and ``head``/``body``; bare text outside a body gets a ``p``
* blank text is dropped except inside text elements and after inline elements
* stray end tags are ignored; an inline end tag never closes across a block element
* end of input closes everything
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator


# Element classes of HTML.
VOID = frozenset(
    "area base basefont br col embed frame hr img input keygen link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_TEXT = frozenset("title textarea".split())
HEAD_ONLY = frozenset("title meta link base basefont script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label "
    "mark q s samp small span strike strong sub sup time tt u var".split()
)
KEEPS_BLANK = INLINE | HEADINGS | frozenset("p pre td th dt dd li caption legend option textarea".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form header hgroup hr main menu nav ol p pre section table ul li dt dd".split()
)
TABLE_SCOPE = frozenset("html table td th caption button object marquee template".split())
LIST_SCOPE = TABLE_SCOPE | frozenset("ul ol menu dir".split())
ROW_SCOPE = frozenset("html table template".split())

# Start tag -> (open elements it closes, elements the search stops at).
CLOSED_BY = {
    "li": (frozenset({"li"}), LIST_SCOPE),
    "dt": (frozenset({"dt", "dd"}), TABLE_SCOPE | {"dl"}),
    "dd": (frozenset({"dt", "dd"}), TABLE_SCOPE | {"dl"}),
    "option": (frozenset({"option"}), TABLE_SCOPE | {"select", "optgroup"}),
    "optgroup": (frozenset({"option", "optgroup"}), TABLE_SCOPE | {"select"}),
    "td": (frozenset({"td", "th"}), ROW_SCOPE | {"tr"}),
    "th": (frozenset({"td", "th"}), ROW_SCOPE | {"tr"}),
    "tr": (frozenset({"tr"}), ROW_SCOPE),
    "thead": (frozenset({"thead", "tbody", "tfoot"}), ROW_SCOPE),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), ROW_SCOPE),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), ROW_SCOPE),
    "a": (frozenset({"a"}), TABLE_SCOPE),
}
CLOSED_BY.update({h: (HEADINGS, TABLE_SCOPE | {"div", "section", "article", "li"}) for h in HEADINGS})
P_RULE = (frozenset({"p"}), TABLE_SCOPE)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s=/>\"'][^\s=/>]*+)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?", re.S
)
END_OF = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TEXT | ESCAPABLE_TEXT}


def parse_attributes(source: str) -> dict[str, str]:
    """Names in lower case, values with entities decoded; the first of equal names wins."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        name = name.lower()
        if name not in found:
            value = double or single or bare
            found[name] = _html.unescape(value) if "&" in value else value
    return found


class PageScan:
    """Elements of one page as parallel lists; position ``i`` is the element with nid ``i + 1``.

    The scan records only what needs the stack; the methods below derive the rest on demand.
    """

    __slots__ = (
        "source", "tag", "parent", "last", "attrs", "run_start", "run_end", "head_end",
        "html_start", "html_end", "runs", "owners", "_stack", "_opened", "_last_child", "_body",
    )

    def __init__(self, source: str):
        self.source = source
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self.run_start: list[int] = []
        self.run_end: list[int] = []
        self.head_end: list[int] = []
        self.html_start: list[int] = []
        self.html_end: list[int] = []
        self.runs: list[str] = []
        self.owners: list[int] = []
        self._stack: list[int] = []
        self._opened: dict[str, int] = {}
        self._last_child: list[str | None] = []
        self._body = -1
        self._scan()

    # -- stack -------------------------------------------------------------------------
    def _open(self, tag: str, attrs: dict[str, str], start: int) -> None:
        stack = self._stack
        at = len(self.tag)
        n_runs = len(self.runs)
        if stack:
            top = stack[-1]
            if self.head_end[top] < 0:
                self.head_end[top] = n_runs
            self._last_child[top] = tag
            self.parent.append(top + 1)
        else:
            self.parent.append(0)
        self.tag.append(tag)
        self.last.append(at + 1)
        self.attrs.append(attrs)
        self.run_start.append(n_runs)
        self.run_end.append(-1)
        self.head_end.append(-1)
        self.html_start.append(start)
        self.html_end.append(-1)
        self._last_child.append(None)
        stack.append(at)
        self._opened[tag] = self._opened.get(tag, 0) + 1

    def _mark_head(self, i: int) -> None:
        if self.head_end[i] < 0:
            self.head_end[i] = len(self.runs)

    def _close_top(self, end: int) -> None:
        i = self._stack.pop()
        self._opened[self.tag[i]] -= 1
        self._mark_head(i)
        self.run_end[i] = len(self.runs)
        self.last[i] = len(self.tag)
        if self.html_end[i] < 0:
            self.html_end[i] = end

    def _close_implied(self, closes: frozenset, scope: frozenset, at: int) -> None:
        # Without an open element of these names there is nothing to look for, however deep the stack.
        if not any(map(self._opened.get, closes)):
            return
        stack, tags = self._stack, self.tag
        for k in range(len(stack) - 1, -1, -1):
            name = tags[stack[k]]
            if name in closes:
                while len(stack) > k:
                    self._close_top(at)
                return
            if name in scope:
                return

    def _enter(self, tag: str, at: int) -> None:
        """Open the html/head/body wrappers that ``tag`` needs and are not there yet."""
        if not self._stack:
            self._open("html", {}, at)
        if self._body >= 0 or tag in ("head", "body", "frameset"):
            if tag in ("body", "frameset"):
                while len(self._stack) > 1:
                    self._close_top(at)
            return
        if tag in HEAD_ONLY:
            if len(self._stack) == 1:
                self._open("head", {}, at)
            return
        while len(self._stack) > 1:
            self._close_top(at)
        self._body = len(self.tag)
        self._open("body", {}, at)

    # -- tokens ------------------------------------------------------------------------
    def _start_tag(self, tag: str, attr_source: str, start: int) -> None:
        attrs = parse_attributes(attr_source) if attr_source and not attr_source.isspace() else {}
        if (tag == "html" and self._stack) or (tag == "body" and self._body >= 0) or (
            tag == "head" and (self._body >= 0 or len(self._stack) > 1)
        ):
            target = 0 if tag == "html" else self._body
            if target >= 0 and tag != "head":
                for name, value in attrs.items():
                    self.attrs[target].setdefault(name, value)
            return
        if tag != "html":
            self._enter(tag, start)
        if tag == "body":
            self._body = len(self.tag)
        if tag in CLOSES_P:
            self._close_implied(*P_RULE, start)
        rule = CLOSED_BY.get(tag)
        if rule:
            self._close_implied(*rule, start)
        self._open(tag, attrs, start)

    def _end_tag(self, tag: str, start: int, end: int) -> None:
        stack, tags = self._stack, self.tag
        if tag in ("html", "body"):
            # content after </body> still belongs to the body, so only note the position
            target = 0 if tag == "html" else self._body
            if 0 <= target < len(tags) and tags[target] == tag:
                self.html_end[target] = end
            return
        if not self._opened.get(tag):
            return
        for k in range(len(stack) - 1, -1, -1):
            name = tags[stack[k]]
            if name == tag:
                while len(stack) > k + 1:
                    self._close_top(start)
                self._close_top(end)
                return
            if name in ("table", "body", "html") or (
                name not in INLINE and (tag in INLINE or (tag == "p" and name != "p"))
            ):
                return

    def _text(self, text: str, at: int) -> None:
        if text.isspace():
            if not self._stack:
                return
            top = self._stack[-1]
            before = self._last_child[top]
            if before not in INLINE if before is not None else self.tag[top] not in KEEPS_BLANK:
                return
        elif self._body < 0 and (
            not self._stack or self.tag[self._stack[-1]] in ("html", "head")
        ):
            self._enter("p", at)
            self._open("p", {}, at)
        self.runs.append(text)
        self.owners.append(self._stack[-1])
        # text between two children counts as the last child for the blank rule
        if self._last_child[self._stack[-1]] is not None:
            self._last_child[self._stack[-1]] = "span"

    def _scan(self) -> None:
        source = self.source
        at, size = 0, len(source)
        search = TOKEN.search
        while at < size:
            token = search(source, at)
            stop = token.start() if token else size
            if stop > at:
                text = source[at:stop]
                self._text(_html.unescape(text) if "&" in text else text, at)
            if not token:
                break
            at = token.end()
            closing, tag, attr_source = token.group(1, 2, 3)
            if tag is None:
                closing, tag, attr_source = token.group(4, 5, 6)
            if tag is None:
                if source.startswith("<!--", stop) and self._stack:
                    self._mark_head(self._stack[-1])
                continue
            tag = tag.lower()
            if closing:
                self._end_tag(tag, stop, at)
                continue
            self._start_tag(tag, attr_source, stop)
            if tag in VOID:
                if self._stack and self.tag[self._stack[-1]] == tag:
                    self._close_top(at)
            elif tag in END_OF:
                ending = END_OF[tag].search(source, at)
                stop = ending.start() if ending else size
                if stop > at:
                    text = source[at:stop]
                    if tag in ESCAPABLE_TEXT and "&" in text:
                        text = _html.unescape(text)
                    if not text.isspace():
                        self.runs.append(text)
                        self.owners.append(self._stack[-1])
                at = stop
        while self._stack:
            self._close_top(size)

    # -- derived columns ---------------------------------------------------------------
    def text_heads(self) -> list[str | None]:
        runs = self.runs
        return ["".join(runs[s:e]) or None for s, e in zip(self.run_start, self.head_end)]

    def own_texts(self) -> list[list[str]]:
        """Texts that lie directly in each element, one per run."""
        texts: list[list[str]] = [[] for _ in self.tag]
        for owner, run in zip(self.owners, self.runs):
            texts[owner].append(run)
        return texts

    def _paths(self, steps: Iterable[str]) -> Iterator[str]:
        """Paths in document order; only those of the open elements are held."""
        opened: list[int] = []
        ends: list[int] = []
        path = ""
        for at, (parent, step) in enumerate(zip(self.parent, steps), 1):
            while opened and opened[-1] != parent:
                opened.pop()
                ends.pop()
            path = f"{path[: ends[-1] if ends else 0]}/{step}"
            opened.append(at)
            ends.append(len(path))
            yield path

    def gpaths(self) -> Iterator[str]:
        return (path[1:] for path in self._paths(self.tag))

    def path_numbers(self) -> list[int]:
        """A number per element, the same where ``gpaths`` are the same."""
        known: dict[tuple[int, str], int] = {}
        numbers: list[int] = []
        for parent, tag in zip(self.parent, self.tag):
            key = (numbers[parent - 1] if parent else 0, tag)
            numbers.append(known.setdefault(key, len(known) + 1))
        return numbers

    def depths(self) -> list[int]:
        depths: list[int] = []
        for parent in self.parent:
            depths.append(depths[parent - 1] + 1 if parent else 1)
        return depths

    @staticmethod
    def places(keys: list) -> tuple[list[int], list[int]]:
        """1-based place of each key among its equals, and the number of equals."""
        counts: dict = {}
        places = []
        for key in keys:
            counts[key] = place = counts.get(key, 0) + 1
            places.append(place)
        return places, [counts[key] for key in keys]

    def same_tag(self) -> tuple[list[int], list[int]]:
        """Place among the siblings with the same tag, and their number."""
        return self.places(list(zip(self.parent, self.tag)))

    def same_tag_and_class(self) -> tuple[list[int], list[int]]:
        return self.places([(p, t, a.get("class")) for p, t, a in zip(self.parent, self.tag, self.attrs)])

    def xpaths(self) -> Iterator[str]:
        return self._paths(f"{tag}[{idx}]" if n > 1 else tag for tag, idx, n in zip(self.tag, *self.same_tag()))

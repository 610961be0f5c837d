"""Pages to DOM nodes.

``parse_pages`` keeps one row per page and puts the elements into an array of structs in
document order. Page-local work (XPath, sections, extraction, layout) runs on that array
inside the row, so it needs no shuffle at any scale. Work across pages explodes the array
with ``page_nodes`` and aggregates with map-side partials.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domloom.functions.columns import sql_let
from domloom.functions.html_scan import PageScan

NODE_FIELDS: dict[str, str] = {
    "nid": "int",  # 1-based document order; also the position in the array
    "parent_nid": "int",  # 0 for the root
    "last_nid": "int",  # last element of the subtree, so descendants are nid < d <= last_nid
    "depth": "int",
    "tag": "string",
    "idx": "int",  # position among same-tag siblings
    "n_same": "int",  # how many same-tag siblings there are
    "alike": "int",  # position among siblings with the same tag and class
    "n_alike": "int",
    "attrs": "map<string,string>",
    "cls": "array<string>",
    "id": "string",
    "text_head": "string",  # text before the first child
    "own_texts": "array<string>",  # runs of text directly inside the element
    "run_start": "int",  # slice of the page's text runs that lies inside the element
    "run_end": "int",
    "html_start": "int",  # code point offsets of the outer HTML
    "html_end": "int",
}
# Fields that a path is put together from, see ``path_sql``.
PATH_FIELDS = ("nid", "parent_nid", "depth", "tag", "idx", "n_same")
# What rows of elements can have besides.
ROW_FIELDS: dict[str, str] = {
    **NODE_FIELDS,
    "gpath": "string",  # index-free path, e.g. html/body/article/p
    "gseq": "int",  # how often gpath has occurred in the page so far
    "xpath": "string",  # absolute path, index only where same-tag siblings exist
}
# What the XPath matcher reads.
MATCH_FIELDS = ("nid", "parent_nid", "last_nid", "tag", "idx", "n_same", "attrs", "cls", "id")

_ARROW = {
    "int": pa.int32(),
    "string": pa.string(),
    "array<string>": pa.list_(pa.field("element", pa.string())),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}
# Output batches are cut at about this many source characters. Elements take many times the memory
# of their source while a batch is filled, in each Python worker of an executor.
BATCH_CHARS = 1024 * 1024

NO_CONTENT = "No HTML content available"


def pages_schema(fields: Sequence[str]) -> str:
    members = ", ".join(f"{f}: {NODE_FIELDS[f]}" for f in fields)
    return f"page_id bigint, error string, nodes array<struct<{members}>>, runs array<string>"


def _offsets(lengths: Iterable[int]) -> list[int]:
    out, total = [0], 0
    for n in lengths:
        total += n
        out.append(total)
    return out


def _node_values(scan: PageScan, fields: Sequence[str]) -> Iterator[tuple[str, Iterable]]:
    """The requested columns of one page's elements."""
    wanted = set(fields)
    derived: dict[str, Iterable] = {
        "nid": range(1, len(scan.tag) + 1),
        "parent_nid": scan.parent,
        "last_nid": scan.last,
    }
    if wanted & {"idx", "n_same"}:
        derived["idx"], derived["n_same"] = scan.same_tag()
    if wanted & {"alike", "n_alike"}:
        derived["alike"], derived["n_alike"] = scan.same_tag_and_class()
    if "depth" in wanted:
        derived["depth"] = scan.depths()
    if "cls" in wanted:
        derived["cls"] = [a["class"].split() if "class" in a else [] for a in scan.attrs]
    if "id" in wanted:
        derived["id"] = [a.get("id") for a in scan.attrs]
    if "gseq" in wanted:
        derived["gseq"] = PageScan.places(scan.path_numbers())[0]
    if "gpath" in wanted:
        derived["gpath"] = scan.gpaths()
    if "xpath" in wanted:
        derived["xpath"] = scan.xpaths()
    if "text_head" in wanted:
        derived["text_head"] = scan.text_heads()
    if "own_texts" in wanted:
        derived["own_texts"] = scan.own_texts()
    for field in fields:
        yield field, derived[field] if field in derived else getattr(scan, field)


class _Batch:
    """Columns of the output rows, filled page by page and turned into Arrow once."""

    def __init__(self, fields: Sequence[str]):
        self.fields = fields
        self.page_ids: list = []
        self.errors: list = []
        self.sizes: list[int | None] = []
        self.run_lists: list = []
        self.columns: dict[str, list] = {f: [] for f in fields}
        self.chars = 0

    def add(self, page_id, source: str | None) -> None:
        self.page_ids.append(page_id)
        scan, error = None, None
        if not source:
            error = NO_CONTENT
        else:
            self.chars += len(source)
            try:
                scan = PageScan(source)
                values = list(_node_values(scan, self.fields))
            except Exception as exc:  # one bad page must not fail the job
                scan, error = None, f"{type(exc).__name__}: {exc}"
        self.errors.append(error)
        if scan is None:
            self.sizes.append(None)
            self.run_lists.append(None)
            return
        self.sizes.append(len(scan.tag))
        self.run_lists.append(scan.runs)
        for field, column in values:
            self.columns[field].extend(column)

    def to_arrow(self, source: pa.RecordBatch, keep: Sequence[str]) -> pa.RecordBatch:
        arrays = []
        for field in self.fields:
            kind, values = NODE_FIELDS[field], self.columns[field]
            if kind == "map<string,string>":
                arrays.append(
                    pa.MapArray.from_arrays(
                        pa.array(_offsets(map(len, values)), pa.int32()),
                        pa.array([k for v in values for k in v], pa.string()),
                        pa.array([x for v in values for x in v.values()], pa.string()),
                    )
                )
            else:
                arrays.append(pa.array(values, _ARROW[kind]))
        struct = pa.StructArray.from_arrays(
            arrays, fields=[pa.field(f, a.type) for f, a in zip(self.fields, arrays)]
        )
        offsets = _offsets(n or 0 for n in self.sizes)
        starts = [None if n is None else o for n, o in zip(self.sizes, offsets)] + [offsets[-1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.page_ids, pa.int64()),
                pa.array(self.errors, pa.string()),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct),
                pa.array(self.run_lists, pa.list_(pa.field("element", pa.string()))),
                *[source.column(2 + i) for i in range(len(keep))],
            ],
            names=["page_id", "error", "nodes", "runs", *keep],
        )


def _parsed_batches(
    batches: Iterator[pa.RecordBatch], fields: Sequence[str], keep: Sequence[str] = ()
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, html = batch.column(0).to_pylist(), batch.column(1)
        start, out = 0, _Batch(fields)
        for k, page_id in enumerate(ids):
            out.add(page_id, html[k].as_py())
            if out.chars >= BATCH_CHARS or k + 1 == len(ids):
                yield out.to_arrow(batch.slice(start, k + 1 - start), keep)
                start, out = k + 1, _Batch(fields)


def parse_pages(
    pages: DataFrame, fields: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``(page_id, html)`` to ``(page_id, error, nodes, runs)``, one row per page.

    Columns named in ``keep`` travel along, which saves a join back on ``page_id``.

    Pass only the node ``fields`` the job reads: Spark cannot prune columns inside a
    Python operator, so they are pruned here. A page without content or one that cannot be
    parsed keeps its row, with ``error`` set and null ``nodes``. What a row holds is linear in
    its page: paths, which are not, are put together for the elements that need one
    (``path_sql``) or while rows of elements are written (``node_rows``).
    """
    wanted = tuple(NODE_FIELDS) if fields is None else tuple(f for f in NODE_FIELDS if f in set(fields))

    source = pages.select("page_id", "html", *keep)
    kept = tuple(keep)
    extra = "".join(f", `{c}` {source.schema[c].dataType.simpleString()}" for c in kept)
    return source.mapInArrow(lambda batches: _parsed_batches(batches, wanted, kept), pages_schema(wanted) + extra)


def path_sql(n: str, indexed: bool = True) -> str:
    """SQL for the path of the element ``n`` of ``nodes``, from ``PATH_FIELDS``: absolute, with an index
    where siblings have the same tag, or without any (``html/body/p``). It follows parent numbers."""
    index = "CASE WHEN p.n_same > 1 THEN concat('[', p.idx, ']') ELSE '' END" if indexed else "''"
    step = sql_let(
        "get(nodes, up.at - 1)", "p", f"struct(p.parent_nid AS at, concat('/', p.tag, {index}, up.path) AS path)")
    path = f"aggregate(sequence(1, {n}.depth), struct({n}.nid AS at, '' AS path), (up, k) -> {step}, up -> up.path)"
    return path if indexed else f"substring({path}, 2)"


def page_nodes(parsed: DataFrame, *fields: str) -> DataFrame:
    """One row per element of parsed pages: ``page_id`` and the node fields (all parsed ones by
    default), also ``xpath`` and ``gpath`` where ``PATH_FIELDS`` were parsed."""
    nodes = parsed.schema["nodes"].dataType.elementType.names
    paths = {"xpath": path_sql("n"), "gpath": path_sql("n", indexed=False)}
    members = ", ".join(f"{paths.get(f, f'n.{f}')} AS {f}" for f in fields or nodes)
    return parsed.selectExpr("page_id", f"inline(transform(nodes, n -> struct({members})))")


def node_rows(pages: DataFrame, *fields: str) -> DataFrame:
    """One row per element straight from ``(page_id, html)``: ``page_id`` and ``fields`` of ``ROW_FIELDS``.

    Paths are built while rows are written, a batch of bounded size at a time, so that memory is
    linear in the page however deep it nests. Pages that cannot be parsed have no rows.
    """
    schema = "page_id bigint, " + ", ".join(f"{f} {ROW_FIELDS[f]}" for f in fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * (len(fields) + 1)
            types = [pa.int64(), *(_ARROW[ROW_FIELDS[f]] for f in fields)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", *fields])

        for batch in batches:
            for page_id, source in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    scan = PageScan(source) if source else None
                except Exception:  # one bad page must not fail the job
                    scan = None
                if scan is None:
                    continue
                for row in zip(*(values for _, values in _node_values(scan, fields))):
                    held.append((page_id, *(list(v.items()) if isinstance(v, dict) else v for v in row)))
                    chars += 64 + sum(len(v) for v in row if isinstance(v, str))
                    if chars >= BATCH_CHARS:
                        yield flush()
                        held, chars = [], 0
        yield flush()

    return pages.select("page_id", "html").mapInArrow(rows, schema)


def page_runs(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "runs")


def node_text(node: Column, runs: Column | None = None) -> Column:
    """All text inside ``node``: its slice of the page's runs."""
    runs = F.col("runs") if runs is None else runs
    return F.array_join(
        F.slice(runs, node["run_start"] + 1, node["run_end"] - node["run_start"]), ""
    )


def node_text_sql(node: str, runs: str = "runs") -> str:
    return f"array_join(slice({runs}, {node}.run_start + 1, {node}.run_end - {node}.run_start), '')"


def node_schema(fields: Sequence[str] | None = None) -> T.StructType:
    return T.StructType.fromDDL(pages_schema(tuple(fields or NODE_FIELDS)))

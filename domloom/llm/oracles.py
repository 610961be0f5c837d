"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""

LINE_DEDUP = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
b AS (SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
m AS (SELECT k.doc_id, k.line, k.pos, b.bare IS NOT NULL AS gone FROM k LEFT JOIN b ON k.bare = b.bare)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""

MIXING = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM rows_ GROUP BY source),
-- the excess of capped sources is shared again until none is above its cap
shares AS (
  SELECT 0 AS step, source, source_size, weight, false AS capped,
    weight * (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE / sum(weight) OVER ()) AS share FROM sizes
  UNION ALL
  SELECT step + 1, source, source_size, weight, capped OR share >= 2.0::DOUBLE * source_size,
    CASE WHEN capped OR share >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size
    ELSE weight * ((1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
        - coalesce(sum(CASE WHEN capped OR share >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size END) OVER (), 0))
      / sum(CASE WHEN capped OR share >= 2.0::DOUBLE * source_size THEN 0 ELSE weight END) OVER ()) END
  FROM shares WHERE step <= (SELECT count(*) FROM sizes)),
targets AS (SELECT source, source_size, share AS target FROM shares WHERE step = (SELECT max(step) FROM shares)),
ranked AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, rate - floor(rate) AS chance,
    u * (1 - (rate - floor(rate))) / (u * (1 - (rate - floor(rate))) + (1 - u) * (rate - floor(rate))) AS q FROM ranked),
cum AS (
  SELECT *, CASE WHEN chance > 0 AND size > 0 THEN
    sum(CASE WHEN chance > 0 AND size > 0 THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id, size) END AS words,
    sum(CASE WHEN size > 0 THEN size * chance END) OVER (PARTITION BY source) AS due
  FROM odds),
gaps AS (SELECT *, max(CASE WHEN words <= due + 1e-6 THEN words ELSE 0 END) OVER (PARTITION BY source) AS last FROM cum),
closing AS (
  SELECT source, arg_min(doc_id, (abs((due - last) - size), q)) AS doc_id FROM gaps
  WHERE words > due + 1e-6 AND abs((due - last) - size) < due - last GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target,
  (g.size * (floor(g.rate)::BIGINT + CASE WHEN g.words <= g.due + 1e-6 OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM gaps g LEFT JOIN closing c ON g.doc_id = c.doc_id AND g.source IS NOT DISTINCT FROM c.source
"""


# 160 bits as 32 digits: five hex digits are four of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload, list_aggregate([substr('{_BASE32}', 1 + (
      (('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1) for i in range(32)],
    'string_agg', '') AS digest FROM p),
g AS (SELECT payload, max(page_id) AS original FROM p GROUP BY payload)
SELECT d.page_id, strlen(d.payload)::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN d.page_id = g.original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> g.original THEN g.original END AS refers_to
FROM d JOIN g ON d.payload = g.payload
"""


_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND {_FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

SOURCE_DIVERGENCE = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
t AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
w AS (
  SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total,
    sum(n) OVER (PARTITION BY lang, term)::HUGEINT AS lang_n, sum(n) OVER (PARTITION BY lang)::HUGEINT AS lang_total FROM t),
s AS (
  SELECT w.lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS p,
    1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) AS q FROM w JOIN v ON w.lang = v.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= 10
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT DISTINCT a AS id, a AS other FROM links
  UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
lowest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN lowest ON e.vec_id = lowest.id LEFT JOIN degree ON e.vec_id = degree.id
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": EXACT_DEDUP, "op3_warc": WARC, "op8_line_dedup": LINE_DEDUP, "op10_mixing": MIXING,
        "op11_hard_negatives": HARD_NEGATIVES, "op12_source_audit": SOURCE_DIVERGENCE, "op13_embedding_dedup": NEAR_VECTORS,
    }

"""DuckDB SQL for those queries of this subpackage that SQL can express at the size of the correctness check."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[k : k + size - 1], ' ') AS gram FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM s)),
p AS (SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM s))),
h AS (SELECT doc_id, item, k, p.size FROM p JOIN g ON p.size = g.size AND p.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS spot FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0 AND len(list_filter(embedding, lambda q: q <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

_RULES = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "100 * n_symbols > 20 * word_chars", "lines": "100 * n_dup_lines > 30 * n_lines", "letters": "word_chars < 2 * n_words"}


def _op12() -> str:
    """Windows counted by joins, and the beta prior of each rule in turn."""
    space = r"[^\x20\x09-\x0D]+"
    rates = [
        f"""SELECT source, '{r}' AS rule, CASE WHEN alike > 0 THEN (f + mean * w) / (n + w) ELSE mean END AS rate
        FROM (SELECT *, greatest(1 / alike - 1, 2) AS w FROM (SELECT *, (ss - nn * mean * mean - mean * (1 - mean) * (k - 1)) / nullif(greatest(mean * (1 - mean) * (nn - n2 / nn - (k - 1)), 0), 0) AS alike
        FROM (SELECT source, f_{r} AS f, n, count(*) OVER () AS k, sum(n) OVER () AS nn, sum(n * n) OVER () AS n2, sum(f_{r}) OVER () / sum(n) OVER () AS mean, sum(CAST(f_{r} AS DOUBLE) * f_{r} / n) OVER () AS ss FROM h)))"""
        for r in _RULES
    ]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, source, t, regexp_extract_all(t, '{space}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS l FROM d),
g AS (SELECT row, k, array_to_string(w[k : k + 4], ' ') AS gram FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
p AS (SELECT row, count(DISTINCT spot) AS n FROM (SELECT row, unnest(range(k, k + 5)) AS spot FROM (SELECT row, k, count(*) OVER (PARTITION BY row, gram) AS twice FROM g) WHERE twice > 1) GROUP BY row),
c AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p USING (row)),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({rule}) AS f_{r}" for r, rule in _RULES.items())} FROM c WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT DISTINCT source FROM ({" UNION ALL ".join(rates)}) WHERE rate >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND b.source IS NULL AS kept
FROM c LEFT JOIN b USING (source)
"""


def _op13(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Every distance of every round, in integers."""
    far = "list_sum(list_transform(range(1, {0} + 1), lambda i: CAST(v.x[i] - c.x[i] AS HUGEINT) * (v.x[i] - c.x[i])))".format(dim)
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda q: CAST(floor(256 * CAST(q AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS cluster, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {k})"""]
    for t in range(rounds + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := cluster)) AS n FROM (SELECT v.row, c.cluster, {far} AS d FROM v, c{t} c) GROUP BY row)""")
        if t < rounds:
            parts.append(f"""
s{t} AS MATERIALIZED (SELECT a.n.c AS cluster, i, sum(v.x[i]) AS s, count(*) AS m FROM a{t} a JOIN v USING (row), range(1, {dim} + 1) r(i) GROUP BY 1, 2),
c{t + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(g.x, c.x) AS x FROM c{t} c
  LEFT JOIN (SELECT cluster, list(CAST((s - ((s % m + m) % m)) // m AS BIGINT) ORDER BY i) AS x FROM s{t} GROUP BY 1) g USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (row) JOIN c{rounds} c ON c.cluster = n.c
"""


ORACLE: dict[str, str] = {"op6_decontamination": _OP6, "op8_embedding_dups": _OP8, "op9_ngram_jaccard": _OP9, "op12_quality": _op12(), "op13_clustering": _op13()}

"""SQL (DuckDB) for the operators whose rows SQL can express, by plain definition and not by method."""

from __future__ import annotations

import math

from gneiss.llm import licenses

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}')"

_COMPONENTS = """
reach AS (SELECT x AS node, x AS other FROM link UNION SELECT reach.node, link.y FROM reach JOIN link ON reach.other = link.x),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
degree AS (SELECT x AS node, count(*) AS links FROM link GROUP BY x)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM both JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)),
{_COMPONENTS}
SELECT doc_id, coalesce(component, doc_id) AS class_id, coalesce(links, 0) AS n_links, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN comp ON comp.node = doc_id LEFT JOIN degree ON degree.node = doc_id""".replace("both AS", "shared AS").replace("FROM both", "FROM shared")

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
{_COMPONENTS}
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.node = vec_id LEFT JOIN degree ON degree.node = vec_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS latest FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(h) >= 1000 AND page_id <> latest THEN latest END AS refers_to FROM q"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_sql() -> str:
    stride = max(len(licenses.split_words(text)) for _, text in licenses.TEMPLATES)
    starts, labels = [], []
    for phrase, label in licenses.PHRASES.items():
        parts = licenses.split_words(phrase)
        here = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(1, greatest(len(w) - {len(parts) - 2}, 1)), lambda i: {here})")
        labels.append(f"CASE WHEN len({starts[-1]}) > 0 THEN ['{label}'] ELSE [] END")
    sets = [(label, list(dict.fromkeys(licenses.split_words(text)))) for label, text in licenses.TEMPLATES]
    templates = []
    for t, (label, words) in enumerate(sets):
        need = math.ceil(0.8 * len(words) - 1e-9)
        marks = [w for w in licenses.split_words(label) if w in words]
        variants = [o for o, (_, other) in enumerate(sets) if o != t and len(set(words) & set(other)) >= need]
        templates.append(f"({t}, '{label}', {_list(words)}, {len(words)}, {need}, CAST({_list(marks)} AS VARCHAR[]), CAST({variants} AS INT[]))")
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
base AS (SELECT doc_id, w, {" || ".join(f"CAST({s} AS BIGINT[])" for s in starts)} AS places, {" || ".join(f"CAST({x} AS VARCHAR[])" for x in labels)} AS b FROM d),
t(t, label, tokens, n, need, marks, variants) AS (VALUES {", ".join(templates)}),
block AS (SELECT doc_id, s, list_distinct(w[s + 1:s + {2 * stride}]) AS words FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {stride})) AS s FROM d) x),
hit AS (SELECT doc_id, s, t, label, len(list_intersect(words, tokens)) AS overlap, n, need, variants, len(list_intersect(words, marks)) = len(marks) AS marked FROM block, t),
met AS (SELECT *, overlap / n AS share FROM hit WHERE overlap >= need AND marked),
told AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.doc_id = m.doc_id AND o.s = m.s AND list_contains(m.variants, o.t) AND (o.share > m.share OR (o.share = m.share AND o.overlap > m.overlap)))),
found AS (SELECT doc_id, list(label) AS m, max(share) AS top FROM told GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
array_to_string(list_sort(list_distinct(b || coalesce(m, CAST([] AS VARCHAR[])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(top, 0.0::DOUBLE) END AS score
FROM base LEFT JOIN found USING (doc_id)"""

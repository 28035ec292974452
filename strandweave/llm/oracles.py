"""DuckDB SQL of the operators that plain SQL can express on small tables."""

from __future__ import annotations

from . import quality

_SPANS = """s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hit),
    r AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
    spans AS (SELECT doc_id, run, min(i) AS a, max(i) + {n} AS b FROM r GROUP BY 1, 2),
    cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY 1)"""

SUFFIX = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
    m AS (SELECT k, min(doc_id) AS low FROM x GROUP BY k),
    hit AS (SELECT doc_id, i FROM x JOIN m USING (k) WHERE low < doc_id), {_SPANS.format(n=50)}
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1),
        lambda j: substr(h, 2 * coalesce(ends[j], 0) + 1, 2 * (coalesce(starts[j + 1], length(h) // 2) - coalesce(ends[j], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
    m AS (SELECT k, min(doc_id) AS low FROM x GROUP BY k),
    hit AS (SELECT doc_id, i FROM x JOIN m USING (k) WHERE low < doc_id), {_SPANS.format(n=13)}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN n_spans IS NULL THEN w ELSE flatten(list_transform(range(0, n_spans + 1),
        lambda j: w[coalesce(ends[j], 0) + 1:coalesce(starts[j + 1], len(w))])) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_CLASSES = """reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
    low AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
    n AS (SELECT a AS x, count(*) AS n FROM links GROUP BY a)
SELECT {id}, coalesce(n, 0) AS n_links, coalesce(c, {id}) AS component_id, {id} = coalesce(c, {id}) AS kept
FROM {table} LEFT JOIN n ON n.x = {id} LEFT JOIN low ON low.x = {id}"""

NGRAM = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN size u ON u.doc_id = a JOIN size v ON v.doc_id = b WHERE 10 * k >= 8 * (u.n + v.n - k)),
    {_CLASSES.format(id="doc_id", table="documents")}
"""

EMBEDDING = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
    u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE list_inner_product(v, v) > 0),
    links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_inner_product(p.v, q.v) / (p.n * q.n) >= 0.98),
    {_CLASSES.format(id="vec_id", table="embeddings")}
"""

SQL = {
    "op1_suffix_dedup": SUFFIX,
    "op2_ngram_join": NGRAM,
    "op4_quality_rules": quality.SQL,
    "op5_embedding_join": EMBEDDING,
    "op8_substring_dedup": SUBSTRING,
}

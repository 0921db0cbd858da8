"""Queries of the corpus operators for the driver."""

from __future__ import annotations

from . import bpe, fingerprint, html, langid, packing, pii, quality, simhash, substring, topk

QUERIES = {
    "op1_fingerprint": fingerprint.op1,
    "op2_substring_dedup": substring.op2,
    "op3_pii": pii.op3,
    "op4_packing": packing.op4,
    "op5_simhash": simhash.op5,
    "op6_quality": quality.op6,
    "op7_langid": langid.op7,
    "op8_bpe": bpe.op8,
    "op9_html": html.op9,
    "op10_topk": topk.op10,
}

ORACLE_SQL = {
    # all windows as strings; words under a window that starts twice or more
    "op2_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), twice AS (
  SELECT k FROM win GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT rid, i + j AS pos FROM win JOIN twice USING (k) CROSS JOIN range(35) r(j)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) ANTI JOIN gone USING (rid, pos) GROUP BY rid
), n AS (
  SELECT rid, count(*) AS n FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
""",
    # blocks of integer inner products; ties to the smaller id
    "op10_topk": """
WITH flat AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id query_id, c.vec_id vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) score
  FROM flat q JOIN flat c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
""",
}

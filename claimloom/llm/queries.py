"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import band_join, fingerprints, hard_negatives, html_extract, language_id, license_scan, mixing, near_dedup, secret_scan, token_files, tokens, vector_search, warc_zst

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_secret_scan": secret_scan.op3,
    "op4_license_scan": license_scan.op4,
    "op5_source_mix": mixing.op5,
    "op6_token_files": token_files.op6,
    "op7_html_extract": html_extract.op7,
    "op8_bpe_round_trip": tokens.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_vector_search": vector_search.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_warc_zst": warc_zst.op12,
    "op13_band_join": band_join.op13,
}

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS k FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS top FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.top = e.a
), c AS (
  SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL = {"op2_near_dedup": OP2_SQL, "op5_source_mix": mixing.OP5_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_warc_zst": warc_zst.OP12_SQL, "op13_band_join": band_join.OP13_SQL}

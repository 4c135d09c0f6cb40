"""The registered queries of this subpackage and the SQL that DuckDB can run for some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blocks, bpe, identifiers, lines, ngramjoin, paragraphs, ranking, rules, warczip, winnowing

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINNOWING_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w FROM benchmark),
spans AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, spans WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_blocks": blocks.op1,
        "op2_warc_zip": warczip.op2,
        "op3_rules": rules.op3,
        "op4_winnowing": winnowing.op4,
        "op5_bpe": bpe.op5,
        "op6_lines": lines.op6,
        "op7_ranking": ranking.op7,
        "op8_paragraphs": paragraphs.op8,
        "op9_ngram_join": ngramjoin.op9,
        "op10_identifiers": identifiers.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_winnowing": WINNOWING_SQL}

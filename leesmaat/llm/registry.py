"""Queries of this package, and SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leesmaat.llm import abuse, encode, leak, overlap, pairs, pii, reading, sentences, truncation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": pii.p1_found,
        "p1_masked": pii.p1_masked,
        "p2_found": pairs.p2_found,
        "p2_report": pairs.p2_report,
        "p3_found": reading.p3_found,
        "p4_found": overlap.p4_found,
        "p4_report": overlap.p4_report,
        "p5_found": truncation.p5_found,
        "p5_limits": truncation.p5_limits,
        "p5_report": truncation.p5_report,
        "p5_signals": truncation.p5_signals,
        "p6_found": sentences.p6_found,
        "p7_ids": encode.p7_ids,
        "p8_found": leak.p8_found,
        "p8_paraphrases": leak.p8_paraphrases,
        "p8_report": leak.p8_report,
        "p9_found": abuse.p9_found,
        "p9_scores": abuse.p9_scores,
        "p9_report": abuse.p9_report,
    }


# Runs of twelve words by plain joins of all of them: too much for a corpus, but a check of the retrieval on small tables.
LEAKS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM heldout_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest([array_to_string(w[k:k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS gram FROM d WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest([array_to_string(w[k:k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS gram FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": LEAKS,
        "p8_report": f"SELECT h.item_id, h.suite, h.split, count(l.doc_id) AS documents FROM heldout_items h LEFT JOIN ({LEAKS}) l USING (item_id) GROUP BY 1, 2, 3",
    }

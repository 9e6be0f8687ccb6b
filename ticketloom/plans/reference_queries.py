"""Queries over references between records, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.operators.references import orphan_references, orphan_report
from ticketloom.storage import table

FIELDS = ["linked_issue_ids", "duplicate_issue_ids"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(table(spark, sf_dir, "tawos_issue_search_document"), table(spark, sf_dir, "deleted_issue"), FIELDS)


def p2_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deleted = table(spark, sf_dir, "tawos_issue_search_document"), table(spark, sf_dir, "deleted_issue")
    return orphan_report(orphan_references(rows, deleted, FIELDS, keep_sound=True))


_REFS = r"""
WITH tokens AS (
  SELECT issue_id, 'linked_issue_ids' AS field_name, unnest(string_split(linked_issue_ids, '||')) AS token, loaded_at FROM tawos_issue_search_document
  UNION ALL
  SELECT issue_id, 'duplicate_issue_ids', unnest(string_split(duplicate_issue_ids, '||')), loaded_at FROM tawos_issue_search_document),
refs AS (
  SELECT DISTINCT issue_id, field_name, try_cast(regexp_extract(token, '([0-9]+)[\s\p{Z}]*$', 1) AS BIGINT) AS target_issue_id,
         date_trunc('month', loaded_at) AS month FROM tokens),
first AS (SELECT issue_id, min(loaded_at) AS first_loaded FROM tawos_issue_search_document GROUP BY 1),
gone AS (SELECT issue_id, min(deleted_at) AS gone_at FROM deleted_issue GROUP BY 1),
judged AS (
  SELECT r.issue_id, r.field_name, r.target_issue_id, strftime(r.month, '%Y-%m') AS period,
         coalesce(NOT (f.first_loaded < r.month + INTERVAL 1 MONTH), true) OR coalesce(g.gone_at < r.month + INTERVAL 1 MONTH, false) AS is_orphan
  FROM refs r LEFT JOIN first f ON f.issue_id = r.target_issue_id LEFT JOIN gone g ON g.issue_id = r.target_issue_id
  WHERE r.target_issue_id IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_orphan_report": p2_orphan_report}
SQL = {
    "p2_found": _REFS + "SELECT issue_id, field_name, target_issue_id, period FROM judged WHERE is_orphan",
    "p2_orphan_report": _REFS + """SELECT field_name, period, count(*) AS n_references, count_if(is_orphan)::BIGINT AS n_orphans,
        count(DISTINCT CASE WHEN is_orphan THEN target_issue_id END) AS n_missing_targets FROM judged GROUP BY 1, 2""",
}

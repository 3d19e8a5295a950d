"""Queries on orphan references."""

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.integrity import FOUND, narrative_orphans, orphan_report
from loomgraph.plans.registry import query
from loomgraph.session import read_table

_SQL = """
WITH ent AS (SELECT lower(trim(id)) k, min(created_at) first_at FROM entities WHERE trim(id) <> '' GROUP BY 1),
doc AS (SELECT lower(trim(id)) k, min(created_at) first_at FROM source_docs WHERE trim(id) <> '' GROUP BY 1),
known AS (SELECT 'entities' target, k, first_at FROM ent UNION ALL SELECT 'source_docs', k, first_at FROM doc),
refs AS (
  SELECT 'relations' table_name, id row_key, lower(trim(id)) record_key, 'subject_id' field_name, 'entities' target, lower(trim(subject_id)) ref_key, created_at FROM relations
  UNION ALL SELECT 'relations', id, lower(trim(id)), 'object_id', 'entities', lower(trim(object_id)), created_at FROM relations
  UNION ALL SELECT 'entities', CAST(record_id AS VARCHAR), lower(trim(id)), 'source_documents', 'source_docs', lower(trim(u.ref)), created_at
    FROM entities, unnest(source_documents) AS u(ref)),
gone AS (SELECT DISTINCT table_name target, lower(trim(removed_id)) k, removed_at, restored_at FROM removals),
marked AS (
  SELECT r.*, CASE WHEN n.k IS NULL THEN 'missing' WHEN n.first_at > r.created_at THEN 'late'
    WHEN EXISTS (SELECT 1 FROM gone g WHERE g.target = r.target AND g.k = r.ref_key AND g.removed_at <= r.created_at
                 AND (g.restored_at IS NULL OR g.restored_at > r.created_at)) THEN 'deleted' END reason
  FROM refs r LEFT JOIN known n ON n.target = r.target AND n.k = r.ref_key WHERE r.ref_key <> ''),
direct AS (SELECT DISTINCT table_name, row_key, record_key, field_name, target, ref_key, reason, strftime(created_at, '%Y-%m') period FROM marked WHERE reason IS NOT NULL),
heirs AS (
  SELECT DISTINCT r.table_name, r.row_key, r.field_name, r.ref_key, 'orphaned_parent' reason, strftime(r.created_at, '%Y-%m') period
  FROM refs r WHERE r.target = 'entities' AND r.ref_key IN (SELECT record_key FROM direct WHERE table_name = 'entities')
  AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.table_name = r.table_name AND d.row_key = r.row_key AND d.field_name = r.field_name AND d.ref_key = r.ref_key)),
everything AS (
  SELECT table_name, row_key, field_name, ref_key, reason, period, 'direct' kind, 0 depth FROM direct
  UNION ALL SELECT *, 'inherited', 1 FROM heirs)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read_table(spark, sf_dir, t) for t in ("relations", "entities", "source_docs")}
    return narrative_orphans(tables, read_table(spark, sf_dir, "removals"))


@query("p3_found", _SQL + "SELECT table_name, row_key, field_name, ref_key, reason, period FROM everything WHERE kind = 'direct'")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).where("kind = 'direct'").select(*FOUND)


@query("p3_cascade", _SQL + "SELECT * FROM everything")
def p3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


@query("p3_report", _SQL + "SELECT table_name, period, reason, kind, count(*) orphans, count(DISTINCT ref_key) keys FROM everything GROUP BY ALL")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))

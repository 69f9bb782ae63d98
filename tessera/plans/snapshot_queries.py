"""Queries over the snapshot manifests (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshots import snapshot_changes
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshot_manifests"))


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
WITH m AS (
  SELECT publish_dir, generation, files FROM snapshot_manifests
  WHERE files IS NOT NULL AND generation IS NOT NULL),
g AS (
  SELECT publish_dir, generation, lag(generation) OVER (PARTITION BY publish_dir ORDER BY generation) AS before
  FROM (SELECT DISTINCT publish_dir, generation FROM m)),
e AS (
  SELECT publish_dir, generation, f.path AS path, min(lower(f.blake3)) AS mark
  FROM (SELECT publish_dir, generation, unnest(files) AS f FROM m)
  WHERE f.path IS NOT NULL GROUP BY ALL),
n AS (SELECT g.publish_dir, g.generation, e.path, e.mark FROM g JOIN e
      ON g.publish_dir IS NOT DISTINCT FROM e.publish_dir AND g.generation = e.generation WHERE g.before IS NOT NULL),
o AS (SELECT g.publish_dir, g.generation, e.path, e.mark FROM g JOIN e
      ON g.publish_dir IS NOT DISTINCT FROM e.publish_dir AND g.before = e.generation)
SELECT coalesce(n.publish_dir, o.publish_dir) AS publish_dir, coalesce(n.generation, o.generation) AS generation,
       coalesce(n.path, o.path) AS path,
       CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.publish_dir IS NOT DISTINCT FROM o.publish_dir AND n.generation = o.generation AND n.path = o.path
WHERE n.path IS NULL OR o.path IS NULL OR n.mark IS DISTINCT FROM o.mark""",
}

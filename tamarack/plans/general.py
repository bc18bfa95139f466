"""Queries of the general problems 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as h
from ..operators import orphans as o
from ..session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return h.rings(table(spark, sf, "categories")).select(F.col("id").alias("category_id"), "loop_id")


def p2_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    out = h.hierarchy(table(spark, sf, "categories"))
    return out.select(F.col("id").alias("category_id"), "parent_id", F.col("depth").cast("long").alias("depth"), "root_id", "path", "n_descendants", "in_ring", "loop_id")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return h.ancestor_pairs(table(spark, sf, "categories")).select("ancestor_id", "descendant_id", F.col("distance").cast("long").alias("distance"))


def _refs(spark: SparkSession, sf: str):
    return o.project_references(*(table(spark, sf, t) for t in ("comments", "pending_painpoints", "posts", "categories")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return o.find_orphans(*_refs(spark, sf)).select("tab", "field", "row_id").distinct()


def p4_by_period(spark: SparkSession, sf: str) -> DataFrame:
    refs, parents = _refs(spark, sf)
    return o.orphans_by_period(o.find_orphans(refs, parents), refs)


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_by_period": p4_by_period}

_TREE = """links AS (SELECT id, parent_id AS parent, coalesce(nullif(trim(name), ''), CAST(id AS VARCHAR)) AS label FROM categories),
tree AS (
  SELECT id, 1 AS depth, id AS root_id, label AS path, [id] AS ids FROM links WHERE parent IS NULL OR parent NOT IN (SELECT id FROM links)
  UNION ALL
  SELECT l.id, t.depth + 1, t.root_id, t.path || ' > ' || l.label, list_append(t.ids, l.id) FROM links l JOIN tree t ON l.parent = t.id),
stuck AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM tree)),
walk AS (SELECT id AS start, id AS at FROM stuck UNION SELECT w.start, s.parent FROM walk w JOIN stuck s ON s.id = w.at),
onring AS (SELECT DISTINCT w.start AS id FROM (SELECT s.id AS start, s.parent AS at FROM stuck s) f JOIN walk w ON w.start = f.at AND w.at = f.start),
ring AS (SELECT w.start AS id, min(w.at) AS loop_id FROM walk w JOIN onring r ON r.id = w.at GROUP BY 1)"""

_REFS = """refs AS (
  SELECT 'comments' AS tab, 'post_id' AS field, id AS row_id, post_id AS ref, strftime(fetched_at, '%Y-%m') AS period, post_id NOT IN (SELECT id FROM posts) AS bad FROM comments WHERE post_id IS NOT NULL
  UNION SELECT 'pending_painpoints', 'comment_id', id, comment_id, strftime(extracted_at, '%Y-%m'), comment_id NOT IN (SELECT id FROM comments) FROM pending_painpoints WHERE comment_id IS NOT NULL
  UNION SELECT 'pending_painpoints', 'category_id', id, category_id, strftime(extracted_at, '%Y-%m'), category_id NOT IN (SELECT id FROM categories) FROM pending_painpoints WHERE category_id IS NOT NULL)"""

ORACLE = {
    "p2_found": f"WITH RECURSIVE {_TREE} SELECT id AS category_id, loop_id FROM ring",
    "p2_hierarchy": f"""WITH RECURSIVE {_TREE},
below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(ids[:-2]) AS a FROM tree) GROUP BY 1)
SELECT l.id AS category_id, l.parent AS parent_id, CAST(t.depth AS BIGINT) AS depth, t.root_id, t.path, CASE WHEN t.depth IS NOT NULL THEN coalesce(b.n, 0) END AS n_descendants,
r.loop_id IS NOT NULL AS in_ring, r.loop_id FROM links l LEFT JOIN tree t ON t.id = l.id LEFT JOIN below b ON b.id = l.id LEFT JOIN ring r ON r.id = l.id""",
    "p2_descendants": f"""WITH RECURSIVE {_TREE},
pairs AS (SELECT id, depth, unnest(ids) AS a, unnest(range(1, len(ids) + 1)) AS pos FROM tree)
SELECT a AS ancestor_id, id AS descendant_id, CAST(depth - pos AS BIGINT) AS distance FROM pairs WHERE pos < depth""",
    "p4_found": f"WITH {_REFS} SELECT DISTINCT tab, field, row_id FROM refs WHERE bad",
    "p4_by_period": f"""WITH {_REFS} SELECT tab, field, period, count(*) AS refs, count(*) FILTER (bad) AS orphans, count(DISTINCT ref) FILTER (bad) AS missing_keys FROM refs GROUP BY 1, 2, 3""",
}

"""The queries of the core: name -> (query(spark, sf_dir), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import hierarchy, orphans
from kinweave.plans.workspace import table

Query = Callable[[SparkSession, str], DataFrame]


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.parent_links(table(spark, d, "families"), table(spark, d, "vital_events"), table(spark, d, "persons"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.lines_of_descent(spark, _links(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("person_id", "root_id")


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line as one text, from the person up to the founder."""
    return hierarchy.lines_with_paths(spark, _links(spark, d)).withColumn("path", F.array_join("path", ">"))


def p1_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_descendants(spark, _links(spark, d))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_lines(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    targets = {n: table(spark, d, n) for n in ("places", "sources", "persons", "families", "vital_events")}
    refs = orphans.references(targets["persons"], table(spark, d, "occupations"), table(spark, d, "links"))
    return orphans.faulty_references(refs, orphans.parent_keys(targets))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("table_name", "field_name", "reason", "period").count().withColumnRenamed("count", "n_references")


_LINKS = """
links AS (
  SELECT DISTINCT child, parent FROM (
    SELECT unnest(kids) AS child, parent FROM (
      SELECT list_transform(children, lambda x: x.person_id) AS kids, unnest(list_transform(union_block.persons, lambda x: x.person_id)) AS parent
      FROM families)
    UNION ALL
    SELECT p.id, a.entity_id FROM persons p
    JOIN (SELECT id, unnest(participants, recursive := true) FROM vital_events) a(event, entity_type, entity_id, role) ON a.event = p.birth.event_id
    WHERE a.role IN ('father', 'mother', 'parent'))
  WHERE child <> '' AND parent <> ''),
founders AS (SELECT parent AS root FROM links EXCEPT SELECT child FROM links),
down(person, root) AS (
  SELECT l.child, l.parent FROM links l SEMI JOIN founders f ON f.root = l.parent
  UNION
  SELECT l.child, d.root FROM down d JOIN links l ON l.parent = d.person),
up(person, ancestor) AS (
  SELECT child, parent FROM links UNION SELECT u.person, l.parent FROM up u JOIN links l ON l.child = u.ancestor)
"""

_P1 = f"""WITH RECURSIVE {_LINKS}
SELECT person AS person_id, root AS root_id FROM down
UNION ALL SELECT person, 'CYCLE' FROM up WHERE person = ancestor"""

_P6 = """
WITH refs AS (
  SELECT table_name, record_id, field_name, target_table, lower(regexp_replace(target, '^\\s+|\\s+$', '', 'g')) AS target_id, min(asked) AS asked FROM (
    SELECT 'persons' AS table_name, id AS record_id, 'birth.place_id' AS field_name, 'places' AS target_table, birth.place_id AS target, ingested_at AS asked FROM persons
    UNION ALL SELECT 'persons', id, 'birth.source_id', 'sources', birth.source_id, ingested_at FROM persons
    UNION ALL SELECT 'persons', id, 'death.place_id', 'places', death.place_id, ingested_at FROM persons
    UNION ALL SELECT 'persons', id, 'death.source_id', 'sources', death.source_id, ingested_at FROM persons
    UNION ALL SELECT 'occupations', id, 'person_id', 'persons', person_id, ingested_at FROM occupations
    UNION ALL SELECT 'links', id, 'from_end.entity_id', CASE from_end.entity_type WHEN 'person' THEN 'persons' WHEN 'family' THEN 'families' WHEN 'event' THEN 'vital_events' END, from_end.entity_id, ingested_at FROM links
    UNION ALL SELECT 'links', id, 'to_end.entity_id', CASE to_end.entity_type WHEN 'person' THEN 'persons' WHEN 'family' THEN 'families' WHEN 'event' THEN 'vital_events' END, to_end.entity_id, ingested_at FROM links)
  WHERE regexp_full_match(target, '(?s).*\\S.*') AND target_table IS NOT NULL GROUP BY ALL),
targets AS (
  SELECT target_table, lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS target_id, bool_or(alive) AS alive, min(ingested_at) AS born FROM (
    SELECT 'places' AS target_table, id, deleted_at IS NULL AS alive, ingested_at FROM places
    UNION ALL SELECT 'sources', id, deleted_at IS NULL, ingested_at FROM sources
    UNION ALL SELECT 'persons', id, deleted_at IS NULL, ingested_at FROM persons
    UNION ALL SELECT 'families', id, true, ingested_at FROM families
    UNION ALL SELECT 'vital_events', id, true, ingested_at FROM vital_events) GROUP BY ALL)
SELECT table_name, record_id, field_name, target_id,
  CASE WHEN t.target_id IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted' ELSE 'late' END AS reason,
  strftime(asked, '%Y-%m') AS period
FROM refs r LEFT JOIN targets t USING (target_table, target_id)
WHERE t.target_id IS NULL OR NOT alive OR born > asked"""

# distances over links between different persons; no shortest line is longer than there are persons
_BOUND = "bound AS (SELECT count(DISTINCT child) + 1 AS most FROM links)"
_DEPTH = f"""{_LINKS}, {_BOUND},
depth(person, root, steps) AS (SELECT l.child, l.parent, 1 FROM links l SEMI JOIN founders f ON f.root = l.parent UNION SELECT l.child, d.root, d.steps + 1 FROM depth d JOIN links l ON l.parent = d.person CROSS JOIN bound b WHERE d.steps < b.most),
dist AS (SELECT person, root, min(steps) AS steps FROM depth GROUP BY ALL)"""
_PATHS = f"""WITH RECURSIVE {_DEPTH},
onward AS (SELECT d.person, d.root, min(l.parent) AS nxt FROM dist d JOIN links l ON l.child = d.person AND l.parent <> d.person LEFT JOIN dist u ON u.person = l.parent AND u.root = d.root
  WHERE (d.steps = 1 AND l.parent = d.root) OR u.steps = d.steps - 1 GROUP BY ALL),
walk(person, root, nxt, path) AS (SELECT person, root, nxt, [person] FROM onward UNION ALL SELECT w.person, w.root, n.nxt, list_append(w.path, w.nxt) FROM walk w JOIN onward n ON n.person = w.nxt AND n.root = w.root WHERE w.nxt <> w.root)
SELECT person AS person_id, root AS root_id, CAST(len(path) AS INTEGER) AS steps, array_to_string(list_append(path, root), '>') AS path FROM walk WHERE nxt = root
UNION ALL SELECT person, 'CYCLE', NULL, NULL FROM up WHERE person = ancestor"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "p1_found": (p1_found, _P1),
    "p1_lines": (p1_lines, _PATHS),
    "p1_descendants": (p1_descendants, f"WITH RECURSIVE {_DEPTH} SELECT root AS root_id, count(*) AS n_descendants, max(steps) AS max_steps FROM dist GROUP BY ALL"),
    "p1_all_descendants": (p1_all_descendants, f"WITH RECURSIVE {_LINKS}, {_BOUND}, far(person, ancestor, steps) AS (SELECT child, parent, 1 FROM links UNION SELECT f.person, l.parent, f.steps + 1 FROM far f JOIN links l ON l.child = f.ancestor CROSS JOIN bound b WHERE f.steps < b.most) SELECT ancestor AS ancestor_id, person AS person_id, min(steps) AS steps FROM far GROUP BY ALL"),
    "p6_found": (p6_found, _P6),
    "p6_report": (p6_report, f"SELECT table_name, field_name, reason, period, count(*) AS n_references FROM ({_P6}) GROUP BY ALL"),
}

"""The queries of the bundle operators over the family-tree tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import dates, names
from kinweave.operators import bundle, crud, dedup, gedcom, hierarchy, refs, typed, validate
from kinweave.operators.bundle import COLLECTIONS, Bundles
from kinweave.plans.workspace import Workspace, table
from kinweave.sources import bundles as files
from kinweave.sources.tables import entities_from_tables
from kinweave.streaming import ingest


def _entities(spark: SparkSession, d: str, *collections: str) -> DataFrame:
    out = entities_from_tables(spark, d)
    return out.where(F.col("collection").isin(*collections)) if collections else out


def _bundles(spark: SparkSession, d: str, entities: DataFrame | None = None) -> Bundles:
    entities = entities if entities is not None else entities_from_tables(spark, d)
    manifest = F.lit('{"axgf":"1.0","created_at":"2026-01-01","updated_at":"2026-01-01","stats":{"persons":0}}')
    return Bundles(entities, entities.select("bundle_id").distinct().select("bundle_id", manifest.alias("body")))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """All entities as a written table, for operators whose plans read them many times."""
    return Workspace(spark, "bundles").cut(_entities(spark, d))


def inspect_stats(spark: SparkSession, d: str) -> DataFrame:
    return bundle.inspect(_bundles(spark, d)).drop("manifest")


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    return refs.dangling(_entities(spark, d)).select("bundle_id", "collection", "id", "key", "target")


def referrers_of_places(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    held = refs.referrers(e, e.where("collection = 'places'"))
    return held.groupBy("bundle_id", "target").agg(F.count("*").alias("n_referrers"))


def chronology_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d, "persons", "families")
    return validate.chronology(typed.families(e), typed.people(e))


def _copied(c):
    """The id of the copy of a person or family; about half have one."""
    return F.when(F.substring(c, -1, 1) < "8", F.concat(F.substring(c, 1, 35), F.lit("x")))


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    """All entities, and a copy of about half of the persons and families under new ids in the same bundle, so that
    there is something to merge: a copied family names the copies of its children; a quarter of all families come
    back as another kind of union."""

    def families(rows: DataFrame) -> DataFrame:
        kid = lambda x: x.withField("person_id", F.coalesce(_copied(x["person_id"]), x["person_id"]))
        other = F.when(F.substring("id", -1, 1) < "4", F.col("union_block").withField("kind", F.lit("other"))).otherwise(F.col("union_block"))
        again = rows.where(_copied(F.col("id")).isNotNull()).withColumns({"union_block": other, "children": F.transform("children", kid), "id": _copied(F.col("id"))})
        return rows.unionByName(again)

    def persons(rows: DataFrame) -> DataFrame:
        return rows.unionByName(rows.where(_copied(F.col("id")).isNotNull()).withColumn("id", _copied(F.col("id"))))

    return Workspace(spark, "doubled").cut(entities_from_tables(spark, d, {"families": families, "persons": persons}))


def duplicate_spouse_sets(spark: SparkSession, d: str) -> DataFrame:
    found = validate.repeated_couples(typed.families(_doubled(spark, d)))
    return found.select("bundle_id", F.array_join("parent_set", ",").alias("parents"), F.array_join("family_ids", ",").alias("families"))


def self_parent(spark: SparkSession, d: str) -> DataFrame:
    return validate.self_parents(typed.families(_entities(spark, d, "families")))


def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.concat_ws(" ", "bundle_id", c).alias(c)
    links = typed.edges(typed.families(_entities(spark, d, "families"))).select(key("child"), key("parent"))
    found = hierarchy.lines_of_descent(spark, links).where(F.col("root_id") == hierarchy.CYCLE)
    return found.select(F.split("person_id", " ")[0].alias("bundle_id"), F.split("person_id", " ")[1].alias("person_id"))


def loop_edges(spark: SparkSession, d: str) -> DataFrame:
    return validate.loop_edges(typed.families(_entities(spark, d, "families")))


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    found = validate.structural(_entities(spark, d))
    return found.groupBy("collection", F.regexp_replace("path", "/[0-9]+", "/*").alias("path"), "problem").agg(F.count("*").alias("n"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return bundle.severity_counts(validate.validate(_bundles(spark, d, _written(spark, d))))


def diagnostics_by_code(spark: SparkSession, d: str) -> DataFrame:
    return bundle.diagnostics_by_code(validate.validate(_bundles(spark, d, _written(spark, d)))).select("code", "n")


def diagnostics_without_structure_and_loops(spark: SparkSession, d: str) -> DataFrame:
    """The part of the diagnostics that SQL can say: none of structure, of loops only persons who are their own parent."""
    found = validate.validate(_bundles(spark, d, _written(spark, d))).where("code <> 'SCHEMA_VALIDATION_FAILED' and seq not like '1 %'")
    return found.groupBy("bundle_id", "code", "severity").agg(F.count("*").alias("n"))


def person_dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = dedup.person_groups(typed.people(_doubled(spark, d)))
    return groups.select(*dedup.KEY, "keeper", F.array_join("ids", ",").alias("ids"))


def person_dedup_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    e = _doubled(spark, d)
    return dedup.ambiguous_groups(dedup.person_groups(typed.people(e)), typed.families(e))


def person_keeper_map(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keeper_map(dedup.person_groups(typed.people(_doubled(spark, d))))


def rewritten_references(spark: SparkSession, d: str) -> DataFrame:
    """The references of all entities after every group of persons has become its keeper."""
    e = _doubled(spark, d)
    now = dedup.rewritten(e, dedup.keeper_map(dedup.person_groups(typed.people(e))))
    return refs.references(now).groupBy("bundle_id", "collection", "id", "key", "target").agg(F.count("*").alias("n"))


def family_dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    found = dedup.family_groups(typed.families(_doubled(spark, d)))
    return found.select("bundle_id", F.array_join("parent_set", ",").alias("parents"), "keeper", F.array_join("ids", ",").alias("ids"), "ambiguous")


def family_children_union(spark: SparkSession, d: str) -> DataFrame:
    e = _doubled(spark, d)
    sure = dedup.family_groups(typed.families(e)).where("not ambiguous")
    merged = dedup._merge(e, "families", sure, dedup.fold_family, dedup._couple_once)
    kept = typed.families(merged).join(sure.select("bundle_id", F.col("keeper").alias("family_id")), ["bundle_id", "family_id"], "left_semi")
    return kept.select("bundle_id", "family_id", F.explode(F.array_distinct("children")).alias("child"))


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(_bundles(spark, d, _doubled(spark, d))).data


def _counts(manifests: DataFrame) -> DataFrame:
    """(bundle_id, counts...): what the manifests say."""
    of = lambda c: F.get_json_object("body", f"$.stats.{c}").cast("long").alias(c)
    return manifests.select("bundle_id", *[of(c) for c in COLLECTIONS])


def manifest_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """Deleted persons and places are taken out of whole bundles; the manifests count what is left."""
    gone = _gone(spark, d, "persons", "persons").unionByName(_gone(spark, d, "places", "places"))
    return _counts(crud.edit(_bundles(spark, d, _written(spark, d)), "delete", gone, "orphan").bundles.manifests)


def manifest_after_add(spark: SparkSession, d: str) -> DataFrame:
    e = _written(spark, d)
    return _counts(crud.edit(_bundles(spark, d, e), "add", _requests(e)).bundles.manifests)


def manifest_after_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Families of one couple become one; the manifests count what is left."""
    return _counts(dedup.deduplicate(_bundles(spark, d, _doubled(spark, d))).bundles.manifests)


def _gone(spark: SparkSession, d: str, name: str, collection: str) -> DataFrame:
    rows = bundle.latest(table(spark, d, name)).where("deleted_at is not null")
    return rows.select("bundle_id", F.lit(collection).alias("collection"), "id")


def delete_reject(spark: SparkSession, d: str) -> DataFrame:
    return crud.delete(_entities(spark, d), _gone(spark, d, "places", "places"), "reject")[1]


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    left = crud.delete(_written(spark, d), _gone(spark, d, "persons", "persons"), "cascade")[0]
    return typed.families(left).select("bundle_id", "family_id", F.size("children").alias("n_children"), F.size("parents").alias("n_parents"))


def delete_orphan(spark: SparkSession, d: str) -> DataFrame:
    left = crud.delete(_written(spark, d), _gone(spark, d, "places", "places"), "orphan")[0]
    return left.where("collection = 'occupations'").select("bundle_id", "id", F.get_json_object("body", "$.place_id").alias("place_id"))


def _lost(before: DataFrame, left: DataFrame) -> DataFrame:
    """(bundle_id, collection, id, key, target, n): the references that entities which stay have lost."""
    cols = ["bundle_id", "collection", "id", "key", "target"]
    count = lambda e, sign: refs.references(e).select(*cols, F.lit(sign).alias("sign"))
    both = count(before.join(left.select(*cols[:3]), cols[:3], "left_semi"), 1).unionByName(count(left, -1))
    return both.groupBy(*cols).agg(F.sum("sign").alias("n")).where("n > 0")


def delete_cascade_changes(spark: SparkSession, d: str) -> DataFrame:
    e = _written(spark, d)
    return _lost(e, crud.delete(e, _gone(spark, d, "persons", "persons"), "cascade")[0])


def delete_orphan_changes(spark: SparkSession, d: str) -> DataFrame:
    e = _written(spark, d)
    return _lost(e, crud.delete(e, _gone(spark, d, "places", "places"), "orphan")[0])


def _requests(e: DataFrame) -> DataFrame:
    """Each entity once as it is and about half of them once under a new id."""
    new = e.where(F.substring("id", -1, 1) < "8").withColumn("body", F.regexp_replace("body", '^\\{"id":"(.{35}).', '{"id":"$1x'))
    return e.unionByName(new)


def add_guard(spark: SparkSession, d: str) -> DataFrame:
    e = _written(spark, d)
    added, refused = crud.add(e, _requests(e))
    return (
        added.groupBy("bundle_id", "collection").agg(F.count("*").alias("n_entities"))
        .join(refused.groupBy("bundle_id", "collection").agg(F.count("*").alias("n_refused")), ["bundle_id", "collection"], "left")
    )


def update_replace(spark: SparkSession, d: str) -> DataFrame:
    """About half of all entities replaced whole, the others as they were."""
    e = _written(spark, d)
    new = e.where(F.substring("id", -1, 1) < "8").withColumn("body", F.concat(F.lit('{"id":"'), "id", F.lit('","replaced":true}')))
    updated, _ = crud.update(e, new)
    return updated.select("bundle_id", "collection", "id", F.coalesce(F.get_json_object("body", "$.replaced") == "true", F.lit(False)).alias("replaced"))


def extract_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons").select("row_id", dates.extract_year(F.col("birth.date.value")).alias("year"))


def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons").select("row_id", names.normalize_name(F.col("identity.name.display")).alias("name"))


def bundle_union(spark: SparkSession, d: str) -> DataFrame:
    """All collections, about half of each replaced by a newer part."""
    e = _written(spark, d)
    both = bundle.union(e, e.where(F.substring("id", -1, 1) < "8").withColumn("body", F.lit("{}")))
    return both.select("bundle_id", "collection", "id", (F.col("body") == "{}").alias("replaced"))


def export_import_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    packed = files.archives(_bundles(spark, d))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bundle_id, content in zip(b["bundle_id"], b["content"], strict=True):
                rows = [(bundle_id, c, i, body) for part, c, i, body, _ in files._archive(content) if part == "entity"]
                yield pd.DataFrame(rows, columns=["bundle_id", "collection", "id", "body"])

    back = packed.select("bundle_id", "content").mapInPandas(unpack, bundle.ENTITY_SCHEMA)
    # what came back as it went
    return bundle.stats(back.join(_entities(spark, d), ["bundle_id", "collection", "id", "body"], "left_semi"))


# ---- GEDCOM


def gedcom_tree(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.tree(gedcom.once(table(spark, d, "gedcom_lines"))).select("file_id", "line_no", "record", "parent_line")


def gedcom_values(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.values(gedcom.once(table(spark, d, "gedcom_lines"))).select("file_id", "line_no", "value")


def gedcom_lines_parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = gedcom.once(table(spark, d, "gedcom_lines")).where("level is not null and tag is not null")
    text = F.concat_ws(" ", F.col("level").cast("string"), F.when(F.col("level") == 0, F.col("xref")), "tag", F.when(F.col("value") != "", F.col("value")))
    parsed = gedcom.parse_lines(rows.select(F.concat_ws("\u0001", "file_id", F.col("line_no").cast("string")).alias("file_id"), text.alias("text")))
    at = F.split("file_id", "\u0001")
    return parsed.select(at[0].alias("file_id"), at[1].cast("long").alias("line_no"), "level", "tag", F.rtrim("value").alias("value"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gedcom_lines").where("tag = 'DATE' and value is not null").select("value").distinct()


def gedcom_dates(spark: SparkSession, d: str) -> DataFrame:
    p = dates.gedcom_date(F.col("value"))
    return _dates(spark, d).select(F.col("value").alias("raw"), p.alias("p")).select(
        "raw", "p.value", "p.precision", F.coalesce("p.circa", F.lit(False)).alias("circa"), "p.note",
        *[F.col(f"p.{end}.{f}").alias(f"{end}_{f}") for end in ("earliest", "latest") for f in ("value", "precision", "note")],
    )


def gedcom_months(spark: SparkSession, d: str) -> DataFrame:
    each = _dates(spark, d).select(F.explode(F.split("value", " ")).alias("word")).distinct()
    return each.select("word", dates.month_number(F.col("word")).alias("month")).where("month is not null")


def gedcom_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gedcom_lines").where("tag = 'NAME' and value is not null").select("value").distinct()
    parts = names.name_components(F.col("value"))
    return rows.select("value", names.name_display(F.col("value")).alias("display"), parts.alias("parts")).select(
        "value", "display", F.try_element_at(F.transform(F.filter("parts", lambda x: x["type"] == "given_name"), lambda x: x["value"]), F.lit(1)).alias("given"),
        F.try_element_at(F.transform(F.filter("parts", lambda x: x["type"] == "family_name"), lambda x: x["value"]), F.lit(1)).alias("family"),
    )


def gedcom_places(spark: SparkSession, d: str) -> DataFrame:
    e, _ = gedcom.convert(table(spark, d, "gedcom_lines"))
    found = e.where("collection = 'places'").select("bundle_id", F.get_json_object("body", "$.names[0].value").alias("place"))
    return found


def gedcom_converted(spark: SparkSession, d: str) -> DataFrame:
    """The counts of every kind, as the manifests have them."""
    return _counts(gedcom.converted(table(spark, d, "gedcom_lines")).manifests)


def gedcom_persons(spark: SparkSession, d: str) -> DataFrame:
    e, _ = gedcom.convert(table(spark, d, "gedcom_lines"))
    of = lambda path, name: F.get_json_object("body", path).alias(name)
    return e.where("collection = 'persons'").select(
        "bundle_id", "id", of("$.identity.name.display", "display"), of("$.identity.gender.value", "gender"), of("$.identity.is_living", "is_living"),
        of("$.birth.date.value", "born"), of("$.death.date.value", "died"), of("$.notes", "notes"),
    ).distinct()


def gedcom_families(spark: SparkSession, d: str) -> DataFrame:
    """Who is in each family, by the ids that the persons have."""
    e, _ = gedcom.convert(table(spark, d, "gedcom_lines"))
    fams = typed.families(e)
    each = lambda c, role: fams.select("bundle_id", "family_id", F.explode(c).alias("person_id"), F.lit(role).alias("role"))
    return each("parents", "parent").unionByName(each("children", "child")).distinct()


def gedcom_occupations(spark: SparkSession, d: str) -> DataFrame:
    e, _ = gedcom.convert(table(spark, d, "gedcom_lines"))
    of = lambda path, name: F.get_json_object("body", path).alias(name)
    held = e.where("collection = 'occupations'").select("bundle_id", of("$.person_id", "person_id"), of("$.title", "title"), of("$.valid_from.date.value", "since"))
    return held.distinct()


def gedcom_skipped(spark: SparkSession, d: str) -> DataFrame:
    """What conversion leaves out, when sources come under a tag of no meaning."""
    lines = table(spark, d, "gedcom_lines").withColumn("tag", F.when((F.col("level") == 0) & (F.col("tag") == "SOUR"), "_SRC").otherwise(F.col("tag")))
    _, notes = gedcom.convert(lines)
    return notes.groupBy("bundle_id", "code").agg(F.count("*").alias("n"))


def mime_types(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.split(F.lit("jpg,PNG,tif,pdf,txt,html,mp3,mp4,doc,webp"), ","), (F.col("p_partkey") % 10 + 1).cast("int"))
    name = F.concat(F.lit("scan."), F.col("p_partkey").cast("string"), F.lit("."), ext)
    form = F.when(F.col("p_size") > 45, F.lit(" image/x-raw "))
    return table(spark, d, "part").select("p_partkey", names.mime_type(name, form).alias("mime"))


def arrivals_by_source(spark: SparkSession, d: str) -> DataFrame:
    return ingest.arrivals(table(spark, d, "documents").where("source is not null"), "source")


# ---- SQL

_TABLES = {"persons": "persons", "families": "families", "events": "vital_events", "links": "links", "occupations": "occupations", "sources": "sources", "places": "places"}
_LATEST = ", ".join(
    f"l_{c} AS (SELECT * FROM {t} WHERE id IS NOT NULL AND bundle_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bundle_id, id ORDER BY ingested_at DESC) = 1)"
    for c, t in _TABLES.items()
)
_IDS = " UNION ALL ".join(f"SELECT bundle_id, '{c}' AS collection, id FROM l_{c}" for c in _TABLES)
_STATS = f"WITH {_LATEST}, ids AS ({_IDS}) SELECT bundle_id, " + ", ".join(f"count(*) FILTER (WHERE collection = '{c}') AS {c}" for c in COLLECTIONS) + " FROM ids GROUP BY bundle_id"


def _ref(c: str, key: str, path: str) -> str:
    return f"SELECT bundle_id, '{c}' AS collection, id, '{key}' AS key, {path} AS target FROM l_{c}"


def _ref_each(c: str, key: str, array: str, path: str) -> str:
    return f"SELECT bundle_id, '{c}' AS collection, id, '{key}' AS key, x.{path} AS target FROM (SELECT bundle_id, id, unnest({array}) AS x FROM l_{c})"


_REFS = " UNION ALL ".join(
    [_ref("persons", f"{k}_id", f"{b}.{k}_id") for b in ("birth", "death") for k in ("place", "source", "event")]
    + [_ref_each("persons", "source_id", "identity.names", "source_id"), _ref_each("families", "person_id", "union_block.persons", "person_id"), _ref_each("families", "person_id", "children", "person_id")]
    + [_ref("families", "place_id", "union_block.start_block.place_id"), _ref("families", "event_id", "union_block.start_block.event_id"), _ref("families", "source_id", "union_block.source_id")]
    + [_ref("events", "place_id", "place_id"), _ref("events", "source_id", "source_id"), _ref_each("events", "entity_id", "participants", "entity_id")]
    + [_ref("links", "entity_id", "from_end.entity_id"), _ref("links", "entity_id", "to_end.entity_id"), _ref("sources", "place_id", "place_id")]
    + [_ref("occupations", k, k) for k in ("person_id", "place_id", "source_id")]
)
_UUID = "'[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'"
_DANGLING = f"WITH {_LATEST}, ids AS ({_IDS}), refs AS ({_REFS}) SELECT DISTINCT bundle_id, collection, id, key, target FROM refs r WHERE regexp_full_match(target, {_UUID}) AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.bundle_id = r.bundle_id AND i.id = r.target)"
_COPY = "CASE WHEN right({0}, 1) < '8' THEN left({0}, 35) || 'x' END"
_PERSON_KEY = f"coalesce({_COPY.format('x.person_id')}, x.person_id)"
_DOUBLED = _LATEST.replace("l_persons AS", "o_persons AS").replace("l_families AS", "o_families AS") + f""",
l_persons AS (SELECT * FROM o_persons UNION ALL SELECT * REPLACE ({_COPY.format('id')} AS id) FROM o_persons WHERE right(id, 1) < '8'),
l_families AS (SELECT * FROM o_families UNION ALL SELECT * REPLACE (
    {_COPY.format('id')} AS id,
    CASE WHEN union_block IS NOT NULL AND right(id, 1) < '4' THEN struct_update(union_block, kind := 'other') ELSE union_block END AS union_block,
    list_transform(children, lambda x: struct_update(x, person_id := {_PERSON_KEY})) AS children)
  FROM o_families WHERE right(id, 1) < '8')"""
_REFERRERS = f"WITH {_LATEST}, refs AS ({_REFS}) SELECT r.bundle_id, r.target, count(DISTINCT (r.collection, r.id)) AS n_referrers FROM refs r JOIN l_places p ON p.bundle_id = r.bundle_id AND p.id = r.target WHERE NOT (r.collection = 'places' AND r.id = r.target) GROUP BY ALL"
_FAMS = """
parents AS (SELECT bundle_id, id AS family_id, x.person_id AS parent FROM (SELECT bundle_id, id, unnest(union_block.persons) AS x FROM l_families) WHERE x.person_id IS NOT NULL),
kids AS (SELECT bundle_id, id AS family_id, x.person_id AS child FROM (SELECT bundle_id, id, unnest(children) AS x FROM l_families) WHERE x.person_id IS NOT NULL),
edges AS (SELECT bundle_id, family_id, parent, child FROM parents JOIN kids USING (bundle_id, family_id)),
people AS (SELECT bundle_id, id, trim(regexp_replace(lower(identity.name.display), '[\\s\\p{Z}\\x{0085}]+', ' ', 'g')) AS name,
  try_cast(regexp_extract(birth.date.value, '^[0-9]{1,4}') AS INTEGER) AS birth_year, try_cast(regexp_extract(death.date.value, '^[0-9]{1,4}') AS INTEGER) AS death_year FROM l_persons),
sets AS (SELECT bundle_id, family_id, string_agg(DISTINCT parent, ',' ORDER BY parent) AS parents FROM parents GROUP BY ALL)"""
_CHRONOLOGY = f"WITH {_LATEST}, {_FAMS} SELECT e.bundle_id, family_id, parent, child, p.birth_year AS parent_year, c.birth_year AS child_year FROM edges e JOIN people p ON p.bundle_id = e.bundle_id AND p.id = e.parent JOIN people c ON c.bundle_id = e.bundle_id AND c.id = e.child WHERE c.birth_year < p.birth_year"
_COUPLES = f"WITH {_LATEST}, {_FAMS} SELECT bundle_id, parents, string_agg(family_id, ',' ORDER BY family_id) AS families FROM sets GROUP BY bundle_id, parents HAVING count(*) > 1"
_COUPLES_DOUBLED = _COUPLES.replace(_LATEST, _DOUBLED)
_SELF = f"WITH {_LATEST}, {_FAMS} SELECT bundle_id, family_id, child AS person_id FROM edges WHERE parent = child"
_CYCLES = f"WITH RECURSIVE {_LATEST}, {_FAMS}, up(bundle_id, person, ancestor) AS (SELECT bundle_id, child, parent FROM edges UNION SELECT u.bundle_id, u.person, e.parent FROM up u JOIN edges e ON e.bundle_id = u.bundle_id AND e.child = u.ancestor) SELECT bundle_id, person AS person_id FROM up WHERE person = ancestor"
_CODES = f"""SELECT bundle_id, 'DANGLING_REFERENCE' AS code, 'warning' AS severity FROM ({_DANGLING}) UNION ALL SELECT bundle_id, 'CYCLE_DETECTED', 'error' FROM ({_SELF})
UNION ALL SELECT bundle_id, 'CHRONOLOGY_CONFLICT', 'warning' FROM ({_CHRONOLOGY}) UNION ALL SELECT bundle_id, 'DUPLICATE_UNIQUE_REF', 'warning' FROM ({_COUPLES})"""
_GROUPS = "groups AS (SELECT bundle_id, name, birth_year, death_year, min(id) AS keeper, list(id ORDER BY id) AS ids FROM people WHERE name <> '' AND birth_year IS NOT NULL AND death_year IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"
_MEMBERS = "members AS (SELECT bundle_id, name, birth_year, death_year, keeper, unnest(ids) AS id FROM groups)"
_AMBIGUOUS = f"""WITH RECURSIVE {_DOUBLED}, {_FAMS}, {_GROUPS}, {_MEMBERS},
up(bundle_id, person, ancestor) AS (SELECT bundle_id, child, parent FROM edges WHERE child <> parent UNION SELECT u.bundle_id, u.person, e.parent FROM up u JOIN edges e ON e.bundle_id = u.bundle_id AND e.child = u.ancestor WHERE e.child <> e.parent)
SELECT DISTINCT a.bundle_id, a.name, a.birth_year, a.death_year FROM members a JOIN members b USING (bundle_id, name, birth_year, death_year)
WHERE EXISTS (SELECT 1 FROM up u WHERE u.bundle_id = a.bundle_id AND u.person = a.id AND u.ancestor = b.id AND (a.id <> b.id OR u.person = u.ancestor))
OR (a.id < b.id AND EXISTS (SELECT 1 FROM edges x JOIN edges y USING (bundle_id, parent) WHERE x.bundle_id = a.bundle_id AND x.child = a.id AND y.child = b.id AND x.child <> x.parent AND y.child <> y.parent))"""
_FAMILY_GROUPS = f"""WITH {_DOUBLED}, {_FAMS}, f AS (SELECT s.*, l.union_block.kind AS kind, try_cast(regexp_extract(l.union_block.start_block.date.value, '^[0-9]{{1,4}}') AS INTEGER) AS y FROM sets s JOIN l_families l ON l.bundle_id = s.bundle_id AND l.id = s.family_id)
SELECT bundle_id, parents, min(family_id) AS keeper, string_agg(family_id, ',' ORDER BY family_id) AS ids, count(DISTINCT kind) > 1 OR coalesce(max(y) - min(y), 0) > 1 AS ambiguous FROM f GROUP BY bundle_id, parents HAVING count(*) > 1"""
# what each word stands for, written out here so that the SQL does not share the tables of the expression
_WORDS = [("(PRZED|AVANT|AV|VOR) ", "BEF "), ("(OK|OKOŁO|VERS|ENV|UM) ", "ABT "), ("(PO|APRÈS|APRES|AP|NACH) ", "AFT "), ("(MIĘDZY|ENTRE|ZWISCHEN) ", "BET "), (" (I|ET|UND) ", " AND "), (" ROKU| R[.]", "")]
_QUALIFIED = "upper(trim(value))"
for _old, _new in _WORDS:
    _QUALIFIED = f"regexp_replace({_QUALIFIED}, '{_old}', '{_new}', 'g')"
_QUALIFIED = f"regexp_replace(trim({_QUALIFIED}), ' R$', '')"
_MONTHS = """MAP {'JAN': 1, 'JANUARY': 1, 'STYCZEŃ': 1, 'STYCZNIA': 1, 'JANVIER': 1, 'JANUAR': 1, 'FEB': 2, 'FEBRUARY': 2, 'LUTY': 2, 'LUTEGO': 2, 'FÉVRIER': 2, 'FEVRIER': 2, 'FEBRUAR': 2,
'MAR': 3, 'MARCH': 3, 'MARZEC': 3, 'MARCA': 3, 'MARS': 3, 'MÄRZ': 3, 'MAERZ': 3, 'APR': 4, 'APRIL': 4, 'KWIECIEŃ': 4, 'KWIETNIA': 4, 'AVRIL': 4, 'MAY': 5, 'MAJ': 5, 'MAJA': 5, 'MAI': 5,
'JUN': 6, 'JUNE': 6, 'CZERWIEC': 6, 'CZERWCA': 6, 'JUIN': 6, 'JUNI': 6, 'JUL': 7, 'JULY': 7, 'LIPIEC': 7, 'LIPCA': 7, 'JUILLET': 7, 'JULI': 7, 'AUG': 8, 'AUGUST': 8, 'SIERPIEŃ': 8, 'SIERPNIA': 8, 'AOÛT': 8, 'AOUT': 8,
'SEP': 9, 'SEPT': 9, 'SEPTEMBER': 9, 'WRZESIEŃ': 9, 'WRZEŚNIA': 9, 'SEPTEMBRE': 9, 'OCT': 10, 'OCTOBER': 10, 'PAŹDZIERNIK': 10, 'PAŹDZIERNIKA': 10, 'OCTOBRE': 10, 'OKTOBER': 10,
'NOV': 11, 'NOVEMBER': 11, 'LISTOPAD': 11, 'LISTOPADA': 11, 'NOVEMBRE': 11, 'DEC': 12, 'DECEMBER': 12, 'GRUDZIEŃ': 12, 'GRUDNIA': 12, 'DÉCEMBRE': 12, 'DECEMBRE': 12, 'DEZEMBER': 12}"""


def _sql_iso(x: str) -> str:
    p = f"regexp_split_to_array(trim({x}), '\\s+')"
    month = lambda i: f"({_MONTHS})[trim(regexp_replace({p}[{i}], '\\.+$', ''))]"
    year = lambda i: f"(CASE WHEN regexp_full_match({p}[{i}], '[+-]?[0-9]{{1,9}}') THEN try_cast({p}[{i}] AS INTEGER) END)"
    day = f"(CASE WHEN regexp_full_match({p}[1], '[+]?[0-9]{{1,9}}') THEN try_cast({p}[1] AS INTEGER) END)"
    return f"""(CASE WHEN regexp_full_match(trim({x}), '[0-9]{{4}}') THEN trim({x})
    WHEN len({p}) = 3 AND {day} IS NOT NULL AND {month(2)} IS NOT NULL AND {year(3)} IS NOT NULL THEN format('{{:04d}}-{{:02d}}-{{:02d}}', {year(3)}, {month(2)}, {day})
    WHEN len({p}) = 2 AND {month(1)} IS NOT NULL AND {year(2)} IS NOT NULL THEN format('{{:04d}}-{{:02d}}', {year(2)}, {month(1)})
    WHEN len({p}) = 1 AND {year(1)} IS NOT NULL THEN format('{{:04d}}', {year(1)}) END)"""


_PRECISION = "CASE length({0}) - length(replace({0}, '-', '')) WHEN 2 THEN 'exact' WHEN 1 THEN 'month' ELSE 'year' END"


def _sql_bound(name: str, text: str, iso: str) -> str:
    """value, precision and note of one end of a range; all null where there is no such end."""
    return f"{iso} AS {name}_value, CASE WHEN ({text}) IS NULL THEN NULL WHEN ({iso}) IS NULL THEN 'unknown' ELSE {_PRECISION.format('(' + iso + ')')} END AS {name}_precision, CASE WHEN ({iso}) IS NULL THEN trim({text}) END AS {name}_note"


_DATES = f"""WITH raw AS (SELECT DISTINCT value FROM gedcom_lines WHERE tag = 'DATE' AND value IS NOT NULL),
u AS (SELECT value, {_QUALIFIED} AS up FROM raw),
p AS (SELECT value, up, substr(up, 5) AS rest, trim(regexp_extract(substr(up, 5), '^(.*?) AND (.*)$', 1)) AS low, trim(regexp_extract(substr(up, 5), '^(.*?) AND (.*)$', 2)) AS high FROM u),
k AS (SELECT *, CASE WHEN trim(value) = '' THEN 'blank' WHEN starts_with(up, 'BET ') AND low <> '' AND high <> '' THEN 'bet' WHEN starts_with(up, 'BEF ') THEN 'bef' WHEN starts_with(up, 'AFT ') THEN 'aft' WHEN starts_with(up, 'ABT ') THEN 'abt' ELSE 'plain' END AS kind,
  {_sql_iso('up')} AS iso, {_sql_iso('rest')} AS iso_rest, {_sql_iso('low')} AS iso_low, {_sql_iso('high')} AS iso_high FROM p)
SELECT value AS raw, CASE kind WHEN 'abt' THEN coalesce(iso_rest, rest) WHEN 'plain' THEN iso END AS value,
  CASE WHEN kind = 'abt' THEN 'year' WHEN kind = 'plain' AND iso IS NOT NULL THEN CASE length(iso) - length(replace(iso, '-', '')) WHEN 2 THEN 'exact' WHEN 1 THEN 'month' ELSE 'year' END ELSE 'unknown' END AS precision,
  kind = 'abt' AS circa, CASE WHEN kind = 'plain' AND iso IS NULL THEN value END AS note,
  {_sql_bound("earliest", "CASE kind WHEN 'bet' THEN low WHEN 'aft' THEN rest END", "CASE kind WHEN 'bet' THEN iso_low WHEN 'aft' THEN iso_rest END")},
  {_sql_bound("latest", "CASE kind WHEN 'bet' THEN high WHEN 'bef' THEN rest END", "CASE kind WHEN 'bet' THEN iso_high WHEN 'bef' THEN iso_rest END")} FROM k"""
_MONTH_WORDS = f"SELECT word, ({_MONTHS})[trim(regexp_replace(upper(word), '\\.+$', ''))] AS month FROM (SELECT DISTINCT unnest(string_split(value, ' ')) AS word FROM gedcom_lines WHERE tag = 'DATE' AND value IS NOT NULL) WHERE month IS NOT NULL"
_LINES = "lines AS (SELECT * FROM gedcom_lines WHERE file_id IS NOT NULL AND line_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY ingested_at DESC, level DESC, tag DESC, value DESC) = 1)"
# the parent of a line is the last line before it that is one level up, with no line of a lower level between; the chain
# is broken where that one is missing or itself left out
_TREE = f"""{_LINES}, nodes AS (SELECT *, max(CASE WHEN level = 0 THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS record FROM lines WHERE level IS NOT NULL AND coalesce(tag, '') NOT IN ('CONC', 'CONT')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY file_id, record ORDER BY line_no) AS k FROM nodes WHERE record IS NOT NULL),
walk(file_id, record, k, path, parent_line, kept) AS (
  SELECT file_id, record, k, [line_no], CAST(NULL AS BIGINT), true FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.file_id, o.record, o.k, CASE WHEN o.level <= len(w.path) THEN list_append(w.path[1:o.level], o.line_no) ELSE w.path END,
    CASE WHEN o.level BETWEEN 1 AND len(w.path) THEN w.path[o.level] END, o.level <= len(w.path)
  FROM walk w JOIN ordered o ON o.file_id = w.file_id AND o.record = w.record AND o.k = w.k + 1),
tree AS (SELECT o.*, w.parent_line FROM ordered o JOIN walk w USING (file_id, record, k) WHERE w.kept)"""
_VALUES = f"""WITH {_LINES}, h AS (SELECT *, max(CASE WHEN coalesce(tag, '') NOT IN ('CONC', 'CONT') THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS head FROM lines)
SELECT file_id, head AS line_no, string_agg(CASE WHEN tag = 'CONT' THEN chr(10) ELSE '' END || coalesce(value, ''), '' ORDER BY line_no) AS value FROM h WHERE head IS NOT NULL GROUP BY file_id, head"""
_RECORDS = f"""{_TREE}, whole AS ({_VALUES.replace(_LINES + ", h AS", "h AS")}), tops AS (SELECT file_id, record, tag, xref FROM tree WHERE level = 0),
subs AS (SELECT t.file_id, t.record, o.tag AS top, o.xref, t.line_no, t.tag, trim(coalesce(t.value, '')) AS value FROM tree t JOIN tops o USING (file_id, record) WHERE t.level = 1 AND o.xref IS NOT NULL),
fam AS (SELECT file_id, record, any_value(xref) AS xref, count(*) FILTER (WHERE tag IN ('HUSB', 'WIFE') AND value LIKE '@%@') AS couple, count(*) FILTER (WHERE tag = 'CHIL' AND value LIKE '@%@') AS kids, count(*) FILTER (WHERE tag = 'MARR') AS marr FROM subs WHERE top = 'FAM' GROUP BY file_id, record)"""
_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_UU = "regexp_replace(md5({0} || ':' || {1}), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', '\\1-\\2-4\\3-a\\4-\\5')"
_POINTER = "(length({0}) > 1 AND starts_with({0}, '@') AND ends_with({0}, '@'))"
_PLACES = f"""SELECT DISTINCT p.file_id AS bundle_id, {_BARE.format("coalesce(p.value, '')")} AS place FROM full_ p JOIN tree u ON u.file_id = p.file_id AND u.line_no = p.parent_line JOIN tops o ON o.file_id = p.file_id AND o.record = p.record
LEFT JOIN fam f ON f.file_id = p.file_id AND f.record = p.record WHERE p.tag = 'PLAC' AND p.level = 2 AND o.xref IS NOT NULL
AND ((o.tag = 'INDI' AND (u.tag IN ('BIRT', 'DEAT') OR (u.tag = 'OCCU' AND trim(coalesce(u.value, '')) <> ''))) OR (o.tag = 'FAM' AND u.tag = 'MARR' AND f.couple > 0))"""
_RECORDS += f""",
full_ AS (SELECT t.file_id, t.record, t.line_no, t.parent_line, t.level, t.tag, v.value, {_BARE.format("v.value")} AS bare FROM tree t JOIN whole v USING (file_id, line_no)),
own AS (SELECT x.*, o.tag AS top, o.xref FROM full_ x JOIN tops o USING (file_id, record) WHERE o.xref IS NOT NULL),
dates AS ({{dates}}),
dated AS (SELECT x.file_id, x.parent_line, arg_min(d.value, x.line_no) AS day FROM (SELECT *, row_number() OVER (PARTITION BY file_id, parent_line ORDER BY line_no) AS k FROM own WHERE tag = 'DATE') x LEFT JOIN dates d ON d.raw = x.value WHERE x.k = 1 GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY file_id, record, tag ORDER BY line_no) AS k FROM own WHERE level = 1)"""
_RECORDS = _RECORDS.replace("{dates}", _DATES)
_CONVERTED = f"""WITH RECURSIVE {_RECORDS}, made AS (
SELECT file_id, 'persons' AS c FROM tops WHERE tag = 'INDI' AND xref IS NOT NULL UNION ALL SELECT file_id, 'families' FROM fam WHERE couple + kids > 0
UNION ALL SELECT file_id, 'events' FROM fam WHERE couple > 0 AND marr > 0 UNION ALL SELECT file_id, 'occupations' FROM subs WHERE top = 'INDI' AND tag = 'OCCU' AND value <> ''
UNION ALL SELECT file_id, 'sources' FROM tops WHERE tag = 'SOUR' AND xref IS NOT NULL UNION ALL SELECT file_id, 'documents' FROM tops WHERE tag = 'OBJE' AND xref IS NOT NULL UNION ALL SELECT bundle_id, 'places' FROM ({_PLACES}))
SELECT f.file_id AS bundle_id, """ + ", ".join(f"count(*) FILTER (WHERE c = '{c}') AS {c}" for c in COLLECTIONS) + """ FROM (SELECT DISTINCT file_id FROM gedcom_lines WHERE file_id IS NOT NULL) f LEFT JOIN made m ON m.file_id = f.file_id GROUP BY f.file_id"""
_FIRST = "(SELECT {0} FROM firsts x WHERE x.file_id = o.file_id AND x.record = o.record AND x.tag = '{1}' AND x.k = 1)"
_DAY = "(SELECT d.day FROM firsts x JOIN dated d ON d.file_id = x.file_id AND d.parent_line = x.line_no WHERE x.file_id = o.file_id AND x.record = o.record AND x.tag = '{0}' AND x.k = 1)"
_GED_PERSONS = f"""WITH RECURSIVE {_RECORDS}, said AS (SELECT file_id, record, string_agg(CASE WHEN tag = 'NOTE' THEN bare ELSE tag || ': ' || bare END, chr(10) ORDER BY line_no) AS notes
  FROM own WHERE level = 1 AND tag IN ('NOTE', 'TITL', 'FACT') AND bare <> '' AND NOT (tag = 'NOTE' AND {_POINTER.format('bare')}) GROUP BY ALL)
SELECT DISTINCT o.file_id AS bundle_id, {_UU.format('o.file_id', _BARE.format('o.xref'))} AS id, coalesce(nullif({_BARE.format("regexp_replace(replace(" + _FIRST.format('x.value', 'NAME') + ", '/', ''), '[" + chr(92) + "s" + chr(92) + "p{Z}]+', ' ', 'g')")}, ''), '[Unknown]') AS display,
  CASE WHEN {_FIRST.format('x.bare', 'SEX')} IN ('M', 'F', 'NB') THEN {_FIRST.format('x.bare', 'SEX')} ELSE 'U' END AS gender,
  CASE WHEN {_FIRST.format('x.line_no', 'DEAT')} IS NULL THEN 'true' ELSE 'false' END AS is_living, {_DAY.format('BIRT')} AS born, {_DAY.format('DEAT')} AS died, said.notes
FROM tops o LEFT JOIN said USING (file_id, record) WHERE o.tag = 'INDI' AND o.xref IS NOT NULL"""
_GED_FAMILIES = f"""WITH RECURSIVE {_RECORDS} SELECT DISTINCT file_id AS bundle_id, {_UU.format('file_id', _BARE.format('xref'))} AS family_id, {_UU.format('file_id', 'bare')} AS person_id,
CASE tag WHEN 'CHIL' THEN 'child' ELSE 'parent' END AS role FROM own WHERE top = 'FAM' AND level = 1 AND tag IN ('HUSB', 'WIFE', 'CHIL') AND {_POINTER.format('bare')}"""
_GED_OCCUPATIONS = f"""WITH RECURSIVE {_RECORDS} SELECT DISTINCT x.file_id AS bundle_id, {_UU.format('x.file_id', _BARE.format('x.xref'))} AS person_id, x.bare AS title, d.day AS since
FROM own x LEFT JOIN dated d ON d.file_id = x.file_id AND d.parent_line = x.line_no WHERE x.top = 'INDI' AND x.level = 1 AND x.tag = 'OCCU' AND x.bare <> ''"""
_GED_SKIPPED = f"""WITH RECURSIVE {_RECORDS}, s AS (SELECT file_id FROM tops WHERE tag NOT IN ('HEAD', 'TRLR', 'NOTE', 'REPO', 'INDI', 'FAM', 'OBJE') UNION ALL SELECT file_id FROM own WHERE top = 'INDI' AND level = 1 AND tag = 'OCCU' AND bare = ''
UNION ALL SELECT t.file_id FROM tops t LEFT JOIN fam f USING (file_id, record) WHERE t.tag = 'FAM' AND t.xref IS NOT NULL AND coalesce(f.couple + f.kids, 0) = 0) SELECT file_id AS bundle_id, 'GEDCOM_UNRECOGNIZED_TAG' AS code, count(*) AS n FROM s GROUP BY ALL"""
_CHILDREN = f"WITH {_DOUBLED}, {_FAMS}, g AS ({_FAMILY_GROUPS}) SELECT DISTINCT g.bundle_id, g.keeper AS family_id, k.child FROM (SELECT bundle_id, keeper, unnest(string_split(ids, ',')) AS family_id FROM g WHERE NOT ambiguous) g JOIN kids k USING (bundle_id, family_id)"
_MERGED = _AMBIGUOUS.replace("\nSELECT DISTINCT a.bundle_id, a.name", ",\namb AS (SELECT DISTINCT a.bundle_id, a.name", 1) + """),
clear AS (SELECT g.* FROM groups g ANTI JOIN amb USING (bundle_id, name, birth_year, death_year)), m AS (SELECT bundle_id, unnest(ids) AS id, keeper FROM clear),
sets2 AS (SELECT p.bundle_id, p.family_id, string_agg(DISTINCT coalesce(m.keeper, p.parent), ',' ORDER BY coalesce(m.keeper, p.parent)) AS parents FROM parents p LEFT JOIN m ON m.bundle_id = p.bundle_id AND m.id = p.parent GROUP BY ALL),
f AS (SELECT s.*, l.union_block.kind AS kind, try_cast(regexp_extract(l.union_block.start_block.date.value, '^[0-9]{1,4}') AS INTEGER) AS y FROM sets2 s JOIN l_families l ON l.bundle_id = s.bundle_id AND l.id = s.family_id),
fg AS (SELECT bundle_id, parents, count(*) AS n, count(DISTINCT kind) > 1 OR coalesce(max(y) - min(y), 0) > 1 AS ambiguous FROM f GROUP BY bundle_id, parents HAVING count(*) > 1),
ids AS (""" + _IDS + """),
done AS (SELECT b.bundle_id, CAST(coalesce((SELECT sum(len(ids) - 1) FROM clear c WHERE c.bundle_id = b.bundle_id), 0) AS BIGINT) AS merged_persons,
  CAST(coalesce((SELECT sum(n - 1) FROM fg WHERE fg.bundle_id = b.bundle_id AND NOT ambiguous), 0) AS BIGINT) AS merged_families,
  (SELECT count(*) FROM amb WHERE amb.bundle_id = b.bundle_id) + (SELECT count(*) FROM fg WHERE fg.bundle_id = b.bundle_id AND ambiguous) AS manual_review
  FROM (SELECT DISTINCT bundle_id FROM ids) b)
"""
_BY_KIND = ", ".join(f"count(*) FILTER (WHERE collection = '{c}') AS {c}" for c in COLLECTIONS)
_AFTER_DEDUP = _MERGED + f"SELECT c.* REPLACE (persons - merged_persons AS persons, families - merged_families AS families) FROM (SELECT bundle_id, {_BY_KIND} FROM ids GROUP BY bundle_id) c JOIN done USING (bundle_id)"
# manifests of bundles in which nothing changed stay as they were: the test manifests count no persons and nothing else
_OR_BEFORE = ", ".join(f"CASE WHEN changed THEN {c} {'ELSE 0 ' if c == 'persons' else ''}END AS {c}" for c in COLLECTIONS)
_AFTER_DELETE = f"WITH {_LATEST}, ids AS ({_IDS}), gone AS (SELECT bundle_id, 'persons' AS collection, id FROM l_persons WHERE deleted_at IS NOT NULL UNION ALL SELECT bundle_id, 'places', id FROM l_places WHERE deleted_at IS NOT NULL), c AS (SELECT i.bundle_id, bool_or(g.id IS NOT NULL) AS changed, {_BY_KIND.replace('WHERE ', 'WHERE g.id IS NULL AND ').replace('collection =', 'i.collection =')} FROM ids i LEFT JOIN gone g ON g.bundle_id = i.bundle_id AND g.collection = i.collection AND g.id = i.id GROUP BY i.bundle_id) SELECT bundle_id, {_OR_BEFORE} FROM c"
_AFTER_ADD = f"WITH {_LATEST}, ids AS ({_IDS}), both_ AS (SELECT *, false AS new FROM ids UNION ALL SELECT *, true FROM ids WHERE right(id, 1) < '8'), c AS (SELECT bundle_id, bool_or(new) AS changed, {_BY_KIND} FROM both_ GROUP BY bundle_id) SELECT bundle_id, {_OR_BEFORE} FROM c"
_DEAD = "gone AS (SELECT bundle_id, id FROM l_{} WHERE deleted_at IS NOT NULL)"


def _lost_sql(name: str) -> str:
    return f"WITH {_LATEST}, {_DEAD.format(name)}, refs AS ({_REFS}) SELECT r.bundle_id, r.collection, r.id, r.key, r.target, count(*) AS n FROM refs r JOIN gone g ON g.bundle_id = r.bundle_id AND g.id = r.target WHERE NOT (r.collection = '{name}' AND EXISTS (SELECT 1 FROM gone x WHERE x.bundle_id = r.bundle_id AND x.id = r.id)) GROUP BY ALL"


QUERIES = {
    "inspect_stats": (inspect_stats, _STATS),
    "dangling_refs": (dangling_refs, _DANGLING),
    "referrers_of_places": (referrers_of_places, _REFERRERS),
    "chronology_conflicts": (chronology_conflicts, _CHRONOLOGY),
    "duplicate_spouse_sets": (duplicate_spouse_sets, _COUPLES_DOUBLED),
    "self_parent": (self_parent, _SELF),
    "cycle_members": (cycle_members, _CYCLES),
    "loop_edges": (loop_edges, None),
    "schema_violations": (schema_violations, None),
    "severity_counts": (severity_counts, None),
    "diagnostics_by_code": (diagnostics_by_code, None),
    "diagnostics_without_structure_and_loops": (diagnostics_without_structure_and_loops, f"SELECT bundle_id, code, severity, count(*) AS n FROM ({_CODES}) GROUP BY ALL"),
    "person_dedup_groups": (person_dedup_groups, f"WITH {_DOUBLED}, {_FAMS}, {_GROUPS} SELECT bundle_id, name, birth_year, death_year, keeper, array_to_string(ids, ',') AS ids FROM groups"),
    "person_dedup_ambiguous": (person_dedup_ambiguous, _AMBIGUOUS),
    "person_keeper_map": (person_keeper_map, f"WITH {_DOUBLED}, {_FAMS}, {_GROUPS}, {_MEMBERS} SELECT bundle_id, id AS old, keeper AS new FROM members WHERE id <> keeper"),
    "rewritten_references": (rewritten_references, f"WITH {_DOUBLED}, {_FAMS}, {_GROUPS}, {_MEMBERS}, refs AS ({_REFS}) SELECT r.bundle_id, r.collection, r.id, r.key, coalesce(m.keeper, r.target) AS target, count(*) AS n FROM refs r LEFT JOIN members m ON m.bundle_id = r.bundle_id AND m.id = r.target WHERE r.target IS NOT NULL GROUP BY ALL"),
    "family_dedup_groups": (family_dedup_groups, _FAMILY_GROUPS),
    "family_children_union": (family_children_union, _CHILDREN),
    "deduplicated": (deduplicated, _MERGED + "SELECT * FROM done"),
    "manifest_after_delete": (manifest_after_delete, _AFTER_DELETE),
    "manifest_after_add": (manifest_after_add, _AFTER_ADD),
    "manifest_after_dedup": (manifest_after_dedup, _AFTER_DEDUP),
    "delete_reject": (delete_reject, f"WITH {_LATEST}, {_DEAD.format('places')}, refs AS ({_REFS}) SELECT DISTINCT g.bundle_id, 'places' AS collection, g.id, 'DELETE_BLOCKED_BY_REFERENCE' AS code FROM gone g JOIN refs r ON r.bundle_id = g.bundle_id AND r.target = g.id"),
    "delete_cascade": (delete_cascade, f"WITH {_LATEST}, {_DEAD.format('persons')}, {_FAMS}, n AS (SELECT l.bundle_id, l.id AS family_id, (SELECT count(*) FROM kids k WHERE k.bundle_id = l.bundle_id AND k.family_id = l.id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.bundle_id = k.bundle_id AND g.id = k.child)) AS c, (SELECT count(*) FROM parents p WHERE p.bundle_id = l.bundle_id AND p.family_id = l.id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.bundle_id = p.bundle_id AND g.id = p.parent)) AS p FROM l_families l) SELECT bundle_id, family_id, CAST(c AS INTEGER) AS n_children, CAST(p AS INTEGER) AS n_parents FROM n"),
    "delete_orphan": (delete_orphan, f"WITH {_LATEST}, {_DEAD.format('places')} SELECT o.bundle_id, o.id, CASE WHEN g.id IS NULL THEN o.place_id END AS place_id FROM l_occupations o LEFT JOIN gone g ON g.bundle_id = o.bundle_id AND g.id = o.place_id"),
    "delete_cascade_changes": (delete_cascade_changes, _lost_sql("persons")),
    "delete_orphan_changes": (delete_orphan_changes, _lost_sql("places")),
    "add_guard": (add_guard, f"WITH {_LATEST}, ids AS ({_IDS}) SELECT bundle_id, collection, count(*) + count(*) FILTER (WHERE right(id, 1) < '8') AS n_entities, count(*) AS n_refused FROM ids GROUP BY ALL"),
    "update_replace": (update_replace, f"WITH {_LATEST}, ids AS ({_IDS}) SELECT bundle_id, collection, id, right(id, 1) < '8' AS replaced FROM ids"),
    "extract_year": (extract_year, "SELECT row_id, try_cast(regexp_extract(birth.date.value, '^[0-9]{1,4}') AS INTEGER) AS year FROM persons"),
    "normalized_names": (normalized_names, "SELECT row_id, trim(regexp_replace(lower(identity.name.display), '[\\s\\p{Z}\\x{0085}]+', ' ', 'g')) AS name FROM persons"),
    "bundle_union": (bundle_union, f"WITH {_LATEST}, ids AS ({_IDS}) SELECT bundle_id, collection, id, right(id, 1) < '8' AS replaced FROM ids"),
    "export_import_roundtrip": (export_import_roundtrip, _STATS),
    "gedcom_tree": (gedcom_tree, f"WITH RECURSIVE {_TREE} SELECT file_id, line_no, record, parent_line FROM tree"),
    "gedcom_values": (gedcom_values, _VALUES),
    "gedcom_lines_parsed": (gedcom_lines_parsed, f"WITH {_LINES} SELECT file_id, line_no, level, tag, rtrim(coalesce(value, '')) AS value FROM lines WHERE level IS NOT NULL AND tag IS NOT NULL"),
    "gedcom_dates": (gedcom_dates, _DATES),
    "gedcom_months": (gedcom_months, _MONTH_WORDS),
    "gedcom_names": (gedcom_names, "SELECT DISTINCT value, trim(regexp_replace(replace(value, '/', ''), '[\\s\\p{Z}\\x{0085}]+', ' ', 'g')) AS display, nullif(trim(CASE WHEN regexp_full_match(value, '(?s).*/.*/.*') THEN regexp_extract(value, '(?s)^([^/]*)/', 1) ELSE value END), '') AS given, nullif(trim(regexp_extract(value, '(?s)^[^/]*/(.*)/[^/]*$', 1)), '') AS family FROM gedcom_lines WHERE tag = 'NAME' AND value IS NOT NULL"),
    "gedcom_places": (gedcom_places, f"WITH RECURSIVE {_RECORDS} SELECT DISTINCT p.file_id AS bundle_id, trim(coalesce(v.value, '')) AS place FROM tree p JOIN tree u ON u.file_id = p.file_id AND u.line_no = p.parent_line JOIN ({_VALUES}) v ON v.file_id = p.file_id AND v.line_no = p.line_no JOIN tops o ON o.file_id = p.file_id AND o.record = p.record LEFT JOIN fam f ON f.file_id = p.file_id AND f.record = p.record WHERE p.tag = 'PLAC' AND p.level = 2 AND o.xref IS NOT NULL AND ((o.tag = 'INDI' AND (u.tag IN ('BIRT', 'DEAT') OR (u.tag = 'OCCU' AND trim(coalesce(u.value, '')) <> ''))) OR (o.tag = 'FAM' AND u.tag = 'MARR' AND f.couple > 0))"),
    "gedcom_converted": (gedcom_converted, _CONVERTED),
    "gedcom_persons": (gedcom_persons, _GED_PERSONS),
    "gedcom_families": (gedcom_families, _GED_FAMILIES),
    "gedcom_occupations": (gedcom_occupations, _GED_OCCUPATIONS),
    "gedcom_skipped": (gedcom_skipped, _GED_SKIPPED),
    "mime_types": (mime_types, "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'image/x-raw' ELSE (['image/jpeg', 'image/png', 'image/tiff', 'application/pdf', 'text/plain', 'text/html', 'audio/mpeg', 'video/mp4', 'application/octet-stream', 'image/webp'])[p_partkey % 10 + 1] END AS mime FROM part"),
    "arrivals_by_source": (arrivals_by_source, "SELECT date_trunc('day', ingested_at) AS start, source, count(*) AS n FROM documents WHERE source IS NOT NULL AND ingested_at IS NOT NULL GROUP BY ALL"),
}

"""Typed views of documents: the few paths that the relational operators need, read from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.dates import extract_year
from kinweave.functions.names import normalize_name

_MEMBERS = "array<struct<person_id:string>>"


def _ids(path: str):
    """The person ids of a list, in order, repeats kept, others skipped."""
    listed = F.from_json(F.get_json_object("body", path), _MEMBERS)
    return F.filter(F.transform(F.coalesce(listed, F.array().cast(_MEMBERS)), lambda x: x["person_id"]), lambda x: x.isNotNull())


def people(entities: DataFrame) -> DataFrame:
    """(bundle_id, id, name, birth_year, death_year)."""
    return entities.where("collection = 'persons'").select(
        "bundle_id",
        "id",
        normalize_name(F.get_json_object("body", "$.identity.name.display")).alias("name"),
        extract_year(F.get_json_object("body", "$.birth.date.value")).alias("birth_year"),
        extract_year(F.get_json_object("body", "$.death.date.value")).alias("death_year"),
    )


def families(entities: DataFrame) -> DataFrame:
    """(bundle_id, family_id, parents, children, union_type, start_year, parent_set)."""
    return (
        entities.where("collection = 'families'")
        .select(
            "bundle_id",
            F.col("id").alias("family_id"),
            _ids("$.union.persons").alias("parents"),
            _ids("$.children").alias("children"),
            F.get_json_object("body", "$.union.type").alias("union_type"),
            extract_year(F.get_json_object("body", "$.union.start.date.value")).alias("start_year"),
        )
        .withColumn("parent_set", F.sort_array(F.array_distinct("parents")))
    )


def edges(fams: DataFrame) -> DataFrame:
    """(bundle_id, family_id, parent, child), repeats kept as listed."""
    return fams.select("bundle_id", "family_id", "children", F.explode("parents").alias("parent")).select(
        "bundle_id", "family_id", "parent", F.explode("children").alias("child")
    )

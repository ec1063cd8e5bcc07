"""Bundles from typed tables: each row becomes a document with the names that documents use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.bundle import latest
from kinweave.plans.workspace import table


def _renamed(array: str | Column, names: dict[str, str]) -> Column:
    return F.transform(array, lambda x: F.struct(*[x[old].alias(new) for old, new in names.items()]))


_COMPONENT = {"kind": "type", "value": "value", "value_latin": "value_latin", "reading": "reading", "reading_system": "reading_system", "order_num": "order"}


def _body(kind: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.col("id"), F.lit(kind).alias("type"), F.lit("1.0").alias("axgf_version"), *fields)).alias("body")


def entities_from_tables(spark: SparkSession, sf_dir: str, changed: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(bundle_id, collection, id, body) of the latest row of every entity; ``changed`` edits the rows of a table
    before they become documents."""

    def read(name: str) -> DataFrame:
        rows = latest(table(spark, sf_dir, name))
        return changed[name](rows) if changed and name in changed else rows

    name = F.col("identity.name")
    person = _body(
        "person",
        F.struct(
            F.struct(
                *[name[f].alias(f) for f in ("display", "display_latin", "culture", "direction", "display_order", "reading", "reading_system")],
                _renamed("identity.name.components", _COMPONENT).alias("components"),
            ).alias("name"),
            F.transform(
                "identity.names",
                lambda x: F.struct(x["kind"].alias("type"), x["display"].alias("display"), x["culture"].alias("culture"), x["source_id"].alias("source_id"), x["confidence"].alias("confidence"), _renamed(x["components"], _COMPONENT).alias("components")),
            ).alias("names"),
            F.col("identity.gender").alias("gender"),
            F.col("identity.is_living").alias("is_living"),
            F.col("identity.visibility").alias("visibility"),
        ).alias("identity"),
        F.col("birth"),
        F.col("death"),
        F.col("bio"),
    )
    union_block = F.when(
        F.col("union_block").isNotNull(),
        F.struct(
            F.col("union_block.kind").alias("type"), F.col("union_block.status").alias("status"), F.col("union_block.persons").alias("persons"),
            F.col("union_block.start_block").alias("start"), F.col("union_block.confidence").alias("confidence"), F.col("union_block.source_id").alias("source_id"),
        ),
    ).alias("union")
    valid = F.when(F.col("valid_from").isNotNull(), F.struct(F.struct(F.col("valid_from").alias("value")).alias("date"))).alias("valid_from")
    parts = {
        "persons": (read("persons"), person),
        "families": (read("families"), _body("family", F.col("name"), union_block, F.col("children"))),
        "events": (read("vital_events"), _body("event", F.col("category"), F.col("event_date").alias("date"), F.col("place_id"), F.col("source_id"), F.col("participants"), F.col("description"), F.col("confidence"))),
        "links": (read("links"), _body("link", F.col("from_end").alias("from"), F.col("to_end").alias("to"), F.col("label"), F.col("category"), F.col("bidirectional"), F.col("confidence"))),
        "occupations": (read("occupations"), _body("occupation", F.col("person_id"), F.col("title"), F.col("title_latin"), F.col("title_normalized"), F.col("place_id"), F.col("source_id"), valid, F.col("confidence"))),
        "sources": (read("sources"), _body("source", F.col("title"), F.col("source_type"), F.col("reliability"), F.col("confidence"), F.col("status"), F.col("place_id"), F.col("language"))),
        "places": (read("places"), _body("place", F.col("names"), F.col("place_type"), F.col("country_current"), F.col("coordinates"))),
    }
    out = None
    for collection, (df, body) in parts.items():
        part = df.select("bundle_id", F.lit(collection).alias("collection"), "id", body)
        out = part if out is None else out.unionByName(part)
    return out

"""Bundles as tables: many family trees at once, one row an entity, its document kept as text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import rawjson
from kinweave.plans.workspace import Workspace

SUPPORTED_SPEC_VERSIONS = ("1.0",)
CURRENT_SPEC_VERSION = "1.0"
# fixed values: the collections in their canonical order and the kind of entity in each
COLLECTIONS = {
    "persons": "person", "families": "family", "events": "event", "links": "link",
    "occupations": "occupation", "sources": "source", "places": "place", "documents": "document",
}
ENTITY_SCHEMA = "bundle_id string, collection string, id string, body string"
MANIFEST_SCHEMA = "bundle_id string, body string"
DIAGNOSTIC_SCHEMA = "bundle_id string, phase int, seq string, code string, severity string, message string, entity_ref string"


def now_utc() -> str:
    """One literal a call, so all rows of a call carry the same instant."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Bundles:
    entities: DataFrame
    manifests: DataFrame
    attachments: DataFrame | None = None  # (bundle_id, path, content)
    extras: DataFrame | None = None  # (bundle_id, key, value)
    diagnostics: DataFrame | None = None


@dataclass
class Result:
    """What an operation gives: the bundles it accepted and what it has to say."""

    bundles: Bundles | None
    diagnostics: DataFrame
    data: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def no_diagnostics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIAGNOSTIC_SCHEMA)


def create(spark: SparkSession, names: dict[str, str | None]) -> Bundles:
    """Empty bundles: bundle id -> family name or None."""
    at = now_utc()
    rows = []
    for bundle, name in names.items():
        manifest = {"axgf": CURRENT_SPEC_VERSION, "created_at": at, "updated_at": at, "stats": dict.fromkeys(COLLECTIONS, 0)}
        if name is not None:
            manifest["family"] = {"name": name}
        rows.append((bundle, json.dumps(manifest, ensure_ascii=False)))
    return Bundles(spark.createDataFrame([], ENTITY_SCHEMA), spark.createDataFrame(rows, MANIFEST_SCHEMA))


def version_gate(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted manifests, one diagnostic for each refused bundle)."""
    version = F.get_json_object("body", "$.axgf")
    text = F.col("body").rlike(r'"axgf"\s*:\s*"')
    supported = text & version.isin(*SUPPORTED_SPEC_VERSIONS)
    accepted = manifests.where(F.coalesce(supported, F.lit(False)))
    refused = manifests.where(~F.coalesce(supported, F.lit(False))).select(
        "bundle_id",
        F.lit(0).alias("phase"),
        F.lit("").alias("seq"),
        F.when(text & version.isNotNull(), "UNSUPPORTED_SPEC_VERSION").otherwise("INVALID_BUNDLE_STRUCTURE").alias("code"),
        F.lit("error").alias("severity"),
        F.concat(F.lit("spec version "), F.coalesce(version, F.lit("missing"))).alias("message"),
        F.lit(None).cast("string").alias("entity_ref"),
    )
    return accepted, refused


def stats(entities: DataFrame) -> DataFrame:
    """One row a bundle with the number of entities of each collection."""
    return entities.groupBy("bundle_id").pivot("collection", list(COLLECTIONS)).count().na.fill(0)


def refreshed(manifests: DataFrame, entities: DataFrame, at: str | None = None) -> DataFrame:
    """The manifests with fresh counts and the time of the change; everything else in them stays as written."""
    at = at or now_utc()
    counts = stats(entities).select("bundle_id", F.to_json(F.struct(*COLLECTIONS)).alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for body, counted in zip(b["body"], b["counts"], strict=True):
                head = rawjson.parse(body)
                head["stats"] = dict.fromkeys(COLLECTIONS, 0) | (json.loads(counted) if counted else {})
                head["updated_at"] = at
                out.append(rawjson.dump(head))
            yield pd.DataFrame({"bundle_id": b["bundle_id"], "body": out})

    return manifests.join(counts, "bundle_id", "left").select("bundle_id", "body", "counts").mapInPandas(run, MANIFEST_SCHEMA)


def within(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """The rows of bundles that have one of the manifests.  Which bundles have none is found from the ids alone; where
    there is no such bundle, the usual case, the bodies need no exchange."""
    ws = Workspace(rows.sparkSession, "within")
    others, seen = ws.cut_counted(rows.select("bundle_id").distinct().join(manifests.select("bundle_id"), "bundle_id", "left_anti"))
    return rows if not seen["n"] else rows.where("bundle_id is not null").join(others, "bundle_id", "left_anti")


def admitted(bundles: Bundles) -> tuple[Bundles, DataFrame]:
    """The bundles of a supported version, and one diagnostic for each of the others."""
    manifests, refused = version_gate(bundles.manifests)
    kept = lambda df: None if df is None else within(df, manifests)
    return Bundles(kept(bundles.entities), manifests, kept(bundles.attachments), kept(bundles.extras), bundles.diagnostics), refused


def inspect(bundles: Bundles) -> DataFrame:
    """(bundle_id, manifest, counts...): the manifest as it is, the counts fresh."""
    counted = bundles.manifests.select("bundle_id", F.col("body").alias("manifest")).join(
        stats(bundles.entities), "bundle_id", "left"
    )
    return counted.na.fill(0, list(COLLECTIONS))


def union(*parts: DataFrame) -> DataFrame:
    """Entities of several sources as one; of the same id in a bundle the last part's counts."""
    out = None
    for n, p in enumerate(parts):
        p = p.select("bundle_id", "collection", "id", "body", F.lit(n).alias("part"))
        out = p if out is None else out.unionByName(p)
    last = F.max(F.struct("part", "body"))["body"]
    return out.groupBy("bundle_id", "collection", "id").agg(last.alias("body"))


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("bundle_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.count("*").alias("total"),
    )


def diagnostics_by_code(diagnostics: DataFrame) -> DataFrame:
    """(code, n, first_phase, first_seq): counts by code; the listing goes by n down and code, the order in which a
    reader meets the codes by first_phase and first_seq."""
    first = F.min(F.struct("phase", "seq"))
    return diagnostics.groupBy("code").agg(F.count("*").alias("n"), first.alias("f")).select(
        "code", "n", F.col("f.phase").alias("first_phase"), F.col("f.seq").alias("first_seq")
    )


def envelope(diagnostics: DataFrame) -> DataFrame:
    """(bundle_id, envelope): status and diagnostics of each bundle as JSON, in order."""
    one = F.struct("phase", "seq", "code", "severity", "message", "entity_ref")
    listed = diagnostics.groupBy("bundle_id").agg(F.sort_array(F.collect_list(one)).alias("d"), F.max((F.col("phase") == 0).cast("int")).alias("refused"))
    shown = F.transform("d", lambda x: F.struct(x["code"].alias("code"), x["severity"].alias("severity"), x["message"].alias("message"), x["entity_ref"].alias("entity_ref")))
    return listed.select(
        "bundle_id",
        F.to_json(F.struct(F.when(F.col("refused") == 1, "error").otherwise("ok").alias("status"), shown.alias("diagnostics"))).alias("envelope"),
    )


def latest(table: DataFrame) -> DataFrame:
    """Of rows of one (bundle_id, id) the one that was ingested last; ties: the row that is greater by its
    columns in order.  The choice is an aggregate, so copies go before the exchange."""
    best = F.max(F.struct("ingested_at", F.struct(*table.columns).alias("row"))).alias("best")
    return table.where("id is not null and bundle_id is not null").groupBy("bundle_id", "id").agg(best).select("best.row.*")

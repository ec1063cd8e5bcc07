"""Adding, replacing and deleting entities, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import rawjson
from kinweave.functions.ids import uuid_of
from kinweave.operators import refs
from kinweave.operators.bundle import COLLECTIONS, CURRENT_SPEC_VERSION, Bundles, Result, admitted, refreshed
from kinweave.operators.validate import broken_rules
from kinweave.plans.workspace import Workspace

IDENTITY = ["bundle_id", "collection", "id"]


def _readable(requests: DataFrame, defaults: bool) -> DataFrame:
    """requests (bundle_id, collection, body, and seq if there is an order) -> with id and problem; defaults fills
    id, type and version."""
    requests = requests if "seq" in requests.columns else requests.withColumn("seq", F.lit(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for bundle, collection, body, seq in b.itertuples(index=False, name=None):
                try:
                    document = rawjson.parse(body)
                except (ValueError, TypeError):
                    rows.append((bundle, collection, None, body, "INVALID_JSON", seq))
                    continue
                if isinstance(document, dict) and defaults and collection in COLLECTIONS:
                    document.setdefault("id", uuid_of(bundle or "", collection, body))
                    document.setdefault("type", COLLECTIONS[collection])
                    document.setdefault("axgf_version", CURRENT_SPEC_VERSION)
                if not isinstance(document, dict) or not isinstance(document.get("id"), str) or isinstance(document["id"], rawjson.Number):
                    rows.append((bundle, collection, None, body, "INVALID_BUNDLE_STRUCTURE", seq))
                else:
                    rows.append((bundle, collection, document["id"], rawjson.dump(document), None, seq))
            yield pd.DataFrame(rows, columns=[*IDENTITY, "body", "problem", "seq"])

    return requests.select("bundle_id", "collection", "body", F.col("seq").cast("long")).mapInPandas(
        run, "bundle_id string, collection string, id string, body string, problem string, seq long"
    )


def add(entities: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with the new ones, refusals as (bundle_id, collection, id, code)).  An id that exists is
    refused; of several requests for one new id the first by seq, then body, is taken and every other refused."""
    read = _readable(requests, defaults=True)
    fresh = read.where("problem is null").join(entities.select(*IDENTITY), IDENTITY, "left_anti")
    first = fresh.groupBy(*IDENTITY).agg(F.min(F.struct("seq", "body"))["body"].alias("body"), F.count("*").alias("n"))
    taken = first.select(*IDENTITY, "body")
    again = first.where("n > 1").select(*IDENTITY, F.explode(F.sequence(F.lit(2), F.col("n"))))
    exists = read.where("problem is null").join(entities.select(*IDENTITY), IDENTITY, "left_semi")
    refused = read.where("problem is not null").select(*IDENTITY, F.col("problem").alias("code")).unionByName(
        exists.select(*IDENTITY).unionByName(again.select(*IDENTITY)).withColumn("code", F.lit("ENTITY_ALREADY_EXISTS"))
    )
    return entities.unionByName(taken), refused


def update(entities: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with bodies replaced whole, refusals); of several requests for one id the last by seq counts."""
    read = _readable(requests, defaults=False)
    new = read.where("problem is null").groupBy(*IDENTITY).agg(F.max(F.struct("seq", "body"))["body"].alias("new"))
    updated = entities.join(new, IDENTITY, "left").select(*IDENTITY, F.coalesce("new", "body").alias("body"))
    unknown = new.join(entities.select(*IDENTITY), IDENTITY, "left_anti")
    refused = read.where("problem is not null").select(*IDENTITY, F.col("problem").alias("code")).unionByName(
        unknown.select(*IDENTITY, F.lit("ENTITY_NOT_FOUND").alias("code"))
    )
    return updated, refused


def delete(entities: DataFrame, targets: DataFrame, policy: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(entities without the targets, refusals).  reject: targets that others refer to stay and are refused;
    cascade: list items that refer to them go, other references lose their key; orphan: references become
    null.  ``targets`` has (bundle_id, collection, id)."""
    if policy not in ("reject", "cascade", "orphan"):
        raise ValueError(policy)
    wanted = targets.select(*IDENTITY).distinct()
    missing = wanted.join(entities.select(*IDENTITY), IDENTITY, "left_anti").select(*IDENTITY, F.lit("ENTITY_NOT_FOUND").alias("code"))
    found = wanted.join(entities.select(*IDENTITY), IDENTITY, "left_semi")
    held = refs.referrers(entities, found)
    if policy == "reject":
        blocked = found.join(held.select("bundle_id", F.col("target").alias("id")).distinct(), ["bundle_id", "id"], "left_semi").select(*IDENTITY)
        gone = found.join(blocked, IDENTITY, "left_anti")
        refused = missing.unionByName(blocked.withColumn("code", F.lit("DELETE_BLOCKED_BY_REFERENCE")))
        return entities.join(gone, IDENTITY, "left_anti"), refused
    left = entities.join(found, IDENTITY, "left_anti")
    hits = held.groupBy(*IDENTITY).agg(F.collect_set("target").alias("with_"))
    drop = policy == "cascade"
    changed = refs.edited(left.join(hits, IDENTITY), lambda d, w: refs.scrub(d, set(w), drop))
    return left.join(hits, IDENTITY, "left_anti").unionByName(changed), missing


def edit(bundles: Bundles, verb: str, requests: DataFrame, policy: str = "reject") -> Result:
    """Adds, updates or deletes in whole bundles: those of other versions are refused, manifests are refreshed where
    something changed, and what was added or replaced is checked by the rules of its kind (warnings, no refusal).
    ``requests`` as for add, update and delete; data has the refusals."""
    bundles, refused = admitted(bundles)
    ws = Workspace(requests.sparkSession, "edit")
    mine = requests.join(bundles.manifests.select("bundle_id"), "bundle_id", "left_semi")
    if verb == "delete":
        after, problems = delete(bundles.entities, mine, policy)
    elif verb in ("add", "update"):
        after, problems = (add if verb == "add" else update)(bundles.entities, mine)
    else:
        raise ValueError(verb)
    after, problems = ws.cut(after), ws.cut(problems)
    changed = after.join(bundles.entities, [*IDENTITY, "body"], "left_anti")
    gone = bundles.entities.select(*IDENTITY).join(after.select(*IDENTITY), IDENTITY, "left_anti")
    touched = ws.cut(changed.select("bundle_id").unionByName(gone.select("bundle_id")).distinct())
    manifests = refreshed(bundles.manifests.join(touched, "bundle_id", "left_semi"), after)
    notes = problems.select(
        "bundle_id", F.lit(1).alias("phase"), F.concat_ws(" ", "collection", "id").alias("seq"), "code", F.lit("error").alias("severity"),
        F.concat_ws(" ", F.lit(verb), "collection", "id").alias("message"), F.concat(F.col("collection"), F.lit("/"), F.col("id")).alias("entity_ref"),
    )
    if verb != "delete":
        notes = notes.unionByName(broken_rules(changed, 2))
    return Result(
        Bundles(after, manifests.unionByName(bundles.manifests.join(touched, "bundle_id", "left_anti")), bundles.attachments, bundles.extras),
        refused.unionByName(notes), problems,
    )

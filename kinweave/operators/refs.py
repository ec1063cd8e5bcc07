"""References inside documents: finding, following, clearing and rewriting them.

Documents are walked whole, as any key that ends in _id, known or not, at any depth, is a reference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import rawjson
from kinweave.functions.ids import is_uuid_like

REF_SCHEMA = "bundle_id string, collection string, id string, key string, target string, via string"


def _walk(value, key: str | None, direct: bool) -> Iterator[tuple[str, str, str]]:
    """(key, string, via) of each string below a key; 'object' where it is the key's own value."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k != "id":  # an entity's own id and what lies below is no reference
                yield from _walk(v, k, True)
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, key, False)
    elif isinstance(value, str) and not isinstance(value, rawjson.Number) and key and key.endswith("_id"):
        yield key, str(value), "object" if direct else "array"


def references(entities: DataFrame) -> DataFrame:
    """(bundle_id, collection, id, key, target, via) of all references; unreadable bodies have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for bundle, collection, eid, body in b.itertuples(index=False, name=None):
                try:
                    rows += [(bundle, collection, eid, *r) for r in _walk(rawjson.parse(body), None, False)]
                except (ValueError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["bundle_id", "collection", "id", "key", "target", "via"])

    # most bodies of some kinds hold no reference at all: those never leave the JVM
    return (
        entities.where(F.contains("body", F.lit('_id"')))
        .select("bundle_id", "collection", "id", "body")
        .mapInPandas(run, REF_SCHEMA)
    )


def dangling(entities: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Distinct (bundle_id, collection, id, key, target) that look like ids and are no entity's of the bundle."""
    refs = refs if refs is not None else references(entities)
    known = entities.select("bundle_id", F.col("id").alias("target")).distinct()
    return (
        refs.where(is_uuid_like(F.col("target")))
        .select("bundle_id", "collection", "id", "key", "target")
        .join(known, ["bundle_id", "target"], "left_anti")
        .distinct()
    )


def referrers(entities: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (bundle_id, target, collection, id) of the entities that refer to a target by a key of their
    own; a target is no referrer of itself.  ``targets`` has (bundle_id, collection, id)."""
    wanted = targets.select("bundle_id", F.col("collection").alias("target_collection"), F.col("id").alias("target"))
    return (
        references(entities)
        .where("via = 'object'")
        .join(wanted, ["bundle_id", "target"])
        .where("not (collection = target_collection and id = target)")
        .select("bundle_id", "target", "collection", "id")
        .distinct()
    )


def scrub(value, targets: set[str], drop: bool) -> None:
    """Clears the references to targets: drop takes away array items that hold one and the keys, else null."""
    if isinstance(value, dict):
        for k in list(value):
            v = value[k]
            if k.endswith("_id") and isinstance(v, str) and v in targets:
                if drop:
                    del value[k]
                else:
                    value[k] = None
            else:
                scrub(v, targets, drop)
    elif isinstance(value, list):
        if drop:
            value[:] = [
                x for x in value
                if not (isinstance(x, dict) and any(k.endswith("_id") and isinstance(v, str) and v in targets for k, v in x.items()))
            ]
        for x in value:
            scrub(x, targets, drop)


def rewrite(value, new: dict[str, str]) -> None:
    """Puts new ids in place of old ones wherever a key that ends in _id holds one."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k.endswith("_id") and isinstance(v, str) and v in new:
                value[k] = new[v]
            else:
                rewrite(v, new)
    elif isinstance(value, list):
        for x in value:
            rewrite(x, new)


def edited(hits: DataFrame, edit: Callable[[object, list], None]) -> DataFrame:
    """(bundle_id, collection, id, body) with edit(document, with_) applied; hits has body and with_, the
    array of what concerns the document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for body, with_ in zip(b["body"], b["with_"], strict=True):
                document = rawjson.parse(body)
                edit(document, list(with_))
                out.append(rawjson.dump(document))
            yield pd.DataFrame({"bundle_id": b["bundle_id"], "collection": b["collection"], "id": b["id"], "body": out})

    return hits.select("bundle_id", "collection", "id", "body", "with_").mapInPandas(
        run, "bundle_id string, collection string, id string, body string"
    )


"""Conservative merging of persons and families that are recorded twice.

Candidates share a key; a group in which two persons are related, or whose families disagree, is left for a
reader.  Groups are disjoint, so all merge in one pass and all references are rewritten in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import rawjson
from kinweave.operators import refs, typed
from kinweave.operators.bundle import Bundles, Result, admitted, refreshed
from kinweave.plans.workspace import Workspace

KEY = ["bundle_id", "name", "birth_year", "death_year"]


def person_groups(people: DataFrame) -> DataFrame:
    """(bundle_id, name, birth_year, death_year, keeper, ids): persons alike in all three; the smallest id stays."""
    return (
        people.where("name <> '' and birth_year is not null and death_year is not null")
        .groupBy(*KEY)
        .agg(F.min("id").alias("keeper"), F.sort_array(F.collect_set("id")).alias("ids"))
        .where(F.size("ids") > 1)
    )


def _ancestors(edges: DataFrame, start: DataFrame, ws: Workspace) -> DataFrame:
    """(bundle_id, id, ancestor): all ancestors of the starting persons, by rounds over what is new."""
    up = ws.cut(edges.select("bundle_id", F.col("child").alias("at"), F.col("parent").alias("ancestor")).where("at <> ancestor").distinct())
    known, fresh = None, start.select("bundle_id", "id", F.col("id").alias("at"))
    while True:
        found = fresh.join(up, ["bundle_id", "at"]).select("bundle_id", "id", "ancestor").distinct()
        if known is not None:
            found = found.join(known, ["bundle_id", "id", "ancestor"], "left_anti")
        found, seen = ws.cut_counted(found)
        if not seen["n"]:
            return known if known is not None else found
        known = found if known is None else known.unionByName(found)
        fresh = found.select("bundle_id", "id", F.col("ancestor").alias("at"))


def ambiguous_groups(groups: DataFrame, fams: DataFrame) -> DataFrame:
    """The keys of groups in which one is an ancestor of another or two share a parent."""
    ws = Workspace(fams.sparkSession, "dedup")
    edges = typed.edges(fams)
    members = ws.cut(groups.select(*KEY, F.explode("ids").alias("id")))
    over = _ancestors(edges, members.select("bundle_id", "id").distinct(), ws)
    above = over.join(members, ["bundle_id", "id"])
    related = above.join(members.withColumnRenamed("id", "ancestor"), [*KEY, "ancestor"], "left_semi").select(*KEY)
    parents = edges.where("parent <> child").select("bundle_id", F.col("child").alias("id"), "parent").distinct()
    shared = members.join(parents, ["bundle_id", "id"]).groupBy(*KEY, "parent").agg(F.countDistinct("id").alias("n")).where("n > 1").select(*KEY)
    return related.unionByName(shared).distinct()


def keeper_map(groups: DataFrame) -> DataFrame:
    """(bundle_id, old, new) of every person that gives way."""
    return groups.select("bundle_id", F.explode("ids").alias("old"), F.col("keeper").alias("new")).where("old <> new")


def family_groups(fams: DataFrame) -> DataFrame:
    """(bundle_id, parent_set, keeper, ids, ambiguous): families of one set of parents; ambiguous where their
    kinds differ or their years lie more than one apart."""
    return (
        fams.where(F.size("parent_set") > 0)
        .groupBy("bundle_id", "parent_set")
        .agg(
            F.min("family_id").alias("keeper"),
            F.sort_array(F.collect_list("family_id")).alias("ids"),
            ((F.countDistinct("union_type") > 1) | (F.coalesce(F.max("start_year") - F.min("start_year"), F.lit(0)) > 1)).alias("ambiguous"),
        )
        .where(F.size("ids") > 1)
    )


def _fill(keeper: dict, other: dict, skip: tuple[str, ...]) -> None:
    for k, v in other.items():
        if k not in skip and keeper.get(k) is None:
            keeper[k] = v


def fold_person(keeper: dict, other: dict) -> None:
    had = keeper.get("identity")
    _fill(keeper, other, ("id", "identity"))
    mine = (other.get("identity") or {}).get("names") or []
    if isinstance(had, dict) and mine:
        names = had.setdefault("names", []) or []
        had["names"] = names + [x for x in mine if x not in names]


def fold_family(keeper: dict, other: dict) -> None:
    lists = {"children": "person_id", "documents": "document_id"}
    _fill(keeper, other, ("id", *[k for k in lists if keeper.get(k) is not None]))
    for key, ident in lists.items():
        mine, theirs = keeper.get(key), other.get(key)
        if isinstance(mine, list) and isinstance(theirs, list) and mine is not theirs:
            have = {x.get(ident) for x in mine if isinstance(x, dict)}
            mine += [x for x in theirs if isinstance(x, dict) and x.get(ident) and x[ident] not in have]


def _couple_once(family: dict) -> None:
    persons = (family.get("union") or {}).get("persons")
    if isinstance(persons, list):
        seen, kept = set(), []
        for p in persons:
            pid = p.get("person_id") if isinstance(p, dict) else None
            if not pid or pid not in seen:
                kept.append(p)
                seen.add(pid)
        family["union"]["persons"] = kept


def _merge(entities: DataFrame, collection: str, groups: DataFrame, fold, finish=None) -> DataFrame:
    """The entities with each group of a collection folded into its keeper, in order of id."""
    of = groups.select("bundle_id", "keeper", F.explode("ids").alias("id"))
    mine = entities.where(F.col("collection") == collection)
    touched = mine.join(of, ["bundle_id", "id"]).groupBy("bundle_id", "keeper").agg(F.sort_array(F.collect_list(F.struct("id", "body"))).alias("members"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for members in b["members"]:
                documents = [rawjson.parse(m["body"]) for m in members]
                for other in documents[1:]:
                    fold(documents[0], other)
                if finish:
                    finish(documents[0])
                out.append(rawjson.dump(documents[0]))
            yield pd.DataFrame({"bundle_id": b["bundle_id"], "collection": collection, "id": b["keeper"], "body": out})

    merged = touched.mapInPandas(run, "bundle_id string, collection string, id string, body string")
    return entities.join(of.select("bundle_id", "id", F.lit(collection).alias("collection")), ["bundle_id", "collection", "id"], "left_anti").unionByName(merged)


def rewritten(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """The entities with every reference to an old id pointing at the new one; untouched bodies stay as text."""
    hits = (
        refs.references(entities)
        .where("via = 'object'")
        .join(mapping.withColumnRenamed("old", "target"), ["bundle_id", "target"])
        .groupBy("bundle_id", "collection", "id")
        .agg(F.collect_set(F.struct(F.col("target").alias("old"), "new")).alias("with_"))
    )
    changed = refs.edited(
        entities.join(hits, ["bundle_id", "collection", "id"]), lambda d, w: refs.rewrite(d, {x["old"]: x["new"] for x in w})
    )
    return entities.join(hits, ["bundle_id", "collection", "id"], "left_anti").unionByName(changed)


def deduplicate(bundles: Bundles) -> Result:
    """Persons, then families; data has (bundle_id, merged_persons, merged_families, manual_review).  Bundles of
    other versions are refused; the manifests of the others are refreshed."""
    bundles, refused = admitted(bundles)
    ws = Workspace(bundles.entities.sparkSession, "dedup")
    entities = ws.cut(bundles.entities.select("bundle_id", "collection", "id", "body"))
    groups = person_groups(typed.people(entities))
    fams = typed.families(entities)
    unclear = ws.cut(ambiguous_groups(groups, fams))
    clear = ws.cut(groups.join(unclear, KEY, "left_anti"))
    merged = _merge(entities, "persons", clear, fold_person)
    merged = ws.cut(rewritten(merged, keeper_map(clear)))
    couples = ws.cut(family_groups(typed.families(merged)))
    sure = couples.where("not ambiguous")
    final = _merge(merged, "families", sure, fold_family, _couple_once)
    final = ws.cut(rewritten(final, sure.select("bundle_id", F.explode("ids").alias("old"), F.col("keeper").alias("new")).where("old <> new")))
    counted = lambda df, name: df.groupBy("bundle_id").agg(F.sum("k").cast("long").alias(name))
    review = unclear.select("bundle_id", F.lit(1).alias("k")).unionByName(couples.where("ambiguous").select("bundle_id", F.lit(1).alias("k")))
    data = bundles.manifests.select("bundle_id")
    for df, name in (
        (clear.select("bundle_id", (F.size("ids") - 1).alias("k")), "merged_persons"),
        (sure.select("bundle_id", (F.size("ids") - 1).alias("k")), "merged_families"),
        (review, "manual_review"),
    ):
        data = data.join(counted(df, name), "bundle_id", "left")
    notes = unclear.select(
        "bundle_id", F.lit(1).alias("phase"), F.concat_ws(" ", "name", "birth_year", "death_year").alias("seq"), F.lit("MANUAL_REVIEW_REQUIRED").alias("code"),
        F.lit("warning").alias("severity"), F.concat(F.lit("related persons named "), "name").alias("message"), F.lit(None).cast("string").alias("entity_ref"),
    ).unionByName(
        couples.where("ambiguous").select(
            "bundle_id", F.lit(2).alias("phase"), F.array_join("parent_set", " ").alias("seq"), F.lit("MANUAL_REVIEW_REQUIRED").alias("code"),
            F.lit("warning").alias("severity"), F.concat(F.lit("families disagree: "), F.array_join("ids", ", ")).alias("message"),
            F.concat(F.lit("families/"), "keeper").alias("entity_ref"),
        )
    )
    return Result(Bundles(final, refreshed(bundles.manifests, final), bundles.attachments, bundles.extras), refused.unionByName(notes), data.na.fill(0))

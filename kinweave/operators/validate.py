"""Validation: structure, dangling references, ancestor loops, chronology, repeated couples.

Findings come as one table; phase and seq give the order in which a reader meets them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import refs, typed
from kinweave.operators.bundle import Bundles, version_gate, within
from kinweave.operators.hierarchy import _Contraction


def _finding(df: DataFrame, phase: int, code: str, severity: str, message, entity_ref, seq) -> DataFrame:
    return df.select(
        "bundle_id",
        F.lit(phase).alias("phase"),
        seq.alias("seq"),
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        entity_ref.alias("entity_ref"),
    )


def self_parents(fams: DataFrame) -> DataFrame:
    """(bundle_id, family_id, person_id): one row for each time a person is their own parent in a family."""
    return typed.edges(fams).where("parent = child").select("bundle_id", "family_id", F.col("child").alias("person_id"))


def chronology(fams: DataFrame, people: DataFrame) -> DataFrame:
    """(bundle_id, family_id, parent, child, parent_year, child_year) where the child's birth year is before
    the parent's; repeats in a family's lists are reported as often as they are listed."""
    born = people.where("birth_year is not null").select("bundle_id", "id", "birth_year")
    return (
        typed.edges(fams)
        .join(born.select("bundle_id", F.col("id").alias("parent"), F.col("birth_year").alias("parent_year")), ["bundle_id", "parent"])
        .join(born.select("bundle_id", F.col("id").alias("child"), F.col("birth_year").alias("child_year")), ["bundle_id", "child"])
        .where("child_year < parent_year")
        .select("bundle_id", "family_id", "parent", "child", "parent_year", "child_year")
    )


def repeated_couples(fams: DataFrame) -> DataFrame:
    """(bundle_id, parent_set, family_ids): sets of parents with several families."""
    return (
        fams.where(F.size("parent_set") > 0)
        .groupBy("bundle_id", "parent_set")
        .agg(F.sort_array(F.collect_list("family_id")).alias("family_ids"))
        .where(F.size("family_ids") > 1)
    )


def _back_edges(children: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    """Every edge that closes a loop when nodes and children are visited in ascending order."""
    state: dict[str, int] = {}
    found = []
    for start in sorted(children):
        if state.get(start):
            continue
        state[start] = 1
        stack = [(start, iter(children.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                seen = state.get(child, 0)
                if seen == 1:
                    found.append((len(found), node, child))
                elif not seen:
                    state[child] = 1
                    stack.append((child, iter(children.get(child, ()))))
                    break
            else:
                state[node] = 2
                stack.pop()
    return found


def loop_edges(fams: DataFrame) -> DataFrame:
    """(bundle_id, seq, parent, child): the links that close ancestor loops, self-parents apart.

    Contraction finds the persons with a loop below them, in few rounds of set operations; that part of a bundle
    alone goes to one ordered walk, which decides as any reader of the tree would."""
    links = typed.edges(fams).where("parent <> child").select("bundle_id", "parent", "child").distinct()
    key = lambda c: F.concat_ws("\u0001", "bundle_id", c)
    state = _Contraction(fams.sparkSession, links.select(key("child").alias("child"), key("parent").alias("parent")))
    state.contract()
    part = lambda c, i: F.split(c, "\u0001")[i]
    # a person is left if a loop lies below; links of founders to them matter too, as walks begin there
    left = state.above_loops().select(part("person", 0).alias("bundle_id"), part("person", 1).alias("child"))
    core = links.join(left, ["bundle_id", "child"], "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        children = defaultdict(list)
        for p, c in sorted(zip(pdf["parent"], pdf["child"], strict=True)):
            children[p].append(c)
        rows = [(pdf["bundle_id"].iloc[0], *x) for x in _back_edges(children)]
        return pd.DataFrame(rows, columns=["bundle_id", "seq", "parent", "child"])

    return core.groupBy("bundle_id").applyInPandas(walk, "bundle_id string, seq int, parent string, child string")


def structural(entities: DataFrame) -> DataFrame:
    """(bundle_id, collection, id, path, problem) of every document that breaks its kind's rules."""
    from kinweave.operators import schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (bundle, collection, eid, path, problem)
                for bundle, collection, eid, body in b.itertuples(index=False, name=None)
                for path, problem in schema.problems(collection, body)
            ]
            yield pd.DataFrame(rows, columns=["bundle_id", "collection", "id", "path", "problem"])

    return entities.select("bundle_id", "collection", "id", "body").mapInPandas(
        run, "bundle_id string, collection string, id string, path string, problem string"
    )


def broken_rules(entities: DataFrame, phase: int = 1) -> DataFrame:
    """The structural findings as diagnostics."""
    own = F.concat_ws("/", "collection", "id")
    seq = F.concat_ws(" ", "collection", "id", "path")
    return _finding(structural(entities), phase, "SCHEMA_VALIDATION_FAILED", "warning", F.concat_ws(": ", "collection", "path", "problem"), own, seq)


def broken_manifests(manifests: DataFrame) -> DataFrame:
    """The structural findings of manifests; they have no entity and come first."""
    heads = manifests.select("bundle_id", F.lit("manifest").alias("collection"), F.lit("").alias("id"), "body")
    return _finding(structural(heads), 1, "SCHEMA_VALIDATION_FAILED", "warning", F.concat_ws(": ", F.lit("manifest"), "path", "problem"), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("path")))


def validate(bundles: Bundles) -> DataFrame:
    """All diagnostics of all bundles; refused bundles have their one."""
    accepted, refused = version_gate(bundles.manifests)
    entities = within(bundles.entities, accepted)
    fams, people = typed.families(entities), typed.people(entities)
    ref = lambda collection, c: F.concat(F.lit(collection + "/"), c)
    own = F.concat_ws("/", "collection", "id")
    text = lambda s: F.lit(s)
    parts = [
        refused,
        broken_manifests(accepted),
        broken_rules(entities),
        _finding(refs.dangling(entities), 2, "DANGLING_REFERENCE", "warning", F.concat_ws(" ", "key", "target"), own, F.concat_ws(" ", "collection", "id", "key", "target")),
        _finding(self_parents(fams), 3, "CYCLE_DETECTED", "error", F.concat(text("own parent in "), "family_id"), ref("persons", F.col("person_id")), F.concat(text("0 "), "family_id")),
        _finding(loop_edges(fams), 3, "CYCLE_DETECTED", "error", F.concat(text("loop through "), "parent"), ref("persons", F.col("child")), F.format_string("1 %09d", "seq")),
        _finding(chronology(fams, people), 4, "CHRONOLOGY_CONFLICT", "warning", F.concat(text("born before "), "parent"), ref("persons", F.col("child")), F.concat_ws(" ", "family_id", "parent", "child")),
        _finding(repeated_couples(fams), 5, "DUPLICATE_UNIQUE_REF", "warning", F.concat_ws(", ", "family_ids"), ref("families", F.col("family_ids")[0]), F.array_join("parent_set", " ")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

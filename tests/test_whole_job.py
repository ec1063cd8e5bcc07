import random
from collections import Counter
from datetime import datetime

import pytest

from kinweave import bundle_queries
from kinweave.operators import hierarchy, schema, validate

NAMES = ("persons", "families", "vital_events", "links", "occupations", "sources", "places")


def uid(n):
    return f"550e8400-e29b-41d4-a716-4466554400{n:02d}"


@pytest.fixture
def folder(tables, tmp_path):
    def write(**rows):
        for name in NAMES:
            given = [{"bundle_id": "b", **r} for r in rows.get(name, ())]
            tables(name, given).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def person(n, birth=None):
    return {"id": uid(n), "identity": {"name": {"display": f"P {n}", "components": []}, "gender": {"value": "U"}, "is_living": False}, "birth": birth}


def family(n, parents, children):
    return {"id": uid(n), "union_block": {"kind": "marriage", "persons": [{"person_id": uid(p), "role": "spouse"} for p in parents]}, "children": [{"person_id": uid(c)} for c in children]}


def test_counts_of_all_diagnostics(spark, folder):
    links = [((1,), (2,)), ((2,), (3,)), ((3,), (1,)), ((4,), (4,)), ((5, 6), (1,)), ((6, 5), (2,))]
    d = folder(
        persons=[person(n) for n in range(1, 7)] + [{"id": uid(7)}, {**person(8, {"place_id": uid(99)}), "bundle_id": "c"}],
        families=[family(20 + i, *x) for i, x in enumerate(links)],
    )
    want, children = Counter(), {}
    for r in bundle_queries._entities(spark, d).collect():
        want["SCHEMA_VALIDATION_FAILED", r.bundle_id] += len(schema.problems(r.collection, r.body))
    for parents, kids in links:
        for p in parents:
            children.setdefault(uid(p), []).extend(uid(k) for k in kids if k != p)
    want["CYCLE_DETECTED", "b"] = 1 + len(validate._back_edges({k: sorted(set(v)) for k, v in children.items()}))
    want["DUPLICATE_UNIQUE_REF", "b"] = want["DANGLING_REFERENCE", "c"] = 1
    assert want["SCHEMA_VALIDATION_FAILED", "b"] > 0 and want["CYCLE_DETECTED", "b"] == 2
    codes = Counter()
    for (code, _), n in want.items():
        codes[code] += n
    assert {r.code: r.n for r in bundle_queries.diagnostics_by_code(spark, d).collect()} == +codes
    errors = lambda b: want["CYCLE_DETECTED", b]
    total = lambda b: sum(n for (_, x), n in want.items() if x == b)
    got = {tuple(r) for r in bundle_queries.severity_counts(spark, d).collect()}
    assert got == {(b, errors(b), total(b) - errors(b), 0, total(b)) for b in "bc"}


def _climb(edges, person):
    """{ancestor: fewest steps} by plain walking."""
    parents, steps, seen, front = {}, 0, {}, {person}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    while front:
        steps += 1
        front = {p for c in front for p in parents.get(c, ())} - set(seen)
        seen |= dict.fromkeys(front, steps)
    return seen


def test_paths_and_descendants_of_everyone(spark):
    rng = random.Random(9)
    edges = [(f"n{i + 1}", f"n{i}") for i in range(21)] + [(f"n{i + 1}", f"s{i}") for i in range(0, 21, 4)] + [("n9", "n3"), ("self", "self")]
    for g in range(12):
        n = rng.randint(2, 9)
        edges += [(f"g{g}-{rng.randrange(n)}", f"g{g}-{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))]
    links = spark.createDataFrame(edges, "child string, parent string")
    people = {x for e in edges for x in e}
    far = {(a, p, n) for p in people for a, n in _climb(edges, p).items()}
    assert {tuple(r) for r in hierarchy.all_descendants(spark, links).collect()} == far
    founders = people - {c for c, _ in edges}
    rows = hierarchy.lines_with_paths(spark, links).collect()
    assert len(rows) == len({(r.person_id, r.root_id) for r in rows})
    lines = [r for r in rows if r.root_id != hierarchy.CYCLE]
    assert {(r.root_id, r.person_id, r.steps) for r in lines} == {x for x in far if x[0] in founders}
    for r in lines:
        assert r.path[0] == r.person_id and r.path[-1] == r.root_id and len(r.path) == r.steps + 1
        assert set(zip(r.path, r.path[1:])) <= set(edges)
    assert all(r.path is None and r.steps is None for r in rows if r.root_id == hierarchy.CYCLE)


def test_deleting_and_joining_reach_every_collection(spark, folder):
    at = datetime(2026, 1, 1)
    p, x = uid(50), uid(1)
    d = folder(
        places=[{"id": p, "deleted_at": at}, {"id": uid(51)}],
        persons=[{"id": x, "deleted_at": at, "birth": {"place_id": p}}, {"id": uid(2), "birth": {"place_id": p}, "death": {"place_id": p}}],
        families=[{"id": uid(3), "union_block": {"persons": [{"person_id": x}, {"person_id": uid(2)}], "start_block": {"place_id": p}}, "children": [{"person_id": x}]}],
        vital_events=[{"id": uid(4), "place_id": p, "participants": [{"entity_id": x}, {"entity_id": uid(2)}]}],
        links=[{"id": uid(5), "from_end": {"entity_id": x}, "to_end": {"entity_id": uid(2)}}],
        occupations=[{"id": uid(6), "person_id": x, "place_id": p}, {"id": uid(7), "place_id": uid(51)}],
        sources=[{"id": uid(8), "place_id": p}],
    )
    row = lambda c, n, key, target, times=1: ("b", c, uid(n), key, target, times)
    assert {tuple(r) for r in bundle_queries.delete_orphan_changes(spark, d).collect()} == {
        row("persons", 1, "place_id", p), row("persons", 2, "place_id", p, 2), row("families", 3, "place_id", p),
        row("events", 4, "place_id", p), row("occupations", 6, "place_id", p), row("sources", 8, "place_id", p),
    }
    assert {tuple(r) for r in bundle_queries.delete_cascade_changes(spark, d).collect()} == {
        row("families", 3, "person_id", x, 2), row("events", 4, "entity_id", x), row("links", 5, "entity_id", x), row("occupations", 6, "person_id", x),
    }
    both = bundle_queries.bundle_union(spark, d).collect()
    assert Counter(r.collection for r in both) == {"places": 2, "persons": 2, "families": 1, "events": 1, "links": 1, "occupations": 2, "sources": 1}
    assert all(r.replaced == (r.id[-1] < "8") for r in both)

import random

from pyspark.sql import functions as F

from kinweave.operators.hierarchy import CYCLE, _Contraction, descendants, lines_of_descent, parent_links


def brute(edges):
    parents, children = {}, {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
        children.setdefault(p, set()).add(c)
    found = set()
    for root in set(children) - set(parents):
        front, steps, seen = {root}, 0, {}
        while front:
            steps += 1
            front = {c for p in front for c in children.get(p, ()) if c not in seen}
            seen |= dict.fromkeys(front, steps)
        found |= {(n, root, k) for n, k in seen.items()}
    for n in parents:
        front, seen = {n}, set()
        while front:
            front = {p for c in front for p in parents.get(c, ())} - seen
            seen |= front
        if n in seen:
            found.add((n, CYCLE, None))
    return found


def run(spark, edges):
    df = spark.createDataFrame(edges, "child string, parent string")
    return {tuple(r) for r in lines_of_descent(spark, df).collect()}


def test_tree_chain_and_loops(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(40)]  # a long chain
    edges += [(f"n{i + 1}", f"s{i}") for i in range(0, 40, 3)]  # with spouses of no known parents
    edges += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "top"), ("self", "self"), ("kid", "self"), ("c", "n40")]
    edges += edges[:5]  # repeated
    assert run(spark, edges) == brute(edges)


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = []
    for g in range(25):
        n = rng.randint(2, 12)
        edges += [(f"g{g}-{rng.randrange(n)}", f"g{g}-{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))]
    assert run(spark, edges) == brute(edges)


def test_hot_parent(spark):
    edges = [(f"c{i}", "hub") for i in range(500)] + [("hub", "r1"), ("hub", "r2")]
    got = run(spark, edges)
    assert len(got) == 1002 and got == brute(edges)


def test_nulls_and_empty_tables(spark, tables, clash):
    families = tables("families", [
        {"id": "f1", "union_block": {"persons": [{"person_id": "p"}, {"person_id": None}, {"person_id": ""}]}, "children": [{"person_id": "c"}, {"person_id": None}]},
        {"id": "f2", "children": [{"person_id": "c"}]}, {"id": None, "union_block": {"persons": []}, "children": []},
    ])
    events = tables("vital_events", [
        {"id": "e", "participants": [{"entity_id": "m", "role": "mother"}, {"entity_id": "g", "role": "godparent"}, {"entity_id": None, "role": "father"}]},
        {"id": None, "participants": [{"entity_id": "x", "role": "father"}]},
    ])
    persons = tables("persons", [{"id": "c", "birth": {"event_id": "e"}}, {"id": "c", "birth": {"event_id": "e"}}, {"id": None, "birth": {"event_id": "e"}}, {"id": "d"}])
    links = parent_links(clash(families, "parent", "child", "kids"), clash(events, "event", "parent"), clash(persons, "child", "event"))
    got = {tuple(r) for r in lines_of_descent(spark, links).select("person_id", "root_id").collect()}
    assert got == {("c", "p"), ("c", "m")}
    none = parent_links(tables("families"), tables("vital_events"), tables("persons"))
    assert lines_of_descent(spark, none).count() == 0


def test_descendants(spark):
    df = lines_of_descent(spark, spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string"))
    assert [tuple(r) for r in descendants(df).collect()] == [("a", 2, 2)]
    assert df.where(F.col("root_id") == CYCLE).count() == 0


def test_rounds_grow_with_the_logarithm(spark):
    # every generation of two has both of the one before as parents; a chain would shrink faster
    ladder = [(f"{g}-{i}", f"{g + 1}-{j}") for g in range(80) for i in range(2) for j in range(2)]
    state = _Contraction(spark, spark.createDataFrame(ladder, "child string, parent string"))
    state.contract()
    assert len(state.rounds) < 40
    got = {tuple(r) for r in state.founders().collect()}
    assert got == {(f"{g}-{i}", f"80-{j}", 80 - g) for g in range(80) for i in range(2) for j in range(2)}
    assert state.cyclic().count() == 0


def test_a_large_loop_gives_no_pairs(spark):
    loop = [(f"n{i}", f"n{(i + 1) % 400}") for i in range(400)] + [("n7", "founder"), ("below", "n3")]
    state = _Contraction(spark, spark.createDataFrame(loop, "child string, parent string"))
    state.contract()
    assert len(state.rounds) < 30
    assert {r.person for r in state.cyclic().collect()} == {f"n{i}" for i in range(400)}
    assert {r.person for r in state.above_loops().collect()} == {f"n{i}" for i in range(400)}
    assert state.founders().count() == 401
    assert max(r.roots.count() for r in state.rounds) <= 401


def test_dense_knot_of_loops(spark):
    rng = random.Random(9)
    edges = list({(f"k{rng.randrange(30)}", f"k{rng.randrange(30)}") for _ in range(300)}) + [("k1", "top"), ("leaf", "k2")]
    assert run(spark, edges) == brute(edges)

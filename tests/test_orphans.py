from datetime import datetime

from pyspark.sql import functions as F

from kinweave.operators.orphans import as_of_runs, faulty_references, key_runs, parent_keys, references

T = [datetime(2025, m, 1) for m in range(1, 13)]


def test_reasons(tables, clash):
    persons = tables("persons", [
        {"id": "A ", "ingested_at": T[3], "birth": {"place_id": " P1", "source_id": "gone"}, "death": {"place_id": "late", "source_id": " "}},
        {"id": "a", "ingested_at": T[2], "birth": {"place_id": "p1"}, "death": {"place_id": "LATE"}},
        {"id": "b", "ingested_at": T[1], "birth": {"place_id": "dead"}},
        {"id": None, "birth": None},
    ])
    places = tables("places", [
        {"id": "p1", "ingested_at": T[0]}, {"id": "dead", "deleted_at": T[5], "ingested_at": T[0]}, {"id": "dead", "deleted_at": T[6], "ingested_at": T[0]},
        {"id": "late", "ingested_at": T[5]}, {"id": None},
    ])
    links = tables("links", [
        {"id": "l", "ingested_at": T[4], "from_end": {"entity_type": "family", "entity_id": "f"}, "to_end": {"entity_type": "planet", "entity_id": "x"}},
        {"id": "m", "ingested_at": T[4], "from_end": None, "to_end": {"entity_type": "person", "entity_id": "A"}},
    ])
    occupations = tables("occupations", [{"id": "o", "person_id": "nobody", "ingested_at": None}])
    refs = references(clash(persons, "at", "target_id", "alive"), occupations, clash(links, "r", "born"))
    targets = {"persons": persons, "places": clash(places, "alive", "pos"), "sources": tables("sources"), "families": tables("families"), "vital_events": tables("vital_events")}
    got = {tuple(r) for r in faulty_references(refs, parent_keys(targets)).collect()}
    assert got == {
        ("persons", "A ", "birth.source_id", "gone", "missing", "2025-04"),
        ("persons", "A ", "death.place_id", "late", "late", "2025-04"),
        ("persons", "a", "death.place_id", "late", "late", "2025-03"),
        ("persons", "b", "birth.place_id", "dead", "deleted", "2025-02"),
        ("links", "l", "from_end.entity_id", "f", "missing", "2025-05"),
        ("occupations", "o", "person_id", "nobody", "missing", None),
    }
    empty = {n: tables(n) for n in targets}
    assert faulty_references(references(tables("persons"), tables("occupations"), tables("links")), parent_keys(empty)).count() == 0


def test_runs_are_rows_of_neighbouring_parents(spark):
    codes = spark.range(1, 1001).select((F.col("id") % 3).cast("int").alias("bucket"), (F.col("id") / 3).cast("int").alias("code"))
    held = codes.where("code % 7 <> 3").select("bucket", "code", (F.col("code") % 11 != 5).alias("alive"), F.lit(T[0]).alias("born"))
    runs = key_runs(held)
    n = runs.count()
    assert 3 * 330 / 7 < n < held.count() / 2  # several keys a run
    covered = runs.select("bucket", F.explode(F.sequence("first", "last")).alias("code"), "alive")
    key = ["bucket", "code", "alive"]
    assert covered.count() == held.count() and covered.exceptAll(held.select(*key)).count() == 0
    got = as_of_runs(codes.withColumn("asked", F.lit(T[1])), runs)
    beyond = F.col("run").isNull() | (F.col("code") > F.col("run.last"))
    assert got.where(beyond != (F.col("code") % 7 == 3)).count() == 0

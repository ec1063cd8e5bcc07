import json
from datetime import datetime

from kinweave.__main__ import format_size, main
from kinweave.functions.register import register
from kinweave.streaming import ingest


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("""SELECT schema_problems('links', '{}') AS p, scrub_refs('{"a_id":"x","n":1.0}', 'x', false) AS s,
        rewrite_refs('{"a_id":"x"}', 'x', 'y') AS r, walk_refs('{"a_id":"x"}') AS w""").first()  # fmt: skip
    assert "/label: required" in row.p and row.s == '{"a_id":null,"n":1.0}' and row.r == '{"a_id":"y"}'
    assert [tuple(x) for x in row.w] == [("a_id", "x", "object")]


def test_command_line(spark, tmp_path, capsys):
    bundle = {"manifest": {"axgf": "1.0", "created_at": "2026", "stats": {"persons": 1}}, "persons": {"p": {"id": "p"}}, "families": {"f": {"union": {"type": "marriage", "persons": [{"person_id": "p", "role": "x"}]}, "children": [{"person_id": "p"}]}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(bundle))
    assert main(["inspect", str(tmp_path / "in")]) == 0 and '"persons":1' in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "in")]) == 2 and "CYCLE_DETECTED" in capsys.readouterr().out
    one, two, e = str(tmp_path / "one.json"), str(tmp_path / "two.axgf"), tmp_path / "e.json"
    args = ["delete", "person", str(tmp_path / "in" / "a.json"), "--id", "p"]
    assert main([*args, "-o", one]) == 1 and not (tmp_path / "one.json").exists()
    assert main([*args, "-o", one, "--policy", "cascade"]) == 0
    made = json.loads((tmp_path / "one.json").read_text())
    assert made["persons"] == {} and made["manifest"]["stats"]["persons"] == 0 and made["manifest"]["updated_at"]
    e.write_text(json.dumps({"id": "q", "type": "person"}))
    capsys.readouterr()
    assert main(["add", "person", one, "--data", str(e), "--json"]) == 0  # in place
    assert "SCHEMA_VALIDATION_FAILED" in json.loads(capsys.readouterr().out)["diagnostics"][0]["code"]
    assert json.loads((tmp_path / "one.json").read_text())["manifest"]["stats"]["persons"] == 1
    assert main(["add", "person", one, "--data", str(e), "-q"]) == 1 and main(["update", "person", one, "--data", str(e), "-q"]) == 0
    capsys.readouterr()
    assert main(["dedup", str(tmp_path / "in"), "-o", str(tmp_path / "z")]) == 0 and (tmp_path / "z" / "a.axgf").exists()
    assert main(["export", one, "-o", two]) == 0 and "two.axgf" in capsys.readouterr().out
    assert main(["import", two, "-q"]) == 0 and capsys.readouterr().out == ""
    assert main(["create", "--name", "Nowak", "-o", one]) == 0 and json.loads((tmp_path / "one.json").read_text())["manifest"]["family"] == {"name": "Nowak"}
    (tmp_path / "g.ged").write_text("0 @I1@ INDI\n1 NAME A /B/\n0 TRLR\n")
    assert main(["convert-gedcom", str(tmp_path / "g.ged"), "-o", one]) == 0
    head = json.loads((tmp_path / "one.json").read_text())["manifest"]
    assert head["stats"]["persons"] == 1 and head["compatibility"] == {"gedcom_source": "5.5.1"}


def test_sizes():
    assert [format_size(n) for n in (0, 1023, 1024, 5000, 3 << 19, 12 << 20)] == ["0 B", "1023 B", "1 KiB", "4 KiB", "1.5 MiB", "12 MiB"]


def test_streams(spark, tmp_path):
    rows = [(i, "s", datetime(2025, 1, 1 + i % 3)) for i in range(9)]
    spark.createDataFrame(rows, "id long, source string, ingested_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, source string, ingested_at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.arrivals(stream, "source").writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("arrived").collect()) == [3, 3, 3]
    got = []
    q = ingest.upsert(stream, ["source"], lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(r.source, r.ingested_at.day) for r in got] == [("s", 3)]

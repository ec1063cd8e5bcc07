"""python -m kinweave VERB ...: the bundle operations on files.

create --name NAME -o FILE | import PATH | export PATH -o OUT | inspect PATH | validate PATH
| add KIND PATH --data FILE [-o OUT] | update KIND PATH --data FILE [-o OUT]
| delete KIND PATH --id ID [--policy reject|cascade|orphan] [-o OUT] | dedup PATH [-o OUT]
| convert-gedcom PATH -o OUT [--confidence C] [--place-lang L]

PATH is a bundle or a folder with any number of them.  OUT is a file (.axgf or .json) for one bundle, else a folder
with one archive a bundle; without OUT the edits replace the file that was read.  - as PATH or FILE reads the
standard input.  --json prints the envelopes and nothing else, -q nothing at all.  Exit code 2: validate found an
error; 1: something was refused or could not be read.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import bundle, crud, dedup, gedcom, validate
from kinweave.operators.bundle import Bundles
from kinweave.plans.workspace import Workspace
from kinweave.sources.bundles import archives, flat_bundles, read_bundles, read_gedcom

KINDS = {kind: collection for collection, kind in bundle.COLLECTIONS.items()}


def format_size(n: int) -> str:
    """Bytes, whole KiB below a MiB, else MiB with one decimal below ten."""
    for least, unit in ((1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= least:
            return f"{n / least:.{int(unit == 'MiB' and n < 10 * least)}f} {unit}" if unit == "MiB" else f"{n // least} {unit}"
    return f"{n} B"


def _write(path: Path, content: bytes) -> None:
    """All or nothing: written beside the target, then moved there."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


class _Output:
    def __init__(self, a: argparse.Namespace):
        self.json, self.quiet = a.json, a.quiet

    def say(self, text: str) -> None:
        if not (self.json or self.quiet):
            print(text)

    def rows(self, df: DataFrame) -> None:
        if not (self.json or self.quiet):
            for line in df.toJSON().toLocalIterator():
                print(line)

    def diagnostics(self, found: DataFrame, listed: bool = False) -> None:
        """Envelopes as they are, else each finding or the counts by code."""
        if self.json:
            for r in bundle.envelope(found).orderBy("bundle_id").toLocalIterator():
                print(json.dumps({"bundle": r.bundle_id} | json.loads(r.envelope), ensure_ascii=False))
        elif listed:
            self.rows(found.orderBy("bundle_id", "phase", "seq"))
        elif not self.quiet:
            for r in bundle.diagnostics_by_code(found).orderBy(F.desc("n"), "code").collect():
                print(f"  {r.code}   {r.n}", file=sys.stderr)

    def bundles(self, made: Bundles, target: str) -> None:
        """One file if the target has the ending of one, else a folder; bundles are fetched one at a time."""
        single = target.lower().endswith((".axgf", ".json"))
        flat = target.lower().endswith(".json")
        rows = (flat_bundles if flat else archives)(made).toLocalIterator()
        for n, r in enumerate(rows):
            if single and n:
                raise SystemExit("several bundles need a folder")
            path = Path(target) if single else Path(target, f"{r.bundle_id}.axgf")
            content = r.json.encode() if flat else bytes(r.content)
            _write(path, content)
            self.say(f"{path} {format_size(len(content))}")


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--json", action="store_true")
    common.add_argument("-q", "--quiet", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    made = {}
    for verb in ("create", "import", "export", "inspect", "validate", "add", "update", "delete", "dedup", "convert-gedcom"):
        v = made[verb] = verbs.add_parser(verb, parents=[common])
        if verb in ("add", "update", "delete"):
            v.add_argument("kind", choices=list(KINDS))
        if verb != "create":
            v.add_argument("path")
        if verb not in ("import", "inspect", "validate"):
            v.add_argument("-o", "--output", required=verb in ("create", "export", "convert-gedcom"))
    made["create"].add_argument("--name", "--family-name", dest="name")
    for verb in ("add", "update"):
        made[verb].add_argument("--data", "--entity", dest="data", required=True)
    made["delete"].add_argument("--id", required=True)
    made["delete"].add_argument("--policy", default="reject", choices=["reject", "cascade", "orphan"])
    made["convert-gedcom"].add_argument("--confidence", type=float, default=0.8)
    made["convert-gedcom"].add_argument("--place-lang", default="en")
    return p.parse_args(argv)


def _from_input(path: str, ending: str, folder: str) -> str:
    if path != "-":
        return path
    target = Path(folder, "input" + ending)
    target.write_bytes(sys.stdin.buffer.read())
    return str(target)


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    spark = SparkSession.builder.appName("kinweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = _Output(a)
    if a.verb == "create":
        out.bundles(bundle.create(spark, {"bundle": a.name}), a.output)
        return 0
    with tempfile.TemporaryDirectory() as folder:
        if a.verb == "convert-gedcom":
            made = gedcom.converted(read_gedcom(spark, _from_input(a.path, ".ged", folder)), a.confidence, a.place_lang)
            out.bundles(made, a.output)
            out.rows(made.diagnostics)
            return 0
        source = _from_input(a.path, ".axgf" if a.verb == "import" else ".json", folder)
        return _on_bundles(a, read_bundles(spark, source), source, out)


def _on_bundles(a: argparse.Namespace, read: Bundles, source: str, out: _Output) -> int:
    unreadable = not read.diagnostics.isEmpty()
    if unreadable:
        out.diagnostics(read.diagnostics)
    if a.verb == "import":
        if not out.quiet:
            for r in flat_bundles(read).toLocalIterator():
                print(r.json)
        return int(unreadable)
    if a.verb == "inspect":
        shown = bundle.inspect(read)
        if out.json:
            for line in shown.toJSON().toLocalIterator():
                print(line)
        out.rows(shown)
        return int(unreadable)
    if a.verb == "validate":
        found = validate.validate(read)
        out.diagnostics(found, listed=True)
        return 2 if unreadable or not found.where("severity = 'error'").isEmpty() else 0
    target = a.output or a.path
    if target == "-":
        raise SystemExit("-o is needed")
    if a.verb == "export":
        out.bundles(read, target)
        return int(unreadable)
    if a.verb == "dedup":
        result = dedup.deduplicate(read)
        out.bundles(result.bundles, target)
        out.rows(result.data)
        out.diagnostics(result.diagnostics)
        return int(unreadable)
    spark = read.entities.sparkSession
    collection = KINDS[a.kind]
    every = read.manifests.select("bundle_id", F.lit(collection).alias("collection"))
    if a.verb == "delete":
        requests = every.withColumn("id", F.lit(a.id))
    else:
        body = sys.stdin.read() if a.data == "-" else Path(a.data).read_text(encoding="utf-8")
        requests = every.withColumn("body", F.lit(body))
    result = crud.edit(read, a.verb, requests, getattr(a, "policy", "reject"))
    found = Workspace(spark, "cli").cut(result.diagnostics)
    out.diagnostics(found, listed=True)
    refused = not found.where("severity = 'error'").isEmpty()
    if not refused:
        out.bundles(result.bundles, target)
    return int(refused or unreadable)


if __name__ == "__main__":
    sys.exit(main())

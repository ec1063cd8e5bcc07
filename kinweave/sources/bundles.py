"""Bundles from and to files: zipped archives and flat JSON."""

from __future__ import annotations

import base64
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import rawjson
from kinweave.operators import gedcom
from kinweave.operators.bundle import COLLECTIONS, DIAGNOSTIC_SCHEMA, Bundles, now_utc, stats, version_gate
from kinweave.plans.workspace import Workspace

_RAW = "bundle_id string, part string, collection string, id string, body string, content binary"
_FOLDERS = [c for c in COLLECTIONS if c != "documents"]


def _archive(raw: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            path = info.filename
            if info.is_dir() or path.startswith("schema/"):
                continue
            data = z.read(info)
            folder, _, name = path.partition("/")
            if path == "manifest.json":
                yield "manifest", None, None, rawjson.dump(rawjson.parse(data.decode())), None
            elif folder in _FOLDERS and name.endswith(".json") and "/" not in name and name != ".json":
                yield "entity", folder, name[:-5], rawjson.dump(rawjson.parse(data.decode())), None
            elif path == "documents/index.json":
                index = rawjson.parse(data.decode())
                if not isinstance(index, dict):
                    raise TypeError("documents/index.json is no object")
                for eid, d in index.items():
                    yield "entity", "documents", eid, rawjson.dump(d), None
            else:
                yield "attachment", None, path, None, data


def _flat(raw: bytes) -> Iterator[tuple]:
    whole = rawjson.parse(raw.decode("utf-8-sig"))
    if not isinstance(whole, dict):
        raise ValueError("no object")
    for key, value in whole.items():
        if key == "manifest":
            yield "manifest", None, None, rawjson.dump(value), None
        elif key in COLLECTIONS:
            for eid, d in value.items():
                yield "entity", key, eid, rawjson.dump(d), None
        elif key == "attachments":
            for path, text in value.items():
                yield "attachment", None, path, None, base64.b64decode(text, validate=True)
        else:
            yield "extra", None, key, rawjson.dump(value), None


def _relative(root: str):
    """The path of a file below the folder that was read; of a file that was named itself, its name."""
    inside = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    at = F.instr("path", inside)
    return F.when(at > 0, F.substring("path", at + len(inside), F.length("path"))).otherwise(F.element_at(F.split("path", "/"), -1))


def read_bundles(spark: SparkSession, path: str) -> Bundles:
    """Every file below path is a bundle, named by its path from there; archives by their ending, else flat JSON.
    A file that cannot be read is refused whole, with one diagnostic."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_relative(path).alias("path"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                bundle = file.rsplit(".", 1)[0]
                try:
                    rows = list((_archive if file.lower().endswith(".axgf") else _flat)(content))
                except zipfile.BadZipFile as e:
                    rows = [("ZIP_READ_ERROR", None, None, str(e), None)]
                except (ValueError, UnicodeDecodeError) as e:
                    rows = [("INVALID_JSON", None, None, str(e), None)]
                except (TypeError, AttributeError) as e:
                    rows = [("INVALID_BUNDLE_STRUCTURE", None, None, str(e), None)]
                yield pd.DataFrame([(bundle, *r) for r in rows], columns=["bundle_id", "part", "collection", "id", "body", "content"])

    raw = Workspace(spark, "bundles").cut(files.mapInPandas(run, _RAW))  # every file is unpacked once
    manifests, refused = version_gate(raw.where("part = 'manifest'").select("bundle_id", "body"))
    accepted = manifests.select("bundle_id")
    unread = raw.where("part not in ('manifest', 'entity', 'attachment', 'extra')").select(
        "bundle_id", F.lit(0).alias("phase"), F.lit("").alias("seq"), F.col("part").alias("code"), F.lit("error").alias("severity"), F.col("body").alias("message"), F.lit(None).cast("string").alias("entity_ref")
    )
    of = lambda part: raw.where(F.col("part") == part).join(accepted, "bundle_id", "left_semi")
    return Bundles(
        of("entity").select("bundle_id", "collection", "id", "body"),
        manifests,
        of("attachment").select("bundle_id", F.col("id").alias("path"), "content"),
        of("extra").select("bundle_id", F.col("id").alias("key"), F.col("body").alias("value")),
        spark.createDataFrame([], DIAGNOSTIC_SCHEMA).unionByName(refused).unionByName(unread),
    )


def read_gedcom(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_no, level, xref, tag, value) of the GEDCOM files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return gedcom.parse_lines(files.select(_relative(path).alias("file_id"), gedcom.decode(F.col("content")).alias("text")))


def flat_bundles(bundles: Bundles) -> DataFrame:
    """(bundle_id, json): each bundle as one flat JSON text with sorted ids; bodies stay as written."""
    return _assembled(bundles, "json string", _as_flat)


def archives(bundles: Bundles, keep_extra: bool = False) -> DataFrame:
    """(bundle_id, content, size_bytes): each bundle as a zipped archive; counts and updated_at are fresh.
    An archive is one file, so a bundle is assembled in one task; that is the format's own bound."""
    at = now_utc()
    return _assembled(bundles, "content binary, size_bytes long", lambda m, rows, counts: _as_archive(m, rows, counts, at, keep_extra))


def _assembled(bundles: Bundles, schema: str, make) -> DataFrame:
    null = F.lit(None)
    rows = bundles.entities.select("bundle_id", F.lit("entity").alias("part"), "collection", "id", "body", null.cast("binary").alias("content"))
    if bundles.attachments is not None:
        rows = rows.unionByName(bundles.attachments.select("bundle_id", F.lit("attachment").alias("part"), null.cast("string").alias("collection"), F.col("path").alias("id"), null.cast("string").alias("body"), "content"))
    if bundles.extras is not None:
        rows = rows.unionByName(bundles.extras.select("bundle_id", F.lit("extra").alias("part"), null.cast("string").alias("collection"), F.col("key").alias("id"), F.col("value").alias("body"), null.cast("binary").alias("content")))
    counts = stats(bundles.entities).select("bundle_id", F.to_json(F.struct(*COLLECTIONS)).alias("counts"))
    heads = bundles.manifests.join(counts, "bundle_id", "left").select("bundle_id", F.lit("manifest").alias("part"), F.col("counts").alias("collection"), null.cast("string").alias("id"), "body", null.cast("binary").alias("content"))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["part"] == "manifest"]
        if not len(head):
            return pd.DataFrame(columns=["bundle_id", *columns])
        counts_ = json.loads(head["collection"].iloc[0]) if head["collection"].iloc[0] else {}
        made = make(head["body"].iloc[0], pdf[pdf["part"] != "manifest"].sort_values(["collection", "id"]), dict.fromkeys(COLLECTIONS, 0) | counts_)
        return pd.DataFrame([(pdf["bundle_id"].iloc[0], *made)], columns=["bundle_id", *columns])

    return rows.unionByName(heads).groupBy("bundle_id").applyInPandas(run, f"bundle_id string, {schema}")


def _as_flat(manifest: str, rows: pd.DataFrame, counts: dict) -> tuple:
    q = rawjson.quoted
    parts = [f'"manifest":{manifest}']
    entities = rows[rows["part"] == "entity"]
    for c in COLLECTIONS:
        some = entities[entities["collection"] == c]
        parts.append(f"{q(c)}:{{" + ",".join(f"{q(i)}:{b}" for i, b in zip(some["id"], some["body"], strict=True)) + "}")
    files = rows[rows["part"] == "attachment"]
    if len(files):
        parts.append('"attachments":{' + ",".join(f"{q(p)}:{q(base64.b64encode(c).decode())}" for p, c in zip(files["id"], files["content"], strict=True)) + "}")
    extra = rows[rows["part"] == "extra"]
    parts += [f"{q(k)}:{v}" for k, v in zip(extra["id"], extra["body"], strict=True)]
    return ("{" + ",".join(parts) + "}",)


def _as_archive(manifest: str, rows: pd.DataFrame, counts: dict, at: str, keep_extra: bool) -> tuple:
    head = rawjson.parse(manifest)
    head["stats"], head["updated_at"] = counts, at
    if keep_extra:
        head |= {k: rawjson.parse(v) for k, v in rows[rows["part"] == "extra"][["id", "body"]].itertuples(index=False) if k not in head}
    out = io.BytesIO()
    entities = rows[rows["part"] == "entity"]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", rawjson.pretty(head))
        for c in _FOLDERS:
            some = entities[entities["collection"] == c]
            for i, b in zip(some["id"], some["body"], strict=True):
                z.writestr(f"{c}/{i}.json", rawjson.pretty(rawjson.parse(b)))
        documents = entities[entities["collection"] == "documents"]
        index = {i: rawjson.parse(b) for i, b in zip(documents["id"], documents["body"], strict=True)}
        z.writestr("documents/index.json", rawjson.pretty(index))
        files = rows[rows["part"] == "attachment"]
        for p, c in zip(files["id"], files["content"], strict=True):
            z.writestr(p, c)
    raw = out.getvalue()
    return raw, len(raw)

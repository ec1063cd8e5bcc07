"""GEDCOM 5.5.1: lines, the tree they form, and the entities the records stand for."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import rawjson
from kinweave.functions.dates import date_document
from kinweave.functions.ids import uuid_of
from kinweave.functions.names import MIME, OTHER_MIME, components_of, document_type_of
from kinweave.operators.bundle import CURRENT_SPEC_VERSION, ENTITY_SCHEMA, Bundles, now_utc, refreshed
from kinweave.plans.blocks import last_flagged

CONTINUATIONS = ("CONC", "CONT")


def decode(content):
    """The text of file bytes: by byte order mark, else UTF-8 where valid, else Latin-1."""
    head = F.substring(content, 1, 3)
    rest = lambda n: F.substring(content, n, F.length(content))
    return (
        F.when(head == F.lit(b"\xef\xbb\xbf"), F.make_valid_utf8(rest(F.lit(4)).cast("string")))
        .when(F.substring(content, 1, 2) == F.lit(b"\xff\xfe"), F.decode(rest(F.lit(3)), "UTF-16LE"))
        .when(F.substring(content, 1, 2) == F.lit(b"\xfe\xff"), F.decode(rest(F.lit(3)), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def parse_lines(files: DataFrame) -> DataFrame:
    """files (file_id, text) -> (file_id, line_no, level, xref, tag, value).  A line is a number, one space and the
    rest; an xref counts at level 0 only.  Lines that do not begin with a number of 32 bits are dropped."""
    line = F.regexp_replace("raw", r"(?U)\s+$", "")
    level = F.regexp_extract("line", r"^\+?([0-9]+) ", 1).try_cast("long")
    rest = F.regexp_replace("line", r"^\+?[0-9]+ ", "")
    xref = F.when(F.col("level") == 0, F.nullif(F.regexp_extract("rest", r"^(@[^@]*@)", 1), F.lit("")))
    after = F.when(F.col("xref").isNull(), F.col("rest")).otherwise(F.regexp_replace("rest", r"(?U)^@[^@]*@\s*", ""))
    return (
        files.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), line.alias("line"))
        .select("file_id", "line_no", level.alias("level"), rest.alias("rest"))
        .where("level < 4294967296")
        .select("file_id", "line_no", "level", "rest", xref.alias("xref"))
        .select("file_id", "line_no", "level", "xref", after.alias("after"))
        .select(
            "file_id",
            "line_no",
            F.least("level", F.lit(2147483647)).cast("int").alias("level"),  # a level so deep hangs on nothing
            "xref",
            F.regexp_extract("after", "(?s)^([^ ]*)", 1).alias("tag"),
            F.regexp_extract("after", "(?s)^[^ ]* (.*)$", 1).alias("value"),
        )
    )


def once(lines: DataFrame) -> DataFrame:
    """Of reloaded lines the latest (ties: the greater tag and value)."""
    if "ingested_at" not in lines.columns:
        lines = lines.withColumn("ingested_at", F.lit(None).cast("timestamp"))
    best = F.max(F.struct("ingested_at", "level", "tag", "value", "xref")).alias("r")
    return (
        lines.where("file_id is not null and line_no is not null")
        .groupBy("file_id", F.col("line_no").cast("long").alias("line_no"))
        .agg(best)
        .select("file_id", "line_no", "r.level", "r.xref", "r.tag", "r.value")
    )


def tree(lines: DataFrame) -> DataFrame:
    """Adds record (the level-0 line of the record) and parent_line; lines whose chain of levels is broken and
    continuation lines are left out.

    One ordered pass over the lines of a record keeps the line open at each level, so depth costs nothing."""
    nodes = lines.where(F.col("level").isNotNull() & ~F.coalesce(F.col("tag"), F.lit("")).isin(*CONTINUATIONS))
    placed = last_flagged(nodes, "file_id", "line_no", F.col("level") == 0, "record").where("record is not null")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, path = None, []
        for b in batches:
            parents, kept = [], []
            for file, record, line, level in b[["file_id", "record", "line_no", "level"]].itertuples(index=False, name=None):
                if (file, record) != key:
                    key, path = (file, record), []
                kept.append(level <= len(path))
                parents.append(path[level - 1] if 0 < level <= len(path) else None)
                if kept[-1]:
                    del path[level:]
                    path.append(line)
            b["parent_line"] = pd.array(parents, dtype="Int64")
            yield b[kept]

    kept = "file_id string, record long, line_no long, parent_line long, level int, xref string, tag string, value string"
    ordered = placed.select("file_id", "record", "line_no", F.lit(None).cast("long").alias("parent_line"), "level", "xref", "tag", "value")
    return ordered.repartition("file_id", "record").sortWithinPartitions("file_id", "record", "line_no").mapInPandas(walk, kept)


def values(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, tag, value): each line with its CONC and CONT lines joined to it."""
    tag = F.coalesce("tag", F.lit(""))
    placed = last_flagged(lines, "file_id", "line_no", ~tag.isin(*CONTINUATIONS), "head").where("head is not null")
    part = F.struct("line_no", "tag", F.coalesce("value", F.lit("")).alias("value"))
    return (
        placed.groupBy("file_id", "head")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select(
            "file_id",
            F.col("head").alias("line_no"),
            F.col("parts")[0]["tag"].alias("tag"),
            F.aggregate("parts", F.lit(""), lambda acc, x: F.concat(acc, F.when(x["tag"] == "CONT", "\n").otherwise(""), x["value"])).alias("value"),
        )
    )


# ---- records to entities


class _Node:
    __slots__ = ("xref", "tag", "value", "date", "children")

    def __init__(self, xref, tag, value, date):
        self.xref, self.tag, self.value, self.date, self.children = xref, tag or "", value or "", date, []

    def all(self, *tags):
        return [c for c in self.children if c.tag in tags]

    def one(self, tag):
        return next((c for c in self.children if c.tag == tag), None)


def _build(lines) -> _Node | None:
    path: list[_Node] = []
    for level, xref, tag, value, date in lines:
        if level is None or level > len(path):
            continue
        del path[level:]
        node = _Node(xref, tag, value, json.loads(date) if date else None)
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0] if path else None


def _is_pointer(text: str) -> bool:
    return len(text) > 1 and text.startswith("@") and text.endswith("@")


class _Converter:
    """One record at a time; ids derive from the file and what they stand for, so records need no order."""

    def __init__(self, file: str, confidence: float, lang: str, notes: dict[str, str]):
        self.file, self.confidence, self.lang, self.notes = file, confidence, lang, notes
        self.entities: list[tuple[str, str, dict]] = []
        self.skipped: list[str] = []

    def uuid(self, xref: str) -> str:
        return uuid_of(self.file, xref.strip())

    def put(self, collection: str, kind: str, eid: str, **fields) -> str:
        document = {"id": eid, "type": kind, "axgf_version": "1.0", **{k: v for k, v in fields.items() if v is not None}}
        self.entities.append((collection, eid, document))
        return eid

    def place(self, node: _Node | None) -> str | None:
        if node is None:
            return None
        key = node.value.strip()
        return self.put("places", "place", uuid_of(self.file, "place", key), names=[{"lang": self.lang, "value": key, "is_primary": True}])

    def block(self, node: _Node) -> dict:
        date, place = node.one("DATE"), self.place(node.one("PLAC"))
        out = {} if date is None else {"date": date.date}
        if place:
            out["place_id"] = place
        return out | {"confidence": self.confidence}

    def note_text(self, node: _Node) -> str | None:
        parts = []
        for c in node.all("NOTE", "TITL", "FACT"):
            text = c.value.strip()
            if c.tag != "NOTE":
                text = text and f"{c.tag}: {text}"
            elif _is_pointer(text):
                text = self.notes.get(text)
            if text:
                parts.append(text)
        return "\n".join(parts) or None

    def document(self, eid: str, node: _Node) -> str:
        form, title, path = None, None, ""
        for c in node.children:
            if c.tag == "FORM":
                form = c.value
            elif c.tag == "TITL":
                title = c.value
            elif c.tag == "FILE":
                path = c.value
                form = form if form is not None or (x := c.one("FORM")) is None else x.value
                title = title if title is not None or (x := c.one("TITL")) is None else x.value
        filename = path.rsplit("/", 1)[-1]
        ext = filename.rsplit(".", 1)[-1].lower()
        mime = form.strip() if form and "/" in form else MIME.get(ext, OTHER_MIME)
        file = {"path": path} if path else None
        return self.put("documents", "document", eid, filename=filename, mime_type=mime, document_type=document_type_of(ext), status="referenced", file=file, caption=title)

    def individual(self, r: _Node) -> None:
        eid = self.uuid(r.xref)
        names = [(" ".join(n.value.replace("/", "").split()), components_of(n.value)) for n in r.all("NAME")]
        display, parts = names[0] if names and names[0][0] else ("[Unknown]", components_of(r.one("NAME").value) if names else [])
        sex = r.one("SEX")
        sex = sex.value.strip() if sex else "U"
        identity = {"name": {"display": display, "components": parts}, "gender": {"value": sex if sex in ("M", "F", "NB", "U") else "U"}, "is_living": r.one("DEAT") is None}
        if names[1:]:
            identity["names"] = [{"type": "alias", "display": d, "components": c} for d, c in names[1:]]
        vitals = {k: self.block(n) for k, t in (("birth", "BIRT"), ("death", "DEAT")) if (n := r.one(t)) is not None}
        linked = []
        for k, o in enumerate(r.all("OBJE")):
            text = o.value.strip()
            did = self.uuid(text) if _is_pointer(text) else self.document(uuid_of(self.file, r.xref, "OBJE", str(k)), o)
            linked.append({"document_id": did, "role": "attachment"})
        for k, o in enumerate(r.all("OCCU")):
            title = o.value.strip()
            if not title:
                self.skipped.append(f"empty OCCU of {r.xref}")
                continue
            date = o.one("DATE")
            self.put(
                "occupations", "occupation", uuid_of(self.file, r.xref, "OCCU", str(k)), person_id=eid, title=title, confidence=self.confidence,
                valid_from=None if date is None else {"date": date.date}, place_id=self.place(o.one("PLAC")),
            )
        self.put("persons", "person", eid, identity=identity, **vitals, notes=self.note_text(r), documents=linked or None)

    def family(self, r: _Node) -> None:
        eid = self.uuid(r.xref)
        couple = [{"person_id": self.uuid(c.value), "role": "spouse"} for c in r.all("HUSB", "WIFE") if _is_pointer(c.value.strip())]
        children = []
        for c in r.all("CHIL"):
            if _is_pointer(c.value.strip()):
                child = {"person_id": self.uuid(c.value), "birth_order": len(children) + 1}
                if (pedi := c.one("PEDI")) is not None:
                    child["note"] = f"pedigree: {pedi.value}"
                children.append(child)
        if not couple and not children:
            self.skipped.append(f"empty FAM {r.xref}")
            return
        union, marriage = None, r.one("MARR")
        if couple:
            union = {"type": "marriage", "persons": couple}
            if marriage is not None:
                start = self.block(marriage)
                del start["confidence"]
                event = self.put(
                    "events", "event", uuid_of(self.file, r.xref, "MARR"), category="marriage", date=start.get("date", {"precision": "unknown"}),
                    place_id=start.get("place_id"), confidence=self.confidence,
                    participants=[{"entity_type": "person", "entity_id": p["person_id"], "role": "spouse"} for p in couple] + [{"entity_type": "family", "entity_id": eid, "role": "created"}],
                )
                union["start"] = start | {"event_id": event}
        self.put("families", "family", eid, union=union, children=children or None, notes=self.note_text(r))

    def record(self, r: _Node) -> None:
        if r.tag in ("HEAD", "TRLR", "NOTE", "REPO"):
            return
        if r.tag not in ("INDI", "FAM", "SOUR", "OBJE"):
            self.skipped.append(f"unrecognised {r.tag}")
        elif r.xref:
            if r.tag == "INDI":
                self.individual(r)
            elif r.tag == "FAM":
                self.family(r)
            elif r.tag == "OBJE":
                self.document(self.uuid(r.xref), r)
            else:
                title = r.one("TITL")
                self.put("sources", "source", self.uuid(r.xref), title=title.value if title else "Untitled source", source_type="other", reliability="unknown", confidence=self.confidence)


def _joined(lines: DataFrame) -> DataFrame:
    """(file_id, record, line_no, level, xref, tag, value, date): the lines of every record with their CONC and CONT
    lines joined to them; date is the document of a DATE line."""
    tag = F.coalesce("tag", F.lit(""))
    placed = last_flagged(once(lines), "file_id", "line_no", F.col("level") == 0, "record").where("record is not null")
    placed = last_flagged(placed, "file_id", "line_no", ~tag.isin(*CONTINUATIONS), "head").where("head is not null")
    part = F.struct("line_no", "tag", F.coalesce("value", F.lit("")).alias("value"))
    at_head = lambda c: F.max(F.when(F.col("line_no") == F.col("head"), F.col(c))).alias(c)
    text = F.aggregate("parts", F.lit(""), lambda acc, x: F.concat(acc, F.when(x["tag"] == "CONT", "\n").otherwise(""), x["value"]))
    # records are gathered next: both aggregations share one exchange
    whole = placed.repartition("file_id", "record").groupBy("file_id", "record", "head").agg(at_head("level"), at_head("xref"), at_head("tag"), F.sort_array(F.collect_list(part)).alias("parts"))
    whole = whole.select("file_id", "record", F.col("head").alias("line_no"), "level", "xref", "tag", text.alias("value"))
    return whole.withColumn("date", F.when(F.col("tag") == "DATE", date_document("value")))


def convert(lines: DataFrame, confidence: float = 0.8, place_lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(entities, diagnostics (bundle_id, code, severity, message)) of the files; a file is a bundle.

    Records are converted where they are gathered; places are named by their text, so the same place of two
    records is the same entity and is kept once."""
    line = F.struct("line_no", "level", "xref", "tag", "value", "date")
    records = _joined(lines).groupBy("file_id", "record").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    head = F.col("lines")[0]
    # the bodies of shared notes, for the records that point at them
    is_note = (head["tag"] == "NOTE") & head["xref"].isNotNull()
    body = head["value"]
    notes = records.where(is_note).select("file_id", head["xref"].alias("xref"), body.alias("note"))
    wanted = records.select("file_id", "record", F.explode(F.filter("lines", lambda x: (x["tag"] == "NOTE") & x["value"].rlike("^\\s*@.*@\\s*$"))).alias("n"))
    given = (
        wanted.select("file_id", "record", F.trim("n.value").alias("xref"))
        .join(notes, ["file_id", "xref"])
        .groupBy("file_id", "record")
        .agg(F.collect_set(F.struct("xref", "note")).alias("notes"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, lines_, notes_ in zip(b["file_id"], b["lines"], b["notes"], strict=True):
                c = _Converter(file, confidence, place_lang, {x["xref"]: x["note"] for x in notes_} if notes_ is not None else {})
                root = _build((x["level"], x["xref"], x["tag"], x["value"], x["date"]) for x in lines_)
                if root is not None:
                    c.record(root)
                rows += [(file, col, eid, rawjson.dump(d), None) for col, eid, d in c.entities]
                rows += [(file, None, None, None, m) for m in c.skipped]
            yield pd.DataFrame(rows, columns=["bundle_id", "collection", "id", "body", "skipped"])

    made = records.join(given, ["file_id", "record"], "left").mapInPandas(run, ENTITY_SCHEMA + ", skipped string")
    entities = made.where("skipped is null").select("bundle_id", "collection", "id", "body").distinct()
    diagnostics = made.where("skipped is not null").select(
        "bundle_id", F.lit("GEDCOM_UNRECOGNIZED_TAG").alias("code"), F.lit("warning").alias("severity"), F.col("skipped").alias("message")
    )
    return entities, diagnostics


def converted(lines: DataFrame, confidence: float = 0.8, place_lang: str = "en") -> Bundles:
    """The files as whole bundles, with a manifest each that counts the entities and names the source."""
    entities, diagnostics = convert(lines, confidence, place_lang)
    at = now_utc()
    fresh = {"axgf": CURRENT_SPEC_VERSION, "created_at": at, "updated_at": at, "stats": {}, "generator": {"name": "kinweave"}, "compatibility": {"gedcom_source": "5.5.1"}}
    files = lines.where("file_id is not null").select(F.col("file_id").alias("bundle_id")).distinct()
    manifests = refreshed(files.withColumn("body", F.lit(json.dumps(fresh))), entities, at)
    return Bundles(entities, manifests, diagnostics=diagnostics)

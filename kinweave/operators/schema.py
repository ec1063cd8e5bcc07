"""The rules of each kind of document, declared once and compiled per worker."""

from __future__ import annotations

import functools
import json
import re

# fixed values: patterns and value lists of the bundle format, version 1.0
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
ISO8601 = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?)?)?)?$"
LANG = "^[a-z]{2,3}(-[A-Z]{2,3})?$"
SHA256 = "^[0-9a-f]{64}$"
CALENDARS = "gregorian julian hebrew hijri persian chinese ethiopian japanese_era republican_french roman"
PRECISIONS = "exact month year decade quarter_century century unknown"
COMPONENT_TYPES = "given_name family_name patronymic matronymic nasab laqab kunya nisbah nickname alias religious_name pen_name"
READINGS = "hiragana katakana pinyin jyutping ipa revised_romanization"
NAME_TYPES = "birth married alias nickname transliteration religious pen_name other"
UNION_TYPES = "marriage civil_union cohabitation religious_only polygamous unknown"
UNION_STATUS = "active ended_by_death ended_by_divorce ended_by_separation annulled unknown"
EVENTS = "birth death marriage divorce adoption migration naturalization military incarceration name_change census legal religious social historical other"
LINKS = "spiritual professional social legal medical educational conflict other"
SOURCES = "birth_certificate death_certificate marriage_certificate census baptism_record burial_record will land_record military_record immigration_record naturalization passport photograph letter diary newspaper oral_tradition dna family_bible gravestone published_genealogy other"
RELIABILITY = "primary secondary derivative authored oral unknown"
SOURCE_STATUS = "verified unverified lost known_missing"
PLACES = "continent country region department city village district street building farm island historical unknown"
DOCUMENTS = "photo birth_certificate death_certificate marriage_certificate census_page baptism_record military_record will land_record letter diary newspaper_clipping gravestone_photo family_tree_drawing audio video other"
DOCUMENT_STATUS = "present referenced known_missing lost unknown"
DNA_TESTS = "autosomal y_dna mt_dna x_dna"

# A rule is a function of (value, path) that yields (path, problem).


def text(least=0, pattern=None, null=False, one_of=None, const=None):
    allowed = set(one_of.split()) if one_of else None
    compiled = re.compile(pattern) if pattern else None

    def rule(v, path):
        if v is None:
            if not null:
                yield path, "type"
        elif not isinstance(v, str):
            yield path, "type" if allowed is None else "enum"
        elif const is not None:
            if v != const:
                yield path, "const"
        elif len(v) < least:
            yield path, "minLength"
        elif allowed is not None and v not in allowed:
            yield path, "enum"
        elif compiled and not compiled.search(v):
            yield path, "pattern"

    return rule


def number(low=None, high=None, whole=False, null=False):
    def rule(v, path):
        if v is None and null:
            return
        if isinstance(v, bool) or not isinstance(v, (int, float)) or (whole and v != int(v)):
            yield path, "type"
        elif low is not None and v < low:
            yield path, "minimum"
        elif high is not None and v > high:
            yield path, "maximum"

    return rule


def boolean(v, path):
    if not isinstance(v, bool):
        yield path, "type"


def anything(v, path):
    return ()


def listed(item, least=0):
    def rule(v, path):
        if not isinstance(v, list):
            yield path, "type"
            return
        if len(v) < least:
            yield path, "minItems"
        for i, x in enumerate(v):
            yield from item(x, f"{path}/{i}")

    return rule


def record(required="", null=False, any_of=(), **fields):
    needed = required.split()

    def rule(v, path):
        if v is None and null:
            return
        if not isinstance(v, dict):
            yield path, "type"
            return
        for k in needed:
            if k not in v:
                yield f"{path}/{k}", "required"
        if any_of and not any(k in v for k in any_of):
            yield path, "anyOf"
        for k, r in fields.items():
            k = k.rstrip("_")
            if k in v:
                yield from r(v[k], f"{path}/{k}")

    return rule


@functools.cache
def rules() -> dict:
    uuid, note, share = text(pattern=UUID), text(null=True), number(0, 1)
    word = text()

    def date(v, path):  # refers to itself through its range
        return dated(v, path)

    dated = record(
        value=text(pattern=ISO8601), calendar=text(one_of=CALENDARS), precision=text(one_of=PRECISIONS), circa=boolean,
        confidence=share, note=note,
        alternatives=listed(record("value calendar", value=word, calendar=text(one_of=CALENDARS), era=word, era_year=number(whole=True))),
        range=record(null=True, earliest=date, latest=date, note=word),
    )
    component = record(
        "type value order", type=text(one_of=COMPONENT_TYPES), value=text(1), value_latin=note, reading=note,
        reading_system=text(null=True, one_of=READINGS), order=number(1, whole=True), derived_from=uuid,
        derivation_type=text(null=True, one_of="patronymic matronymic"),
    )
    name_fields = dict(
        display=text(1), display_latin=note, culture=text(pattern=LANG), direction=text(one_of="ltr rtl"),
        display_order=text(one_of="given_first family_first"), reading=note, reading_system=note, components=listed(component),
    )
    visibility = text(one_of="public members contributors private")
    attached = listed(record("document_id", document_id=uuid, role=word, note=note, date=note))
    hypothesis = record("id claim confidence status", id=word, claim=word, confidence=share, status=text(one_of="pending confirmed rejected investigating"), evidence=note, created_at=word, reviewed_at=note, reviewed_by=note)
    vital = dict(date=date, place_id=uuid, confidence=share, source_id=uuid, event_id=uuid)
    vault = record(null=True, vault_page=note)
    ends = lambda kinds: record("entity_type entity_id", entity_type=text(one_of=kinds), entity_id=uuid)
    timed = record(null=True, date=date, event_id=uuid)

    def entity(kind, required="", **fields):
        return record(
            f"id type axgf_version {required}", id=uuid, type=text(const=kind), axgf_version=text(const="1.0"), created_at=word,
            updated_at=word, version_num=number(1, whole=True), created_by=note, tags=listed(word), extensions=record(), **fields,
        )

    person = entity(
        "person", "identity",
        identity=record(
            "name gender is_living", name=record("display components", **name_fields),
            names=listed(record("display components", **name_fields, type=text(one_of=NAME_TYPES), source_id=uuid, confidence=share, valid_from=note, valid_until=note, note=note)),
            gender=record("value", value=text(one_of="M F NB U"), note=note), is_living=boolean, visibility=visibility,
        ),
        birth=record(null=True, **vital), death=record(null=True, cause=note, **vital), bio=note, notes=note, documents=attached,
        ai=record(null=True, vault_page=note, embedding_model=note, embedding_updated_at=note, hypotheses=listed(hypothesis)),
    )
    family = entity(
        "family", name=note, description=note, any_of=("union", "children"),
        union=record(
            "type persons", type=text(one_of=UNION_TYPES), status=text(null=True, one_of=UNION_STATUS),
            persons=listed(record("person_id role", person_id=uuid, role=word), 1), start=record(null=True, date=date, place_id=uuid, event_id=uuid),
            end=record(null=True, date=date, reason=note, note=note), confidence=share, source_id=uuid,
        ),
        children=listed(record("person_id", person_id=uuid, birth_order=number(whole=True, null=True), confidence=share, note=note)),
        documents=attached, notes=note, ai=vault,
    )
    event = entity(
        "event", "category date", category=text(one_of=EVENTS), subcategory=note, date=date, place_id=uuid,
        participants=listed(record("entity_type entity_id role", entity_type=text(one_of="person family organization"), entity_id=uuid, role=word, confidence=share)),
        description=note, documents=attached, confidence=share, source_id=uuid, ai=vault,
    )
    link = entity(
        "link", "from to label", from_=ends("person family event"), to=ends("person family event"), label=text(1), label_reverse=note,
        category=text(null=True, one_of=LINKS), bidirectional=boolean, valid_from=timed, valid_until=timed, confidence=share,
        source_id=uuid, note=note, visibility=visibility,
    )
    occupation = entity(
        "occupation", "person_id title", person_id=uuid, title=text(1), title_latin=note, title_normalized=note,
        employer=record(null=True, name=word, place_id=uuid), place_id=uuid, valid_from=record(null=True, date=date),
        valid_until=record(null=True, date=date), confidence=share, source_id=uuid, note=note,
    )
    source = entity(
        "source", "title source_type reliability", title=word, source_type=text(one_of=SOURCES), reliability=text(one_of=RELIABILITY),
        confidence=share, status=text(null=True, one_of=SOURCE_STATUS), repository=record(null=True, name=word, location=note, url=note, reference=note),
        date=date, place_id=uuid, document_id=uuid,
        conflicts=listed(record("source_id field", source_id=uuid, field=word, this_value=word, conflict_value=word, resolution=text(null=True, one_of="this_preferred other_preferred unresolved"), resolution_note=note)),
        transcription=note, language=note, script=note,
        dna=record(null=True, test_provider=word, test_type=text(one_of=DNA_TESTS), test_date=note, kit_id=note, match=record(null=True, person_id=uuid, shared_cm=number(), shared_percent=number())),
    )
    place = entity(
        "place", "names", names=listed(record("lang value", lang=word, value=word, is_primary=boolean), 1), place_type=text(null=True, one_of=PLACES),
        region=note, country_current=note, coordinates=record(null=True, lat=number(-90, 90), lon=number(-180, 180), precision=note),
        country_history=listed(record("country", country=word, until=note, note=note, from_=note)),
        identifiers=record(null=True, wikidata=word, geonames=word, insee=word), note=note,
    )
    document = entity(
        "document", "filename mime_type document_type status", filename=word, mime_type=word, document_type=text(one_of=DOCUMENTS),
        status=text(one_of=DOCUMENT_STATUS), file=record(null=True, path=word, size_bytes=number(whole=True), sha256=text(pattern=SHA256)),
        url=note, date=date, place_id=uuid, language=note,
        linked_to=listed(record("entity_type entity_id", entity_type=text(one_of="person family event source"), entity_id=uuid, role=word)),
        ocr=record(null=True, text=word, confidence=share, language=word, engine=note), caption=note, note=note,
        ai=record(null=True, summary=note, suggested_links=listed(record(entity_type=word, entity_id=uuid, confidence=share, reason=word))),
    )
    count = number(0, whole=True)
    manifest = record(
        "axgf created_at stats", axgf=text(const="1.0"), created_at=word, updated_at=word,
        stats=record("persons", persons=count, families=count, events=count, links=count, occupations=count, sources=count, places=count, documents=count),
    )
    return {
        "persons": person, "families": family, "events": event, "links": link, "occupations": occupation, "sources": source,
        "places": place, "documents": document, "manifest": manifest,
    }


def problems(collection: str, body: str | None) -> list[tuple[str, str]]:
    """(path, problem) of everything in a document that breaks its kind's rules; unknown keys are free."""
    try:
        value = json.loads(body)
    except (ValueError, TypeError):
        return [("", "json")]
    rule = rules().get(collection)
    return list(rule(value, "")) if rule else [("", "kind")]

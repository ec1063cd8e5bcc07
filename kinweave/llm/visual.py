"""Visually identical text with different characters (problem 5).

Method: a longest-match transducer over grapheme clusters.  Its mapping is computed once by rule from the
Unicode data (widths, presentation forms, decomposed accents, spaces, invisible characters) and from a fixed
list of look-alike letters, and is checked for conflicts when it is compiled: no key may have two outputs and
no output may hold a key again, so one pass reaches the fixed point.  A cluster is a base character with the
marks and invisible characters that follow it; the compiled pattern matches whole clusters, longest first.

Look-alikes depend on the word they stand in: in a word with Latin letters, Cyrillic and Greek look-alikes
become Latin; in a word of Cyrillic letters Latin look-alikes become Cyrillic.  A word wholly of one script
stays, except where the field is meant to be Latin, or where it is all look-alikes amid Latin words.

Defined results: null stays null and is never affected; an empty text stays empty; every space becomes
U+0020 and keeps its place (runs of spaces are kept); texts of any length are processed whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: Cyrillic and Greek letters that look like Latin ones
CYRILLIC_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "H", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
}
GREEK_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "υ": "u", "α": "a", "ρ": "p", "κ": "k", "γ": "y",
    "τ": "t", "ε": "e", "ϲ": "c", "ϳ": "j", "η": "n", "χ": "x", "ό": "ó", "ά": "á", "έ": "é", "ί": "í", "ύ": "ú",
}

# fixed values: letters of the Latin block that look like others of it; no spelling of a name uses them
LATIN_LATIN = {"ɡ": "g", "ɑ": "a", "ꞔ": "c"}
_TO_PLAIN = str.maketrans(LATIN_LATIN)

_IGNORED_MARKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}


def _invisible(ch: str) -> bool:
    o = ord(ch)
    kind = unicodedata.category(ch)
    selects = 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF  # variation selectors
    return kind == "Cf" or o in _IGNORED_MARKS or selects or (kind == "Cc" and not ch.isspace())


def _plain(ch: str) -> str:
    """The ordinary form of one character, by rule."""
    if _invisible(ch):
        return ""
    if ch.isspace():
        return " "
    flat = unicodedata.normalize("NFKC", ch)
    if flat[0] == " ":  # a spacing accent is a sign of its own
        return ch
    return "".join(" " if x.isspace() else x for x in flat if not _invisible(x))


@functools.cache
def _tables() -> tuple[re.Pattern, dict[str, str], frozenset[str], frozenset[str]]:
    """The compiled pattern, the mapping of all single characters and all accented pairs, the characters without
    which a text has nothing to map, and those of them that belong to the cluster before them."""
    mapping: dict[str, str] = {}

    def add(key: str, value: str) -> None:
        if mapping.setdefault(key, value) != value:
            raise ValueError(f"conflict: {key!r} -> {mapping[key]!r} and {value!r}")

    touched = []
    # the planes between hold ideographs that are their own form, and nothing else that is assigned
    for o in (*range(0x80, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        if 0xD800 <= o < 0xE000:
            continue
        ch = chr(o)
        if not ch.isprintable() and unicodedata.category(ch) == "Cn":
            continue
        to = _plain(ch)
        if to != ch:
            add(ch, to)
            touched.append(ch)
        full = unicodedata.normalize("NFD", ch)
        if to == ch and len(full) > 1 and unicodedata.normalize("NFC", full) == ch:
            add(full, ch)
    for ch in map(chr, [*range(0x00, 0x20), 0x7F]):
        add(ch, _plain(ch))
    for key, value in mapping.items():
        if any(mapping.get(x, x) != x for x in value):
            raise ValueError(f"not closed: {key!r} -> {value!r}")
    # any base with the marks, sound marks and invisible characters after it is one cluster
    trail = "̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿゙゚ﾞﾟ︀-️︠-︯­͏​-‏⁠-⁤﻿\U000e0000-\U000e01ef"
    single = "".join(sorted(re.escape(x) for x in touched))
    pattern = re.compile(f"[^{trail}][{trail}]+|[{trail}]+|[\x00-\x1f\x7f{single}]")
    marks = {chr(o) for a, b in re.findall("(.)-(.)|.", trail) if a for o in range(ord(a), ord(b) + 1)} | set(trail)
    marks -= {"-"}
    return pattern, mapping, frozenset(marks | {k for k in mapping if len(k) == 1}), frozenset(marks)


@functools.lru_cache(1 << 16)
def _cluster(cluster: str) -> str:
    _, mapping, _, _ = _tables()
    if cluster in mapping:
        return mapping[cluster]
    # marks and invisible characters mixed: the rule, as the table holds each base with its own marks only
    bare = "".join(x for x in cluster if not _invisible(x))
    flat = unicodedata.normalize("NFKC", bare)
    return "".join(mapping.get(x, x) if not unicodedata.combining(x) else x for x in flat)


_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_TO_LATIN = CYRILLIC_LATIN | GREEK_LATIN
_LATIN_CYRILLIC = {v: k for k, v in reversed(CYRILLIC_LATIN.items()) if ord(k) < 0x460 and k not in "ЅІЈѕіј"}
_LATIN_GREEK = {v: k for k, v in reversed(GREEK_LATIN.items()) if v.isupper() or v in "ov"}


def _letters(word: str, latin_value: bool, latin_field: bool) -> str:
    latin = _LATIN.search(word)
    other = _CYRILLIC.search(word) or _GREEK.search(word)
    if not other:
        return word
    if latin_field or (not latin and latin_value and all(x in _TO_LATIN for x in word)):
        return "".join(_TO_LATIN.get(x, x) for x in word)
    if not latin:
        return word
    # a mixed word: the script of the letters that cannot be mistaken decides
    foreign = [x for x in word if (_CYRILLIC.match(x) or _GREEK.match(x)) and x not in _TO_LATIN]
    if foreign:
        back = _LATIN_CYRILLIC if _CYRILLIC.match(foreign[0]) else _LATIN_GREEK
        own = [x for x in word if _LATIN.match(x) and x not in back]
        if len(own) < len(foreign):
            return "".join(back.get(x, x) for x in word)
    return "".join(_TO_LATIN.get(x, x) for x in word)


@functools.lru_cache(1 << 17)
def consistent(text: str, latin_field: bool = False) -> str:
    """The one consistent form of a text."""
    if text.isascii() and text.isprintable():
        return text
    pattern, mapping, touched, trailing = _tables()
    found = touched.intersection(text)
    if not found.isdisjoint(trailing):
        text = pattern.sub(lambda m: _cluster(m[0]), text)
    else:  # every cluster is one character: no output holds a key, so the order is free
        for c in found:
            text = text.replace(c, mapping[c])
    if any(c in text for c in LATIN_LATIN):
        text = _WORD.sub(lambda m: m[0].translate(_TO_PLAIN) if _LATIN.search(m[0]) else m[0], text)
    if not (_CYRILLIC.search(text) or _GREEK.search(text)):
        return text
    latin_value = bool(_LATIN.search(text))
    if not (latin_value or latin_field):
        return text
    spelled = _WORD.sub(lambda m: _letters(m[0], latin_value, latin_field), text)
    return text if spelled == text else unicodedata.normalize("NFC", spelled)


def _values(persons: DataFrame) -> DataFrame:
    """(row_id, field_name, latin, value): the judged values of each row that are not plain ASCII."""
    one = lambda name, latin, c: F.struct(F.lit(name).alias("field_name"), F.lit(latin).alias("latin"), c.alias("value"))
    many = lambda name, latin, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: one(name, latin, x))
    parts = F.col("identity.name.components")
    each = F.concat(
        F.array(one("display", False, F.col("identity.name.display"))),
        many("names", False, F.col("identity.names.display")),
        many("value_latin", True, parts["value_latin"]),
        many("reading", False, parts["reading"]),
    )
    return (
        persons.select("row_id", F.explode(each).alias("v"))
        .select("row_id", "v.*")
        .where(F.col("value").rlike(r"[^\x20-\x7e]"))
    )


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["normal"] = [consistent(v, bool(latin)) for v, latin in zip(b["value"], b["latin"], strict=True)]
        yield b


def consistent_values(persons: DataFrame) -> DataFrame:
    """(row_id, field_name, value, normal) of every judged value that is not plain ASCII."""
    return (
        _values(persons)
        .mapInPandas(_normalise, "row_id long, field_name string, latin boolean, value string, normal string")
        .drop("latin")
    )


def affected_fields(persons: DataFrame) -> DataFrame:
    """(row_id, field_name) of rows with a value that its consistent form differs from."""
    return consistent_values(persons).where("value <> normal").select("row_id", "field_name").distinct()


@F.pandas_udf(T.StringType())
def consistent_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else consistent(v))


@F.pandas_udf(T.StringType())
def consistent_latin(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else consistent(v, True))


def consistent_column(c: Column, latin: bool = False) -> Column:
    """The consistent form of a text column; plain ASCII never leaves the JVM's plan unchanged."""
    return F.when(c.rlike(r"[^\x20-\x7e]"), (consistent_latin if latin else consistent_text)(c)).otherwise(c)


def consistent_names(persons: DataFrame) -> DataFrame:
    """(row_id, field_name, position, value, normal): every name text of identity in its consistent form.

    display, names, value_latin and reading are the fields of p5_found, the others go by their path, with the
    number of the entry of identity.names.  position counts from 0 within the list, 0 where there is none."""
    one = lambda name, latin, at, c: F.struct(name.alias("field_name"), F.lit(latin).alias("latin"), at.cast("int").alias("position"), c.alias("value"))
    none = F.array().cast("array<struct<field_name:string,latin:boolean,position:int,value:string>>")
    each = lambda c, make: F.coalesce(F.transform(c, make), none)
    single = lambda name, latin, c: F.array(one(F.lit(name), latin, F.lit(0), F.col(c)))
    under_name = lambda prefix, f: lambda x, i: one(F.concat(prefix, F.lit(f)), f == "value_latin", i, x[f])
    parts = lambda c, prefix: [each(c, under_name(prefix, f)) for f in ("value", "value_latin", "reading")]
    under = lambda x, i: F.concat(*parts(x["components"], F.concat(F.lit("names["), i.cast("string"), F.lit("]."))))
    listed = F.concat(
        single("display", False, "identity.name.display"),
        single("name.display_latin", True, "identity.name.display_latin"),
        single("name.reading", False, "identity.name.reading"),
        each("identity.names", lambda x, i: one(F.lit("names"), False, i, x["display"])),
        *parts("identity.name.components", F.lit("")),
        F.flatten(F.coalesce(F.transform("identity.names", under), F.array(none))),
    )
    rows = persons.select("row_id", F.explode(listed).alias("v")).select("row_id", "v.*").where("value is not null")
    value = F.col("value")
    normal = F.when(F.col("latin"), consistent_column(value, True)).otherwise(consistent_column(value))
    return rows.select("row_id", "field_name", "position", "value", normal.alias("normal"))

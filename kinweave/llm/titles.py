"""Mapping of free-typed titles to a reference list (problem 7).

Method: a trie of the reference titles with alias paths (compound and split spellings, other word order,
umlauts written out, feminine forms by rule) is searched with a Levenshtein automaton: the rows of the
edit-distance table, with transpositions, advance along the trie and a branch is left once its row is beyond
the distance that the length allows.  All entries within it come out; the nearest decides, and a tie between
codes decides for none.  Every run of words of a title is looked up, longest first, so additions around a
title do not hide it.  Abbreviated words are aligned with the words of an entry.

Only distinct titles are matched, so the work follows the number of spellings, not of rows.

Defined results: null and blank titles have no row; of several rows of one id the title of the latest
ingested_at decides (ties: the greater title); titles that mean none of the list give 'NONE'; an empty
reference list gives 'NONE' for every title; titles of any length are read whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.visual import consistent

NONE = "NONE"
MAX_REFERENCE = 200_000  # entries; the trie is held by every worker

# fixed values: words that stand beside a title without changing it, by language
ADDITIONS = set(
    """
    a the of at on in own account employing men man hands census village upper lower town near his her and with
    master journeyman apprentice former formerly late retired widower widow assistant head chief old young senior
    junior sr jr self employed by trade ret dec deceased unemployed part time
    maitre ancien ancienne apprenti apprentie compagnon veuf veuve feu a la le les de du ferme en retraite et chez au aux sur ville bourg
    ehem ehemaliger ehemalige gewesener gewesene lehrling meister geselle witwer witwe u und einwohner in zu am im bei der die das
    alt hof i r ausser dienst
    byly byla dawny dawna mistrz czeladnik uczen wdowiec wdowa we w wsi z na dworski dworska emeryt emerytowany sp i
    """.split()
)
# fixed values: usual short forms that are no mere cuts or skeletons of the word
SHORT = {"b": "black", "ag": "agricultural", "dom": "domestic"}

_SPLIT = re.compile(r"[^a-z0-9]+")
_OCR = str.maketrans("01|5$", "olIss".lower())
_FOLD = str.maketrans({"ł": "l", "ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ı": "i"})


@functools.lru_cache(1 << 15)
def fold(text: str, umlauts: bool = False) -> str:
    """Lower case without accents; umlauts: written out instead."""
    text = consistent(text).casefold()
    if umlauts:
        text = text.translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"}))
    text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_FOLD)) if not unicodedata.combining(c))
    return text.replace("'", "").replace("’", "").replace("`", "")


def words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w]


def _clean(word: str) -> str:
    """Digits that stand for letters inside a word, as scanners read them."""
    if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
        return word.translate(_OCR)
    return word


# fixed values: endings of the feminine forms
_FEMININE = {
    "fr": [("ier", "iere"), ("er", "ere"), ("eur", "euse"), ("eur", "rice"), ("on", "onne"), ("ien", "ienne"), ("ant", "ante"), ("ois", "oise"), ("", "e")],
    "de": [("mann", "frau"), ("er", "erin"), ("e", "in"), ("", "in")],
    "pl": [("arz", "arka"), ("iel", "ielka"), ("nik", "niczka"), ("ik", "iczka"), ("ista", "istka"), ("acz", "aczka"), ("iec", "cowa"), ("al", "alowa"), ("ec", "cowa"), ("ek", "ka"), ("er", "erka"), ("or", "orka"), ("", "ka"), ("", "owa")],
    "en": [("man", "woman"), ("er", "eress"), ("er", "ress"), ("or", "ress"), ("", "ess"), ("master", "mistress")],
}


class Reference:
    """The compiled list: a trie whose nodes are dicts and whose entries are sets of codes."""

    END = ""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.trie: dict = {}
        self.exact: dict[str, set[str]] = defaultdict(set)
        self.entries: list[tuple[tuple[str, ...], str]] = []
        for code, title, lang in entries:
            for umlauts in (False, True):
                parts = words(fold(title.replace("-", " "), umlauts))
                if not parts:
                    continue
                self.entries.append((tuple(parts), code))
                forms = {" ".join(parts), "".join(parts), " ".join(parts[::-1])}
                forms |= {" ".join(parts[i:] + parts[:i]) for i in range(len(parts))}
                first = parts[0] if lang != "en" else parts[-1]
                for old, new in _FEMININE.get(lang, []):
                    if first.endswith(old) and len(first) > len(old) + 2:
                        other = first[: len(first) - len(old)] + new
                        rest = [*parts]
                        rest[0 if lang != "en" else -1] = other
                        forms.add(" ".join(rest))
                for form in forms:
                    self.exact[form].add(code)
        # an alias that is another entry's own title gives way to it
        own = {" ".join(p): c for p, c in self.entries}
        for form in list(self.exact):
            if form in own:
                self.exact[form] = {c for p, c in self.entries if " ".join(p) == form}
            node = self.trie
            for c in form:
                node = node.setdefault(c, {})
            node[self.END] = self.exact[form]
        self.entries = sorted(set(self.entries))
        # runs of words looked up: one more than any entry has, as a word may be typed in two
        self.longest = 1 + max((len(p) for p, _ in self.entries), default=0)
        self.by_first: dict[str, list[tuple[tuple[str, ...], str]]] = defaultdict(list)
        for p, c in self.entries:
            self.by_first[p[0][0]].append((p, c))

    @staticmethod
    def allowed(length: int) -> int:
        return 0 if length < 4 else 1 if length < 8 else 2

    def within(self, word: str, limit: int) -> dict[str, int]:
        """code -> distance of all entries within limit of word.

        A state of the automaton is the row of the edit-distance table near its diagonal: cells further away than
        limit are beyond it anyway."""
        found: dict[str, int] = {}
        n, far = len(word), limit + 1
        stack = [(self.trie, "", 0, [min(j, far) for j in range(n + 1)], None)]
        while stack:
            node, last, depth, row, before = stack.pop()
            codes = node.get(self.END)
            if codes and row[n] <= limit:
                for c in codes:
                    if row[n] < found.get(c, 99):
                        found[c] = row[n]
            depth += 1
            first, stop = max(1, depth - limit), min(n, depth + limit)
            if first > n:  # longer than the word by more than limit
                continue
            for c, child in node.items():
                if c == self.END:
                    continue
                new = [far] * (n + 1)
                if depth <= limit:
                    new[0] = depth
                least, left = new[0], new[first - 1]
                for j in range(first, stop + 1):
                    cost = row[j - 1] + (word[j - 1] != c)
                    if row[j] < cost - 1:
                        cost = row[j] + 1
                    if left < cost - 1:
                        cost = left + 1
                    if before and j > 1 and word[j - 2] == c and word[j - 1] == last and before[j - 2] + 1 < cost:
                        cost = before[j - 2] + 1
                    new[j] = left = cost if cost < far else far
                    if left < least:
                        least = left
                if least <= limit or min(row) < limit:  # a transposition may come back from the row before
                    stack.append((child, c, depth, new, row))
        return found

    @staticmethod
    def _shortens(short: str, full: str) -> int | None:
        """The cost of reading a word as a short form of another; None where it is none."""
        if short == full:
            return 0
        if len(short) >= len(full) or short[0] != full[0]:
            return None
        if full.startswith(short):
            return 1 if len(short) > 1 else None
        if len(short) < 3 or short[-1] not in full[-2:]:
            return None
        at = 0
        for c in short:  # in order, the letters all occur
            at = full.find(c, at) + 1
            if not at:
                return None
        return 2 if len(short) * 2 >= len(full) - 1 or short[-1] == full[-1] else None

    def abbreviated(self, parts: list[str], dotted: bool) -> set[str]:
        """Codes of the entries whose words all parts shorten, in order or as one word."""
        best, codes = 99, set()
        for entry, code in self.by_first.get(parts[0][0], ()):
            options = [entry] if len(entry) == len(parts) else []
            if len(entry) > 1 and len(parts) == 1:
                options.append(("".join(entry),))
            if len(entry) == 1 and len(parts) == 2:  # a compound split in two: 'sch. teacher'
                full = entry[0]
                for cut in range(3, len(full) - 2):
                    options.append((full[:cut], full[cut:]))
            for full in options:
                costs = [self._shortens(SHORT.get(s, s), f) if SHORT.get(s) != f else 1 for s, f in zip(parts, full, strict=True)]
                if any(c is None for c in costs):
                    continue
                letters = sum(map(len, parts))
                if len(parts) == 1 and letters < (3 if dotted else 4):
                    continue
                cost = sum(costs)
                if cost < best:
                    best, codes = cost, {code}
                elif cost == best:
                    codes.add(code)
        return codes

    @functools.lru_cache(1 << 16)  # noqa: B019
    def code_of(self, title: str) -> str:
        flat = fold(title.replace("-", " "))
        parts = [_clean(w) for w in words(flat)]
        parts = [w for w in parts if not w.isdigit()]
        spans = sorted(
            ((i, j) for i in range(len(parts)) for j in range(i + 1, min(len(parts), i + self.longest) + 1)),
            key=lambda s: (s[0] - s[1], s[0]),
        )
        # the longest run of words that is an entry or an alias
        for i, j in spans:
            codes = self.exact.get(" ".join(parts[i:j])) or self.exact.get("".join(parts[i:j]))
            if codes and self._stands(parts, i):
                return next(iter(codes)) if len(codes) == 1 else NONE
        kept = [w for w in parts if w not in ADDITIONS]
        if not kept:
            return NONE
        for run in (kept, *([parts[i:j] for i, j in spans if self._stands(parts, i)])):
            got = self._near(run)
            if got:
                return got
        dotted = "." in title or "'" in title
        runs = [kept] if len(kept) == len(parts) else [kept, parts]
        for run in runs:
            codes = self.abbreviated(run, dotted)
            if len(codes) == 1:
                return next(iter(codes))
        return NONE

    @staticmethod
    def _stands(parts: list[str], i: int) -> bool:
        """Whether only additions come before a run; after it anything may: places, years, counts."""
        return all(w in ADDITIONS for w in parts[:i])

    def _near(self, run: list[str]) -> str | None:
        best: dict[str, int] = {}
        for text in {" ".join(run), "".join(run), " ".join(run).replace("rn", "m"), " ".join(run).replace("ii", "u")}:
            letters = len(text.replace(" ", ""))
            for code, distance in self.within(text, self.allowed(letters)).items():
                best[code] = min(distance, best.get(code, 99))
        if not best:
            return None
        least = min(best.values())
        codes = [c for c, d in best.items() if d == least]
        return codes[0] if len(codes) == 1 else None


@functools.lru_cache(4)
def compiled(entries: tuple[tuple[str, str, str], ...]) -> Reference:
    return Reference(list(entries))


def match_titles(titles: DataFrame, reference: DataFrame) -> DataFrame:
    """(title, title_code) of each distinct title; ``titles`` has one column title."""
    rows = reference.select("title_code", "title", "lang").where("title is not null and title_code is not null").distinct()
    listed = rows.limit(MAX_REFERENCE + 1).collect()
    if len(listed) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} entries")
    entries = tuple(sorted((r.title_code, r.title, r.lang or "") for r in listed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = compiled(entries)
        for b in batches:
            b["title_code"] = [ref.code_of(t) for t in b["title"]]
            yield b

    # a few bytes a title, much work: partitions by number, not by size
    tasks = 3 * titles.sparkSession.sparkContext.defaultParallelism
    return titles.select("title").distinct().repartition(tasks, "title").mapInPandas(run, "title string, title_code string")


def latest_titles(occupations: DataFrame) -> DataFrame:
    """(id, title): the title that counts of every occupation that has one."""
    return (
        occupations.where(F.col("title").rlike(r"[^\s\p{Z}]"))
        .groupBy("id")
        .agg(F.max(F.struct("ingested_at", "title"))["title"].alias("title"))
    )


def unmatched(occupations: DataFrame, reference: DataFrame) -> DataFrame:
    """(title, n_occupations): the titles that mean none of the list."""
    latest = latest_titles(occupations)
    none = match_titles(latest, reference).where(F.col("title_code") == NONE).select("title")
    return latest.join(none, "title").groupBy("title").agg(F.count("*").alias("n_occupations"))


def occupation_codes(occupations: DataFrame, reference: DataFrame) -> DataFrame:
    """(occupation_id, title_code) of every occupation with a title."""
    latest = latest_titles(occupations)
    codes = match_titles(latest, reference)
    return latest.join(codes, "title").select(F.col("id").alias("occupation_id"), "title_code")

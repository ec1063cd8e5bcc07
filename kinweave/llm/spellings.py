"""Variant spellings of names typed by people (problem 3).

Method: a symmetric-delete neighbourhood index on tokens.  The distinct family tokens of each bundle and year of
birth give the keys that remain after deleting up to two letters of their beginning; tokens that share a key are
neighbours if their edit distance is small, so such pairs are found without comparing pairs.  People of one
family token, or of neighbours, whose first names can be one come together.  Names
are then aligned: the further given names are assigned to each other at least total cost, permitting typing
errors, initials, cut and contracted abbreviations, nicknames and dropped second names.  Nicknames are learned
from the names that the data itself lists as nicknames, beside none fixed.  Other scripts are read by their
Latin values and readings or transliterated.

Scale: people meet as numbers (a hash of where and under which names, a hash of who), and only those who have
somebody to meet; their names are fetched for those who met, once.  A bundle with a third of all rows is spread
over its years, tokens and first names, and persons meet only within those; a task holds the distinct family
tokens of a bundle and year.

Defined results: rows without bundle, id or year of birth are nobody's variant; ids of one human in different
bundles are not paired; persons of stated, different sex are no pair; births count as a year apart by date
where both are dates, else by year; titles before a name and relations after it are no part of it; copies of
a row add nothing; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.visual import consistent
from kinweave.plans.workspace import Workspace

FEW = 16  # tokens of which all pairs are compared; more are met by their keys
MAX_LEARNED = 1_000_000  # entries of a learned list, which every task holds; more are an error, none is dropped

# fixed values: words before a name
TITLES = set("mr mrs miss ms rev revd capt dr sir lady sieur dame mme mlle monsieur madame m herr frau fraulein pan pani sp ks widow wid witwe wwe veuve vve wdowa col maj lt sgt prof hon esq jr sr junior senior the".split())
# fixed values: Russian letters in Latin ones, as the data's own Latin values write them
CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцыьъэ", ["a", "b", "v", "g", "d", "e", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "y", "", "", "e"], strict=True)) | {"ё": "e", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}

_FOLD = str.maketrans({"ł": "l", "ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ı": "i"})
_CJK = re.compile(r"[぀-ヿ一-鿿]")


@functools.lru_cache(1 << 16)
def latin(token: str) -> str:
    """Lower-case Latin letters of a token; '' where it is in a script that is not read."""
    token = consistent(token).casefold().translate(_FOLD)
    token = "".join(CYRILLIC.get(c, c) for c in token)
    token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    return "" if _CJK.search(token) else "".join(c for c in token if c.isalpha())


def _tokens(display: str) -> list[str]:
    return [t for t in re.split(r"[\s_]+", consistent(display)) if t]


def parse_both(display: str, read=latin) -> list[tuple[tuple[str, ...], str]]:
    """The readings of a name as displayed: two plain words may come in either order."""
    got = parse(display, read)
    if got is None:
        return []
    plain = "," not in display and len(got[0]) == 1 and len(got[0][0]) > 1 and "." not in display
    if plain and not any(len(t) > 2 and t.isupper() for t in _tokens(display)):
        return [got, ((got[1],), got[0][0])]
    return [got]


def parse(display: str, read=latin) -> tuple[tuple[str, ...], str] | None:
    """(given tokens, family token) of a name as displayed; read gives a token's Latin letters."""
    display = consistent(display).strip()
    if "," in display:
        family, _, given = display.partition(",")
        fam = [read(t) for t in _tokens(family)]
        giv = [read(t) for t in _tokens(given)]
    else:
        raw = _tokens(display)
        while len(raw) > 1 and read(raw[0]) in TITLES and (len(read(raw[0])) > 1 or len(raw) > 2):
            raw = raw[1:]
        if not raw:
            return None
        at = len(raw) - 1
        if len(raw) > 1:
            shouted = [i for i, t in enumerate(raw) if len(t) > 2 and t.isupper()]
            if len(shouted) == 1:
                at = shouted[0]
            elif len(read(raw[-1])) <= 1 or raw[-1].endswith("."):
                at = 0
            elif _CJK.search(display):
                at = 0
        fam = [read(raw[at])]
        giv = [read(t) for i, t in enumerate(raw) if i != at]
    while len(giv) > 1 and giv[0] in TITLES and len(giv[0]) > 1:
        giv = giv[1:]
    fam, giv = [t for t in fam if t], [t for t in giv if t]
    return (tuple(giv), "".join(fam)) if fam and giv else None


def variants(display: str | None, display_latin: str | None, components: list | None, aliases: list | None, scripts: dict[str, str] | None = None) -> set[tuple[tuple[str, ...], str]]:
    """The names under which a row knows its person; scripts: learned Latin values of tokens."""
    out = set()
    read = (lambda t: latin(t) or latin(scripts.get(consistent(t), ""))) if scripts else latin
    given, family = [], []
    for c in components if components is not None else []:
        value = c["value"] or ""
        word = latin(value)
        if not word and c["value_latin"]:
            word = latin(c["value_latin"])
        word = word or read(value)
        if c["kind"] == "given_name" and word:
            given.append(word)
        elif c["kind"] == "family_name" and word:
            family.append(word)
    if given and family:
        out.add((tuple(given), "".join(family)))
    for d in (display_latin, display):
        if d and not out:
            out.update(parse_both(d, read))
    for a in aliases if aliases is not None else []:
        if a["display"] and a["kind"] not in ("married", "nickname") and (got := parse(a["display"], read)):
            out.add(got)
    return out


# ---- comparing


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance with transpositions, up to limit + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def _limit(a: str, b: str) -> int:
    n = max(len(a), len(b))
    return 0 if n < 4 else 1 if n < 6 else 2


@functools.lru_cache(1 << 18)
def token_cost(a: str, b: str, nicknames: frozenset | None) -> float | None:
    """The cost of reading two given names as one; None where they are not."""
    if a == b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 1.0 if b[0] == a else None
    d = distance(a, b, _limit(a, b))
    best = 0.5 * d if d <= _limit(a, b) else None
    if b.startswith(a) and len(a) >= 2:
        best = min(best or 9.0, 0.6)
    elif a[0] == b[0] and len(a) >= 2 and len(a) <= len(b) - 2:
        at = 0
        for c in a:
            at = b.find(c, at) + 1
            if not at:
                break
        if at and (a[-1] == b[-1] or len(a) * 2 >= len(b)):
            best = min(best or 9.0, 0.9)
    return best


class Nicknames:
    """Learned (name, nickname) pairs; spellings near a listed one count too."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.full: dict[str, set[str]] = defaultdict(set)
        for name, nick in pairs:
            self.full[nick].add(name)
            self.full[name].add(name)

    @functools.lru_cache(1 << 16)  # noqa: B019
    def names(self, token: str) -> frozenset[str]:
        return frozenset(self.full.get(token, ())) | {token}

    @functools.lru_cache(1 << 18)  # noqa: B019
    def cost(self, a: str, b: str) -> float | None:
        plain = token_cost(a, b, None)
        if plain is not None and plain <= 0.6:
            return plain
        best = plain
        for x in self.names(a):
            for y in self.names(b):
                if (x, y) != (a, b):
                    c = token_cost(x, y, None)
                    if c is not None and (best is None or c + 0.4 < best):
                        best = c + 0.4
        return best


def same_name(a: tuple[tuple[str, ...], str], b: tuple[tuple[str, ...], str], nick: Nicknames, slack: int = 0) -> float | None:
    """The cost of reading two names as spellings of one; None where they are not.  slack: more typing errors
    allowed in the first name and the family name."""
    (ga, fa), (gb, fb) = a, b
    limit = _limit(fa, fb) + slack
    d = distance(fa, fb, limit)
    if d > limit:
        return None
    first = nick.cost(ga[0], gb[0])
    if first is None and slack and len(ga[0]) > 3 and len(gb[0]) > 3:
        more = min(distance(x, y, 3) for x in nick.names(ga[0]) for y in nick.names(gb[0]))
        first = 0.5 * more if more <= _limit(ga[0], gb[0]) + 1 else None
    if first is None:
        return None
    rest_a, rest_b = ga[1:], gb[1:]
    if len(rest_a) > len(rest_b):
        rest_a, rest_b = rest_b, rest_a
    further = assigned([[nick.cost(x, y) for y in rest_b] for x in rest_a]) if rest_a else 0.0
    if further is None:
        return None
    return 0.5 * d + first + further + 0.3 * (len(rest_b) - len(rest_a))  # what is left over was dropped


def assigned(cost: list[list[float | None]]) -> float | None:
    """The least total cost at which every row gets a column of its own, rows at most as many as columns; None where
    some row cannot.  Rows are added one by one, each along the cheapest chain of reassignments."""
    n, m = len(cost), len(cost[0])
    never = 1e6
    price = [[never if c is None else c for c in row] for row in cost]
    row_of, u, v = [-1] * m, [0.0] * n, [0.0] * m
    for start in range(n):
        least, came, seen = [float("inf")] * m, [-1] * m, [False] * m
        i, at = start, -1
        while True:
            gap, nearest = float("inf"), -1
            for j in range(m):
                if not seen[j]:
                    reduced = price[i][j] - u[i] - v[j]
                    if reduced < least[j]:
                        least[j], came[j] = reduced, at
                    if least[j] < gap:
                        gap, nearest = least[j], j
            u[start] += gap
            for j in range(m):
                if seen[j]:
                    u[row_of[j]] += gap
                    v[j] -= gap
                else:
                    least[j] -= gap
            at = nearest
            seen[at] = True
            if row_of[at] < 0:
                break
            i = row_of[at]
        while at >= 0:
            before = came[at]
            row_of[at] = start if before < 0 else row_of[before]
            at = before
    total = sum(price[row_of[j]][j] for j in range(m) if row_of[j] >= 0)
    return total if total < never else None


def births_near(a: str, b: str) -> bool:
    if len(a) >= 10 and len(b) >= 10:
        try:
            return abs((date.fromisoformat(a[:10]) - date.fromisoformat(b[:10])).days) <= 366
        except ValueError:
            pass
    return abs(int(a[:4]) - int(b[:4])) <= 1


# ---- over tables


def learned_scripts(persons: DataFrame) -> dict[str, str]:
    """The commonest Latin value of each name part in a script that is not read otherwise."""
    part = persons.select(F.explode("identity.name.components").alias("c")).select("c.value", "c.value_latin")
    counted = (
        part.where(F.col("value").rlike(r"[\u3040-\u30ff\u4e00-\u9fff]") & (F.col("value_latin") != ""))
        .groupBy("value", "value_latin")
        .count()
        .groupBy("value")
        .agg(F.max(F.struct("count", "value_latin")).alias("best"))
    )
    return {consistent(r.value): r.best.value_latin for r in _bounded(counted)}


def _bounded(learned: DataFrame) -> list:
    rows = learned.limit(MAX_LEARNED + 1).collect()
    if len(rows) > MAX_LEARNED:
        raise ValueError(f"more than {MAX_LEARNED} learned entries; every task would have to hold them")
    return rows


def profiles(persons: DataFrame, nicknames: Broadcast, scripts: dict[str, str] | None = None) -> DataFrame:
    """(who, bundle_id, id, birth, year, sex, given, family, letters): a row for each name of a row; given and letters
    (the keys of the first name) are words of one text, who is a hash of bundle and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nick = nicknames.value
        for b in batches:
            rows = {}
            for bundle, pid, birth, sex, shown, shown_latin, parts, aliases in b.itertuples(index=False, name=None):
                for given, family in variants(shown, shown_latin, parts, aliases, scripts):
                    rows[bundle, pid, birth, int(birth[:4]), sex, " ".join(given), family, " ".join(first_keys(given[0], nick))] = None
            yield pd.DataFrame(list(rows), columns=["bundle_id", "id", "birth", "year", "sex", "given", "family", "letters"])

    sex = F.col("identity.gender.value")
    return (
        persons.where(
            F.col("id").isNotNull() & F.col("bundle_id").isNotNull() & F.col("birth.date.value").rlike("^[0-9]{4}(-[0-9]{2}){0,2}$")
        )
        .select(
            "bundle_id",
            "id",
            F.col("birth.date.value").alias("birth"),
            F.when(sex.isin("M", "F"), sex).alias("sex"),
            F.col("identity.name.display").alias("shown"),
            F.col("identity.name.display_latin").alias("shown_latin"),
            F.col("identity.name.components").alias("parts"),
            F.transform("identity.names", lambda x: F.struct(x["kind"].alias("kind"), x["display"].alias("display"))).alias("aliases"),
        )
        .mapInPandas(run, "bundle_id string, id string, birth string, year int, sex string, given string, family string, letters string")
        .select(F.xxhash64("bundle_id", "id").alias("who"), "*")
    )


def learned_nicknames(persons: DataFrame) -> Nicknames:
    """From the names that rows list as nicknames of their person."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for shown, shown_latin, parts, aliases in b.itertuples(index=False, name=None):
                main = next(iter(variants(shown, shown_latin, parts, None)), None)
                for a in aliases if aliases is not None else []:
                    got = parse(a) if a else None
                    if main and got and len(main[0][0]) > 2 and len(got[0][0]) > 1 and got[0][0] != main[0][0]:
                        rows.append((main[0][0], got[0][0]))
            yield pd.DataFrame(rows, columns=["name", "nick"])

    nick = F.filter("identity.names", lambda x: x["kind"] == "nickname")
    pairs = (
        persons.where(F.size(nick) > 0)
        .select(
            F.col("identity.name.display").alias("shown"),
            F.col("identity.name.display_latin").alias("shown_latin"),
            F.col("identity.name.components").alias("parts"),
            F.transform(nick, lambda x: x["display"]).alias("aliases"),
        )
        .mapInPandas(run, "name string, nick string")
        .groupBy("name", "nick")
        .count()
        .where("count > 1")
    )
    return Nicknames(sorted((r.name, r.nick) for r in _bounded(pairs)))


def _delete_keys(token):
    """What remains of the first eight letters after deleting none, one or two."""
    head = F.substring(token, 1, 8)

    def without(c):
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))),
            lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(8))),
        )

    once = F.array_distinct(without(head))
    twice = F.when(F.length(token) >= 5, F.flatten(F.transform(once, without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(head), once, twice))


def near_pairs(tokens: list[str], keys: list[list[str]] | None) -> Iterator[tuple[str, str]]:
    """The pairs (a < b) of distinct tokens within the edit distance that their length allows; keys: the delete keys
    of each, or None to compare all."""
    if keys is None:
        met = itertools.combinations(sorted(tokens), 2)
    else:
        holders = defaultdict(list)
        for t, ks in zip(tokens, keys, strict=True):
            for k in ks:
                holders[k].append(t)
        met = {p for h in holders.values() if len(h) > 1 for p in itertools.combinations(sorted(h), 2)}
    return ((a, b) for a, b in met if _near(a, b))


@functools.lru_cache(1 << 18)
def _near(a: str, b: str) -> bool:
    limit = _limit(a, b)
    return distance(a, b, limit) <= limit


def neighbours(placed: DataFrame) -> DataFrame:
    """(place, family, others) of the families that have neighbours in their place; others: those that come later in
    order, so a pair is listed once."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for place, families, keys in b.itertuples(index=False, name=None):
                others = defaultdict(list)
                for x, y in near_pairs(list(families), keys):
                    others[x].append(y)
                    others[y]  # listed too, be it without others
                rows += [(place, x, ys) for x, ys in others.items()]
            yield pd.DataFrame(rows, columns=["place", "family", "others"])

    return (
        placed.groupBy("place")
        .agg(F.collect_set("family").alias("families"))
        .where(F.size("families") > 1)
        .select("place", "families", F.when(F.size("families") > FEW, F.transform("families", _delete_keys)).alias("keys"))
        .mapInPandas(near, "place long, family string, others array<string>")
    )


def first_keys(first: str, nick: Nicknames) -> list[str]:
    """Keys of which first names that can be one share at least one: the first two letters of each reading, as one
    edit leaves one of them among the other's first two; and the last three letters of others than the shortest, which stay
    where both edits hit the beginning."""
    if len(first) == 1:
        return [first]
    return sorted({k for n in nick.names(first) for k in (*n[:2], *([f"-{n[-3:]}"] if len(n) > 3 else []))})


def variant_pairs(persons: DataFrame) -> DataFrame:
    """(person_id_a, person_id_b) of the ids of a bundle that mean one human."""
    spark = persons.sparkSession
    ws = Workspace(spark, "spellings")
    shared = spark.sparkContext.broadcast(learned_nicknames(persons))
    known = ws.cut(profiles(persons, shared, learned_scripts(persons)))
    met = ws.cut(meetings(ws, known))
    # all that is known of those who met; rows that say the same come together by number, without another exchange
    there = met.select(F.explode(F.array("who1", "who2")).alias("who"))
    active = ws.cut(
        known.select("who", "bundle_id", "id", "birth", "sex", "given", "family").join(there.hint("merge"), "who", "left_semi").distinct()
    )
    ws.drop(known)
    pairs = ws.cut(judged(met, active, shared).distinct())
    ws.drop(met)

    # spellings of one third name may be further apart: they are judged with more patience
    via = pairs.select("who1", "who2").unionByName(pairs.select(F.col("who2").alias("who1"), F.col("who1").alias("who2")))
    via = via.select("who1", F.col("who2").alias("middle"))
    hops = (
        via.join(via.withColumnRenamed("who1", "who2").hint("merge"), "middle")
        .where("who1 < who2")
        .select("who1", "who2")
        .distinct()
        .join(pairs.select("who1", "who2"), ["who1", "who2"], "left_anti")
    )
    more = judged(hops, active, shared, slack=2)
    return pairs.unionByName(more).select("person_id_a", "person_id_b").distinct()


def meetings(ws: Workspace, known: DataFrame) -> DataFrame:
    """(who1, who2), who1 < who2: those of one bundle, births in one year or the next, families within the edit distance,
    first names with a common key and no different sex."""
    # one id's own years: a pair is at most a year apart, so it meets in the bucket of the later one
    placed = known.select("*", F.explode(F.array("year", F.col("year") + 1)).alias("bucket")).select(
        F.xxhash64("bundle_id", "bucket").alias("place"), "family", "who", (F.col("bucket") > F.col("year")).alias("late"), "sex", "letters"
    )
    near = ws.cut(neighbours(placed.select("place", "family")))
    # those who are the only one of their family in a bundle and year, and without neighbours, meet nobody
    family = Window.partitionBy("place", "family")
    kept = (
        placed.join(near.hint("merge"), ["place", "family"], "left")
        .select("*", (F.min("who").over(family) < F.max("who").over(family)).alias("several"))
        .where("several or others is not null")
        .drop("several")
        .distinct()
    )
    # a pair of neighbours meets under the later name; rows that only have a third neighbour in common are left to the judge
    keyed = (
        kept.withColumn("name", F.explode(F.concat(F.array("family"), F.coalesce("others", F.array().cast("array<string>")))))
        .withColumn("letter", F.explode(F.split("letters", " ")))
        .select(F.xxhash64("place", "letter", "name").alias("key"), "who", "late", "sex")
    )
    return (
        _side(keyed, 1, "key")
        .join(_side(keyed, 2, "key").hint("merge"), "key")
        .where("who1 < who2 and (late1 or late2) and (sex1 is null or sex2 is null or sex1 = sex2)")
        .select("who1", "who2")
        .distinct()
    )


def _side(rows: DataFrame, n: int, *but: str) -> DataFrame:
    """One side of a meeting of rows with themselves.  Both sides are renamed, as only like plans become one exchange."""
    return rows.select(*[F.col(c).alias(c if c in but else f"{c}{n}") for c in rows.columns])


def judged(met: DataFrame, active: DataFrame, nicknames: Broadcast, slack: int = 0) -> DataFrame:
    """(who1, who2, person_id_a, person_id_b) of those (who1, who2) that have spellings of one name."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nick = nicknames.value
        for b in batches:
            # the numbers may agree by chance; bundles are compared here, as a join would exchange its sides by them too
            b = b[b["bundle_id1"] == b["bundle_id2"]]
            names = b[["birth1", "given1", "family1", "birth2", "given2", "family2"]]
            keep = [
                births_near(x[0], x[3]) and same_name((tuple(x[1].split()), x[2]), (tuple(x[4].split()), x[5]), nick, slack) is not None
                for x in names.itertuples(index=False, name=None)
            ]
            b = b[keep]
            ids = b[["id1", "id2"]]
            yield pd.DataFrame({"who1": b["who1"], "who2": b["who2"], "person_id_a": ids.min(axis=1).astype(object), "person_id_b": ids.max(axis=1).astype(object)})

    return (
        met.join(_side(active, 1).hint("merge"), "who1")
        .join(_side(active, 2).hint("merge"), "who2")
        .where("id1 <> id2 and (sex1 is null or sex2 is null or sex1 = sex2)")
        .select("who1", "who2", "bundle_id1", "id1", "birth1", "given1", "family1", "bundle_id2", "id2", "birth2", "given2", "family2")
        .mapInPandas(judge, "who1 long, who2 long, person_id_a string, person_id_b string")
    )

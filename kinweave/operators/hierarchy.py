"""Parent-child links to full lines of descent (problem 1).

Method: tree contraction.  A round removes a set of persons and records what it removed:
  leaves     persons without a child left; their links to their parents are recorded;
  tops       persons without a parent left; all their founders are known, so their children take these over;
  chain links  persons of whom no neighbour is removed and whose links are at least as many as the links from
             their children to their parents that replace them (one parent, or one child, or two of both): this
             is unary-chain compression, taken to persons with two known parents as well.
The chain links of a round are those whose hash for that round is least among their neighbours, so a constant
share of what is left goes in every round and the rounds grow with the logarithm of the persons, on pedigrees
with both parents known too.  The recorded contractions are then reversed, latest first, which gives every
person their founders and the number of steps to them.

Loops do not stop it: a loop shrinks to a person who is their own parent, which is marked and taken off.
Reversed, a person lies on a loop if one of the parents and one of the children that they had when they were
removed lie on the same one.  Where a round removes too few (a dense knot of loops) the next may add links.

Every step joins on a person id; no component, bundle or line is ever gathered in one task.

Defined results: null and empty ids name nobody and are dropped; repeated links count once; a person whose
only recorded parent is themselves has no founder but is a cycle; empty tables give no row; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.workspace import Workspace

PARENT_ROLES = ("father", "mother", "parent")
CYCLE = "CYCLE"


def parent_links(families: DataFrame, vital_events: DataFrame, persons: DataFrame) -> DataFrame:
    """(child, parent) as the families and the birth events record them, repeats included."""
    known = lambda c: c.isNotNull() & (c != "")
    by_family = (
        families.select(
            F.col("union_block.persons.person_id").alias("parents"), F.col("children.person_id").alias("kids")
        )
        .where((F.size("parents") > 0) & (F.size("kids") > 0))
        .select("kids", F.explode("parents").alias("parent"))
        .select(F.explode("kids").alias("child"), "parent")
    )
    named = vital_events.where(F.col("id").isNotNull()).select(
        F.col("id").alias("event"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter("participants", lambda x: x["role"].isin(*PARENT_ROLES)), lambda x: x["entity_id"]
                )
            )
        ).alias("parent"),
    )
    born = persons.where(F.col("birth.event_id").isNotNull()).select(
        F.col("id").alias("child"), F.col("birth.event_id").alias("event")
    )
    by_event = born.join(named, "event").select("child", "parent")
    return by_family.unionByName(by_event).where(known(F.col("child")) & known(F.col("parent")))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


STAY, LEAF, TOP, LINK = range(4)  # what becomes of a person in a round


class _Round(NamedTuple):
    """What one round removed."""

    up: DataFrame  # (child, parent, steps): links of leaves and chain links to the parents they had
    down: DataFrame  # (child, parent): links of chain links and tops to the children they had
    roots: DataFrame  # (child, root, steps, kind): founders gathered by removed persons
    n_links: int  # chain links removed


class _Contraction:
    """The state of one run, all as written tables.

    live(child, parent, steps) are the links left; gathered(child, root, steps) holds each founder that a
    person still there reaches by links already contracted.  With paths both also have through, the persons
    between the two ends: of the shortest ways the first in the order of these persons' ids.
    """

    def __init__(self, spark: SparkSession, links: DataFrame, paths: bool = False):
        self.ws = Workspace(spark, "hierarchy")
        self.way = ["steps", "through"] if paths else ["steps"]
        every = self.ws.cut(links.select("child", "parent").distinct())
        self.loops = every.where("child = parent").select(F.col("child").alias("person"))
        self.marks = [self.loops]
        has_parent = every.select(F.col("child").alias("parent")).distinct()
        # one pass over the links tells founders from the rest
        nobody = F.array().cast("array<string>").alias("through")
        marked, seen = self.ws.cut_counted(
            every.where("child <> parent")
            .join(has_parent.withColumn("inner", F.lit(True)), "parent", "left")
            .select("child", "parent", *[F.lit(1).alias("steps"), nobody][: len(self.way)], F.col("inner").isNotNull().alias("inner")),
            inner="inner",
        )
        self.gathered = marked.where("not inner").select("child", F.col("parent").alias("root"), *self.way)
        self.live = marked.where("inner").select("child", "parent", *self.way)
        self.n_live = seen["inner"]
        self.rounds: list[_Round] = []
        self.looping = False

    def _first_part(self, end: str = "parent") -> list:
        """The columns of a way whose end is the begin of another, to be joined on via."""
        return ["child", F.col(end).alias("via"), *[F.col(c).alias(f"on_{c}") for c in self.way]]

    def _whole_way(self) -> list:
        """The columns of two ways joined on via, as one."""
        through = F.concat("on_through", F.array("via"), "through").alias("through")
        return [(F.col("steps") + F.col("on_steps")).alias("steps"), through][: len(self.way)]

    def _shortest(self, ways: DataFrame, *ends: str, **more) -> DataFrame:
        """One way for each pair of ends, with the greatest of each further column."""
        more = [F.max(c).alias(c) for c in more]
        if len(self.way) == 1:
            return ways.groupBy(*ends).agg(F.min("steps").alias("steps"), *more)
        return ways.groupBy(*ends).agg(F.min(F.struct(*self.way)).alias("way"), *more).select(*ends, "way.*", *[c for c in ways.columns if c in ("ck", "pk", "kind")])

    def contract(self) -> None:
        slack = 0
        while self.n_live:
            gone = self._round(len(self.rounds), slack)
            slack = 0 if gone > 1 / 16 else max(4, 2 * slack)

    def _round(self, seed: int, slack: int) -> float:
        """Removes one set of persons; returns the share of those there were."""
        rank = lambda c: F.xxhash64(c, F.lit(seed))
        end = lambda v, other, p: F.struct(v.alias("v"), rank(other).alias("near"), F.lit(p).alias("p"), F.lit(1 - p).alias("c"))
        child, parent = F.col("child"), F.col("parent")
        few = f"p * c <= p + c + {slack}"
        kind = F.when(F.col("c") == 0, LEAF).when(F.col("p") == 0, TOP).when(F.expr(few) & (rank(F.col("v")) < F.col("near")), LINK)
        nodes, seen = self.ws.cut_counted(
            self.live.select(F.inline(F.array(end(child, parent, 1), end(parent, child, 0))))
            .groupBy("v")
            .agg(F.sum("p").alias("p"), F.sum("c").alias("c"), F.min("near").alias("near"))
            .select("v", kind.otherwise(STAY).alias("kind")),
            gone=f"kind <> {STAY}",
            links=f"kind = {LINK}",
        )
        of = lambda end, name: nodes.select(F.col("v").alias(end), F.col("kind").alias(name))
        known = self.ws.cut(self.live.join(of("child", "ck"), "child").join(of("parent", "pk"), "parent").select("child", "parent", *self.way, "ck", "pk"))
        above = known.where(f"ck = {LINK}")
        below = known.where(f"pk = {LINK}")
        rest = known.where(f"ck <> {LINK} and pk <> {LINK}")
        if seen["links"]:
            past = below.select(*self._first_part(), "ck").join(above.drop("ck").withColumnRenamed("child", "via"), "via")
            rest = rest.unionByName(past.select("child", "parent", *self._whole_way(), "ck", "pk"))
            rest = self._shortest(rest, "child", "parent", ck=True, pk=True)
            rest, counts = self.ws.cut_counted(rest, around="child = parent", stay=f"child <> parent and ck = {STAY} and pk = {STAY}")
            if counts["around"]:
                self.looping = True
                self.marks.append(rest.where("child = parent").select(F.col("child").alias("person")))
                rest = rest.where("child <> parent")
            n_live = counts["stay"]
        else:
            n_live = rest.where(f"ck = {STAY} and pk = {STAY}").count()
        tops = rest.where(f"pk = {TOP}")
        heirs = below.unionByName(tops.where(f"ck <> {LEAF}"))
        got = heirs.select(*self._first_part(), F.col("ck").alias("kind")).join(self.gathered.withColumnRenamed("child", "via"), "via")
        # persons without any link left are done as well
        own = self.gathered.join(of("child", "kind"), "child", "left").withColumn("kind", F.coalesce("kind", F.lit(TOP)))
        ways = own.unionByName(got.select("child", "root", *self._whole_way(), "kind"))
        roots = self.ws.cut(self._shortest(ways, "child", "root", kind=True))
        up = above.unionByName(rest.where(f"ck = {LEAF}")).select("child", "parent", *self.way)
        down = below.unionByName(tops).select("child", "parent")
        self.rounds.append(_Round(up, down, roots.where(f"kind <> {STAY}"), seen["links"]))
        self.gathered = roots.where(f"kind = {STAY}").drop("kind")
        self.live = rest.where(f"ck = {STAY} and pk = {STAY}").select("child", "parent", *self.way)
        self.n_live = n_live
        return seen["gone"] / seen["n"]

    def founders(self) -> DataFrame:
        """(child, root, steps[, through]), reversing the recorded contractions."""
        done = [self.gathered]
        for k in reversed(range(len(self.rounds))):
            r = self.rounds[k]
            done.append(r.roots.where(f"kind = {TOP}").drop("kind"))
            further = r.up.select(*self._first_part()).join(_union(done).withColumnRenamed("child", "via"), "via")
            own = r.roots.where(f"kind <> {TOP}").drop("kind")
            got = self._shortest(own.unionByName(further.select("child", "root", *self._whole_way())), "child", "root")
            done.append(self.ws.cut(got) if k else got)
        return _union(done)

    def cyclic(self) -> DataFrame:
        """(person): everybody who is their own ancestor."""
        if not self.looping:
            return self.loops
        return self._loops().select("person")

    def _loops(self) -> DataFrame:
        """(person, loop): persons on a loop, those of one strongly connected part under one name."""
        mine = F.struct(F.lit(0).alias("known"), F.col("person").alias("name"))
        lab = self.ws.cut(_union(self.marks).distinct().select("person", mine.alias("loop")))
        for r in reversed(self.rounds):
            if not r.n_links:
                continue
            name = F.col("loop.name").alias("name")
            over = r.up.join(lab.select(F.col("person").alias("parent"), name), "parent").select(F.col("child").alias("person"), "name")
            under = r.down.join(lab.select(F.col("person").alias("child"), name), "child").select(F.col("parent").alias("person"), "name")
            met = over.join(under.distinct(), ["person", "name"]).select("person", F.struct(F.lit(1).alias("known"), "name").alias("loop"))
            lab = self.ws.cut(lab.unionByName(met).groupBy("person").agg(F.max("loop").alias("loop")))
        return lab.select("person", F.col("loop.name").alias("loop"))

    def above_loops(self) -> DataFrame:
        """(person): everybody on a loop or with a loop below them."""
        lab = self.ws.cut(self.cyclic().distinct())
        for r in reversed(self.rounds):
            met = r.down.join(lab.withColumnRenamed("person", "child"), "child", "left_semi").select(F.col("parent").alias("person"))
            lab = self.ws.cut(lab.unionByName(met).distinct())
        return lab


def lines_of_descent(spark: SparkSession, links: DataFrame) -> DataFrame:
    """person_id, root_id, steps: every founder of every person with the fewest steps to them; root_id is
    'CYCLE' (steps null) for persons who are their own ancestor.  ``links`` has (child, parent)."""
    return _descent(_Contraction(spark, links))


def _descent(state: _Contraction) -> DataFrame:
    state.contract()
    lines = state.founders().select(F.col("child").alias("person_id"), F.col("root").alias("root_id"), *state.way)
    loops = state.cyclic().select(F.col("person").alias("person_id"), F.lit(CYCLE).alias("root_id"), F.lit(None).cast("int").alias("steps"))
    return lines.unionByName(loops, allowMissingColumns=True)


def descendants(lines: DataFrame) -> DataFrame:
    """root_id, n_descendants, max_steps of each founder."""
    return (
        lines.where(F.col("root_id") != CYCLE)
        .groupBy("root_id")
        .agg(F.count("*").alias("n_descendants"), F.max("steps").alias("max_steps"))
    )


def lines_with_paths(spark: SparkSession, links: DataFrame) -> DataFrame:
    """The lines of descent with path, the persons of each line from the person up to the founder; null for
    loops.  Of several lines with the fewest steps it is the one by the least parent at every step.

    The contracted links keep the persons that they pass, so reversing the contractions gives the paths."""
    lines = _descent(_Contraction(spark, links, paths=True))
    path = F.when(F.col("steps").isNotNull(), F.concat(F.array("person_id"), "through", F.array("root_id")))
    return lines.select("person_id", "root_id", "steps", path.alias("path"))


def all_descendants(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(ancestor_id, person_id, steps): every descendant of every person with the fewest steps between them;
    who is their own ancestor comes out as their own descendant.

    Distances double: what is up to h steps away goes on from the ancestors exactly h steps away; only pairs
    that are new are written.  Persons are numbered first, so the pairs that go about are small."""
    ws = Workspace(spark, "descendants")
    named = ws.cut(links.select("child", "parent").distinct())
    people = named.select(F.inline(F.array(F.struct(F.col("child").alias("name")), F.struct(F.col("parent").alias("name"))))).distinct()
    people = ws.cut(people.withColumn("number", F.monotonically_increasing_id()))  # written, so the numbers stay
    of = lambda end: people.select(F.col("name").alias(f"{end}_name"), F.col("number").alias(end))
    pairs = named.select(F.col("child").alias("child_name"), F.col("parent").alias("parent_name"))
    pairs = pairs.join(of("child"), "child_name").join(of("parent"), "parent_name").select("child", "parent", F.lit(1).alias("steps"))
    first, seen = ws.cut_counted(pairs, far="steps = 1")
    reach, last, h = [first], first, 1
    while seen["far"]:
        up = _union(reach).select(F.col("child").alias("parent"), F.col("parent").alias("next"), F.col("steps").alias("more"))
        longer = (
            last.where(F.col("steps") == h).join(up, "parent")
            .select("child", F.col("next").alias("parent"), (F.col("steps") + F.col("more")).alias("steps"))
            .groupBy("child", "parent").agg(F.min("steps").alias("steps"))
        )
        h *= 2
        last, seen = ws.cut_counted(longer.join(_union(reach), ["child", "parent"], "left_anti"), far=f"steps = {h}")
        reach.append(last)
    whole = _union(reach).join(of("child"), "child").join(of("parent"), "parent")
    return whole.select(F.col("parent_name").alias("ancestor_id"), F.col("child_name").alias("person_id"), "steps")

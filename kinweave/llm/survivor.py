"""Best representative of each duplicate group (problem 4).

Two parts.  ``survivors`` applies the fixed rule that the data's statement gives: one aggregation by id, each
field by its own order, so no group is ever gathered.  ``latent_truth`` is the quality model named for the
problem: every source (the exporter in created_by) has a sensitivity and a specificity, every value of an
entity's field is true or not, and expectation-maximisation alternates between them; a field with several
values keeps each one judged true.  The model cannot give the rule's result (it judges values, the rule picks
rows by stored confidence), so the rule decides p4_found and the model p4_truth; ``agreement`` tells how often
the value of the row that the rule picks is one that the model keeps.

The model never pairs values with sources: an entity's silent sources enter as one sum per entity and field,
from which a claim replaces its own term.  Ids of any number of rows therefore cost one pass.

Defined results: ids with one row have no survivor; null ids form no group; no row where no candidate exists;
null confidence, unreadable updated_at and NaN are lowest; exact copies tie down to the smallest row_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.plans.workspace import Workspace

FIELDS = ("birth_date", "death_date", "names")


def survivors(persons: DataFrame) -> DataFrame:
    """(person_id, field_name, row_id) of the row whose value survives."""
    instant = F.try_to_timestamp(F.col("updated_at"))
    last = [instant.alias("at"), (-F.col("row_id")).alias("minus_row")]

    def block(name: str) -> Column:
        value = F.col(f"{name}.date.value")
        confidence = F.col(f"{name}.confidence")
        rank = F.struct(F.when(~F.isnan(confidence), confidence).alias("c"), F.length(value).alias("n"), *last)
        return F.max(F.when(value.isNotNull(), rank))["minus_row"]

    shown = F.size(F.array_distinct(F.filter("identity.names.display", lambda x: x.isNotNull())))
    names = F.max(F.when(F.size("identity.names") > 0, F.struct(shown.alias("n"), *last)))["minus_row"]
    best = (
        persons.where("id is not null")
        .groupBy("id")
        .agg(
            F.count("*").alias("n"),
            F.array(
                *[
                    F.struct(F.lit(f).alias("field_name"), (-c).alias("row_id"))
                    for f, c in zip(FIELDS, (block("birth"), block("death"), names), strict=True)
                ]
            ).alias("best"),
        )
        .where("n > 1")
    )
    return (
        best.select(F.col("id").alias("person_id"), F.explode("best").alias("b"))
        .select("person_id", "b.*")
        .where("row_id is not null")
    )


def claims(persons: DataFrame) -> DataFrame:
    """(id, field_name, value, source), distinct: what each exporter says of ids with several rows."""
    each = F.concat(
        F.array(
            F.struct(F.lit("birth_date").alias("field_name"), F.col("birth.date.value").alias("value")),
            F.struct(F.lit("death_date").alias("field_name"), F.col("death.date.value").alias("value")),
        ),
        F.transform(
            F.coalesce("identity.names.display", F.array().cast("array<string>")),
            lambda x: F.struct(F.lit("names").alias("field_name"), x.alias("value")),
        ),
    )
    several = persons.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    return (
        persons.select("id", F.coalesce("created_by", F.lit("?")).alias("source"), F.explode(each).alias("c"))
        .select("id", "source", "c.*")
        .where("value is not null")
        .distinct()
        .join(several, "id", "left_semi")
    )


def latent_truth(persons: DataFrame, most_rounds: int = 30, still: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """values (id, field_name, value, n_sources, probability, kept) and sources (source, field_name,
    sensitivity, specificity).  kept: of a date the likeliest value, of names every value of probability
    one half or more.  The prior share of true values of a field counts one for each entity.  The rounds end when
    no sensitivity or specificity moves by more than still, or after most_rounds."""
    ws = Workspace(persons.sparkSession, "truth")
    said = ws.cut(claims(persons))
    group = ["id", "field_name"]
    covers = ws.cut(said.select(*group, "source").distinct())
    quality = covers.select("source", "field_name").distinct().select(
        "source", "field_name", F.lit(0.8).alias("sensitivity"), F.lit(0.9).alias("specificity")
    )
    named = said.select(*group, "value").distinct().groupBy(*group).count()
    counts = named.groupBy("field_name").agg(F.count("*").alias("entities"), F.sum("count").alias("values")).collect()
    share = dict.fromkeys(FIELDS, 0.5) | {r.field_name: min(0.9, r.entities / r["values"]) for r in counts}
    values = None
    for _ in range(most_rounds):
        odds = quality.select(
            "source",
            "field_name",
            F.log((1 - F.col("sensitivity")) / F.col("specificity")).alias("silent"),
            F.log(F.col("sensitivity") / (1 - F.col("specificity"))).alias("claimed"),
        )
        silent = covers.join(odds, ["source", "field_name"]).groupBy(*group).agg(F.sum("silent").alias("silent"))
        claimed = (
            said.join(odds, ["source", "field_name"])
            .groupBy(*group, "value")
            .agg(F.sum(F.col("claimed") - F.col("silent")).alias("claimed"), F.count("*").alias("n_sources"))
        )
        odds_of = F.create_map(*[F.lit(x) for f in FIELDS for x in (f, math.log(share[f] / (1 - share[f])))])
        logit = odds_of[F.col("field_name")] + F.col("silent") + F.col("claimed")
        values = ws.cut(
            claimed.join(silent, group).select(*group, "value", "n_sources", (1 / (1 + F.exp(-logit))).alias("probability"))
        )
        totals = values.groupBy(*group).agg(F.sum("probability").alias("p"), F.sum(1 - F.col("probability")).alias("q"))
        could = covers.join(totals, group).groupBy("source", "field_name").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        did = (
            said.join(values, [*group, "value"])
            .groupBy("source", "field_name")
            .agg(F.sum("probability").alias("tp"), F.sum(1 - F.col("probability")).alias("fp"))
        )
        # one pseudo-count each way keeps both rates away from 0 and 1
        rates = could.join(did, ["source", "field_name"], "left").select(
            "source",
            "field_name",
            ((F.coalesce("tp", F.lit(0.0)) + 1) / (F.col("p") + 2)).alias("sensitivity"),
            ((F.col("q") - F.coalesce("fp", F.lit(0.0)) + 1) / (F.col("q") + 2)).alias("specificity"),
        )
        # a claim never speaks against a value: else two poor sources could turn the model upside down
        new = ws.cut(rates.withColumn("specificity", F.greatest("specificity", 1 - F.col("sensitivity"))))
        before = quality.select("source", "field_name", F.col("sensitivity").alias("s"), F.col("specificity").alias("t"))
        moved = new.join(before, ["source", "field_name"]).agg(F.max(F.greatest(F.abs(F.col("sensitivity") - F.col("s")), F.abs(F.col("specificity") - F.col("t"))))).first()[0]
        quality = new
        if (moved or 0.0) <= still:
            break
    best = values.groupBy(*group).agg(F.max(F.struct("probability", "value")).alias("best"))
    kept = F.when(F.col("field_name") == "names", F.col("probability") >= 0.5).otherwise(
        F.col("value") == F.col("best.value")
    )
    return values.join(best, group).withColumn("kept", kept).drop("best"), quality


def agreement(persons: DataFrame) -> DataFrame:
    """(field_name, n_survivors, n_kept): survivors by the rule, and those whose value (every name, for names) the
    quality model keeps too."""
    values, _ = latent_truth(persons)
    picked = survivors(persons).withColumnRenamed("person_id", "id")
    names = F.array_distinct(F.filter("identity.names.display", lambda x: x.isNotNull()))
    shown = F.when(F.col("field_name") == "names", names).otherwise(
        F.array(F.when(F.col("field_name") == "birth_date", F.col("birth.date.value")).otherwise(F.col("death.date.value")))
    )
    rows = persons.select("row_id", "identity", "birth", "death").join(picked, "row_id")
    each = rows.select("row_id", "id", "field_name", F.explode(shown).alias("value"))
    judged = each.join(values.select("id", "field_name", "value", "kept"), ["id", "field_name", "value"], "left")
    whole = judged.groupBy("row_id", "field_name").agg(F.min(F.coalesce("kept", F.lit(False))).alias("kept"))
    return whole.groupBy("field_name").agg(F.count("*").alias("n_survivors"), F.count_if("kept").alias("n_kept"))

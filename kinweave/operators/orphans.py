"""References to records that do not exist (problem 6).

Method: the distinct keys of the target tables and the distinct keys that are referred to are coded as dense
integers in one order, each side keeping its own rows.  The sorted codes of the target rows alone are
compressed into runs of neighbours of one state (alive or all deleted), one row a run, broken by every key
that no target row has.  Each reference is matched as of its code to the run that starts at or before it: it
is missing if it lies beyond that run's end, deleted if the run is.  A run also has its latest arrival;
references older than that are compared with the arrival of their own target row, which is the exact check
that tells late ones.

Scale: references are reduced to distinct keys before anything is ordered, so a key that a third of all rows
refer to is one row here.  Keys are coded within buckets of a hash of the key (the number of buckets grows
with the tables), so no window holds a whole table.  Only faulty keys, few by nature, meet the references
again, by an ordinary join that adaptive execution may broadcast by measured size or split where skewed.

Defined results: null and blank references are no references; keys are compared trimmed and lower-cased;
link endpoints of no known entity type have no target table and are not judged; rows of one id that carry the
same reference count once, at their earliest arrival; an empty target table makes every reference missing;
a row without ingested_at is never late and makes no target late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.workspace import Workspace

ENTITY_TABLES = {"person": "persons", "family": "families", "event": "vital_events"}


def normal_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def references(persons: DataFrame, occupations: DataFrame, links: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, target_table, target_id, at), one row per stored reference."""

    def of(df: DataFrame, name: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
        each = [
            F.struct(F.lit(f).alias("field_name"), t.alias("target_table"), normal_key(c).alias("target_id"))
            for f, (c, t) in fields.items()
        ]
        return (
            df.select(F.col("id").alias("record_id"), F.col("ingested_at").alias("at"), F.explode(F.array(*each)).alias("r"))
            .select(F.lit(name).alias("table_name"), "record_id", "at", "r.*")
            .where("target_id <> '' and target_table is not null")
        )

    person_fields = {
        f"{block}.{key}_id": (F.col(f"{block}.{key}_id"), F.lit(f"{key}s"))
        for block in ("birth", "death")
        for key in ("place", "source")
    }
    kind = F.create_map(*[F.lit(x) for pair in ENTITY_TABLES.items() for x in pair])
    ends = {f"{e}.entity_id": (F.col(f"{e}.entity_id"), kind[F.col(f"{e}.entity_type")]) for e in ("from_end", "to_end")}
    return (
        of(persons, "persons", person_fields)
        .unionByName(of(occupations, "occupations", {"person_id": (F.col("person_id"), F.lit("persons"))}))
        .unionByName(of(links, "links", ends))
    )


def parent_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(target_table, target_id, alive, born): one row per stored row of the target tables."""
    parts = [
        df.select(
            F.lit(name).alias("target_table"),
            normal_key(F.col("id")).alias("target_id"),
            (F.col("deleted_at").isNull() if "deleted_at" in df.columns else F.lit(True)).alias("alive"),
            F.col("ingested_at").alias("born"),
        ).where("target_id is not null")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coded_keys(refs: DataFrame, parents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, code, target_table, target_id, alive, born, asked): one row for each distinct key of the targets
    (asked null) and one for each distinct key referred to (alive null), coded in one order within a bucket."""
    held = parents.groupBy("target_table", "target_id").agg(F.max("alive").alias("alive"), F.min(F.col("born").cast("timestamp")).alias("born"))
    sought = refs.groupBy("target_table", "target_id").agg(F.min(F.col("at").cast("timestamp")).alias("asked"))
    rows = held.withColumn("asked", F.lit(None).cast("timestamp")).unionByName(
        sought.select("target_table", "target_id", F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast("timestamp").alias("born"), "asked")
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("target_table", "target_id"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("bucket").orderBy("target_table", "target_id")
    return rows.withColumn("code", F.dense_rank().over(order))


def key_runs(keys: DataFrame) -> DataFrame:
    """(bucket, first, last, alive, latest): the sorted codes of target keys (bucket, code, alive, born),
    distinct, as runs of neighbours of one state."""
    order = Window.partitionBy("bucket").orderBy("code")
    before = F.lag(F.struct("code", "alive")).over(order)
    goes_on = (before["code"] + 1 == F.col("code")) & (before["alive"] == F.col("alive"))
    begins = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return (
        keys.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("bucket", "run")
        .agg(F.min("code").alias("first"), F.max("code").alias("last"), F.first("alive").alias("alive"), F.max("born").alias("latest"))
        .drop("run")
    )


def as_of_runs(sought: DataFrame, runs: DataFrame) -> DataFrame:
    """sought (bucket, code, asked) with run, the last run that starts at or before the code."""
    run = F.struct("first", "last", "alive", "latest")
    none = F.lit(None)
    starts = runs.select("bucket", F.col("first").alias("code"), F.lit(0).alias("side"), none.cast("timestamp").alias("asked"), run.alias("starts"))
    both = starts.unionByName(sought.select("bucket", "code", F.lit(1).alias("side"), "asked", none.cast(starts.schema["starts"].dataType).alias("starts")))
    so_far = Window.partitionBy("bucket").orderBy("code", "side").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("run", F.last("starts", ignorenulls=True).over(so_far))
    return matched.where("side = 1").select("bucket", "code", "asked", "run")


def faulty_references(refs: DataFrame, parents: DataFrame, buckets: int | None = None) -> DataFrame:
    """table_name, record_id, field_name, target_id, reason, period."""
    spark = refs.sparkSession
    buckets = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = Workspace(spark, "orphans").cut(coded_keys(refs, parents, buckets))
    held = coded.where("alive is not null").select("bucket", "code", "alive", "born")
    matched = as_of_runs(coded.where("alive is null").select("bucket", "code", "asked"), key_runs(held))
    beyond = F.col("run").isNull() | (F.col("code") > F.col("run.last"))
    judged = matched.select("bucket", "code", "asked", F.when(beyond, "missing").when(~F.col("run.alive"), "deleted").when(F.col("asked") < F.col("run.latest"), "late").alias("reason"))
    none = F.lit(None).cast("timestamp").alias("born")
    late = judged.where("reason = 'late'").join(held.select("bucket", "code", "born"), ["bucket", "code"]).where("asked < born")
    faults = judged.where("reason in ('missing', 'deleted')").select("bucket", "code", "reason", none).unionByName(late.select("bucket", "code", "reason", "born"))
    suspects = faults.join(coded.where("alive is null").select("bucket", "code", "target_table", "target_id"), ["bucket", "code"]).drop("bucket", "code")
    return (
        refs.join(suspects, ["target_table", "target_id"])
        .groupBy("table_name", "record_id", "field_name", "target_table", "target_id", "reason", "born")
        .agg(F.min("at").alias("at"))
        .where((F.col("reason") != "late") | (F.col("at") < F.col("born")))
        .select(
            "table_name", "record_id", "field_name", "target_id", "reason", F.date_format("at", "yyyy-MM").alias("period")
        )
        .distinct()
    )

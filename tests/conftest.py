import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATE = "struct<value:string,calendar:string,precision:string,circa:boolean,confidence:double,note:string>"
VITAL = f"struct<date:{DATE},place_id:string,cause:string,confidence:double,source_id:string,event_id:string>"
COMP = "struct<kind:string,value:string,value_latin:string,reading:string,reading_system:string,order_num:int>"
NAME = f"struct<display:string,display_latin:string,culture:string,direction:string,display_order:string,reading:string,reading_system:string,components:array<{COMP}>>"
NAMES = f"array<struct<kind:string,display:string,culture:string,source_id:string,confidence:double,components:array<{COMP}>>>"
SCHEMAS = {
    "persons": f"row_id long, id string, bundle_id string, axgf_version string, created_at string, updated_at string, version_num int, created_by string, identity struct<name:{NAME},names:{NAMES},gender:struct<value:string>,is_living:boolean,visibility:string>, birth {VITAL}, death {VITAL}, bio string, deleted_at timestamp, ingested_at timestamp",
    "families": f"id string, bundle_id string, name string, union_block struct<kind:string,status:string,persons:array<struct<person_id:string,role:string>>,start_block:struct<date:{DATE},place_id:string,event_id:string>,confidence:double,source_id:string>, children array<struct<person_id:string,birth_order:int,note:string>>, updated_at string, ingested_at timestamp",
    "vital_events": f"id string, bundle_id string, category string, event_date {DATE}, place_id string, source_id string, participants array<struct<entity_type:string,entity_id:string,role:string>>, description string, confidence double, ingested_at timestamp",
    "occupations": "id string, bundle_id string, person_id string, title string, title_latin string, title_normalized string, place_id string, source_id string, valid_from string, confidence double, created_by string, ingested_at timestamp",
    "links": "id string, bundle_id string, from_end struct<entity_type:string,entity_id:string>, to_end struct<entity_type:string,entity_id:string>, label string, category string, bidirectional boolean, confidence double, ingested_at timestamp",
    "places": "id string, bundle_id string, names array<struct<lang:string,value:string,is_primary:boolean>>, place_type string, country_current string, coordinates struct<lat:double,lon:double>, deleted_at timestamp, ingested_at timestamp",
    "sources": "id string, bundle_id string, title string, source_type string, reliability string, confidence double, status string, place_id string, language string, deleted_at timestamp, ingested_at timestamp",
    "gedcom_lines": "file_id string, line_no long, level int, xref string, tag string, value string, ingested_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, doc_kind string, ingested_at timestamp",
    "review_labels": "doc_id long, reviewer string, is_abusive boolean, reviewed_at timestamp",
    "title_reference": "title_code string, title string, lang string, is_preferred boolean",
    "eval_items": "item_id long, task string, lang string, text string",
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Tables:
    """Small tables of the data's schemas: rows are dicts, what is not given is null."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, name, rows=()):
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(SCHEMAS[name])

        def fit(kind, value):
            if value is None:
                return None
            if isinstance(kind, StructType):
                return tuple(fit(f.dataType, value.get(f.name)) for f in kind.fields)
            if kind.typeName() == "array":
                return [fit(kind.elementType, x) for x in value]
            return value

        return self.spark.createDataFrame([fit(schema, r) for r in rows], schema)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark)


def clashing(df, *names):
    """The table with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def clash():
    return clashing

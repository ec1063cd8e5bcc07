"""The helpers by name, for SQL users."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import rawjson
from kinweave.operators import refs, schema


def register(spark: SparkSession) -> None:
    """schema_problems(collection, body) -> array, scrub_refs(body, id, drop) and
    rewrite_refs(body, old, new) -> body, walk_refs(body) -> array of (key, target, via)."""
    text, items = T.StringType(), T.ArrayType(T.StringType())
    walked = T.ArrayType(T.StructType([T.StructField(n, text) for n in ("key", "target", "via")]))

    @F.pandas_udf(items)
    def schema_problems(collection: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([[f"{p}: {w}" for p, w in schema.problems(c, b)] for c, b in zip(collection, body, strict=True)])

    def changed(body, edit):
        document = rawjson.parse(body)
        edit(document)
        return rawjson.dump(document)

    @F.pandas_udf(text)
    def scrub_refs(body: pd.Series, target: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([changed(b, lambda d, t=t, k=k: refs.scrub(d, {t}, bool(k))) if b else b for b, t, k in zip(body, target, drop, strict=True)])

    @F.pandas_udf(text)
    def rewrite_refs(body: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([changed(b, lambda d, o=o, n=n: refs.rewrite(d, {o: n})) if b else b for b, o, n in zip(body, old, new, strict=True)])

    @F.pandas_udf(walked)
    def walk_refs(body: pd.Series) -> pd.Series:
        return body.map(lambda b: [{"key": k, "target": t, "via": v} for k, t, v in refs._walk(rawjson.parse(b), None, False)] if b else [])

    for name, f in {"schema_problems": schema_problems, "scrub_refs": scrub_refs, "rewrite_refs": rewrite_refs, "walk_refs": walk_refs}.items():
        spark.udf.register(name, f)

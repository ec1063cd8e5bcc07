"""Reading tables and cutting lineage.

Iterative operators write each round as a Parquet table below the folder that the session names in
``spark.checkpoint.dir``: all executors share it, so a lost executor loses no round, and a written table
is columnar, compressed and has size statistics that the next join can use.  Only where the setting is
absent (local sessions, tests) is a folder of this process used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kinweave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Workspace:
    """Written intermediate tables of one operator run.

    ``cut`` writes a DataFrame and returns the table read back; ``drop`` deletes what is no longer needed.
    Tables that the returned result still reads stay until the session ends; then the whole folder goes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, tuple[str, DataFrame]] = {}
        atexit.register(self._delete, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (path, out)
        return out

    def cut_counted(self, df: DataFrame, **conditions) -> tuple[DataFrame, dict[str, int]]:
        """As cut; the write itself also counts the rows ('n') and those that meet each condition."""
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()]
        out = self.cut(df.observe(seen, *counts))
        return out, seen.get

    def drop(self, df: DataFrame) -> None:
        path, _ = self._at.pop(id(df), (None, None))
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Deletes all tables of the run; nothing that reads them may be used any more."""
        self._at.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the shared folder is cleaned by its owner
            pass

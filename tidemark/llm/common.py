"""Helpers shared by the corpus operators: shared-folder tables and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
WHITE_SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE_SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset in local mode.

    On a cluster it must be set: a folder of the driver's machine is none of the executors'.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of the operators that run now: inner ones lie within the outermost.
_open_folders: list[str] = []


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes tables that no returned DataFrame reads any more. Within ``with``, the tables of
    operators called meanwhile are placed under this one's folder, which goes as a whole at the end.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        outer = _open_folders[-1] if _open_folders else shared_folder(spark)
        self.root = f"{outer}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        _open_folders.append(self.root)
        return self

    def __exit__(self, *_) -> None:
        _open_folders.remove(self.root)
        self._delete(self.root)


def settled(spark: SparkSession, label: str, build) -> DataFrame:
    """The DataFrame that ``build`` returns, written once; all tables it was made from are removed."""
    result = Scratch(spark, label)
    with Scratch(spark, f"{label}-work"):
        return result.save(build(), "result")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has, in any case of letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A reproducible uniform double in (0, 1) from a row's own values."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def running_total(df: DataFrame, group: str, bucket: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows before this one in its group.

    ``bucket`` must be non-decreasing in ``order``. The rows are summed by (group, bucket) with
    map-side partial sums, the few bucket sums are accumulated, and only rows of one bucket ever
    meet in a task, so a group that holds a third of all rows is spread over its buckets.
    Null is a group of its own.
    """
    keys = [F.col(group), F.col(bucket)]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")), "left")
        .withColumn(out, F.col(out) + F.col("_start"))
        .drop("_g", "_b", "_start")
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

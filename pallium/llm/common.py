"""Shared helpers: table access, scratch tables in the shared folder, whitespace words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a folder of our own.

    The own folder is only made in local mode, where the executors are threads of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='pallium-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _written:
        try:
            jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the JVM may have gone first; the folder is temporary by contract
            return


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for; `new` lists those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def bounded_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows of df with the smallest hash of `key`, of `total` rows.

    A threshold on the hash leaves about 4 n rows before they are ordered, however large df is.
    """
    share = min(1.0, 4 * n / max(total, 1))
    near = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int(share * (1 << 40))
    return df.filter(near).orderBy(F.xxhash64(F.lit("sample"), key), key).limit(n)


def slices(batch, rows: int = 512):
    """Parts of an Arrow batch, so that Python objects of only a few hundred texts exist at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)

"""Shared pieces of the text operators: table access, staging, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than the six ASCII white-space ones.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE_SPACE = " \t\n\x0b\f\r"
#: Java pattern of what separates words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where df has a column of that name already."""
    have = {c.lower() for c in df.columns}
    return [name + "_" * next(n for n in range(len(have) + 1) if name.lower() + "_" * n not in have) for name in names]


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir of the session.

    Only a local-mode session without that setting gets a temporary folder;
    on a cluster a missing setting is an error, as executors share no local disk.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="stage-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # the cleaner can then drop shuffle files that nothing needs any more
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def hinted(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A staged table of narrow rows, to be broadcast if it has few enough of them (about 60 MB); a longer one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(frames: Iterator, rows: int) -> Iterator:
    """Cut pandas batches to at most `rows` rows, which bounds what a task holds of long texts."""
    for pdf in frames:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]

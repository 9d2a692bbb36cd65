"""Datasets for training, validation and test: given one by one, or as splits of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.annotations import Dataset
from ..sources.staging import staged
from .folds import split_images

TAGS = ("train", "vali", "test")


def coerce_datasets(train: Dataset | None = None, vali: Dataset | None = None, test: Dataset | None = None, base: Dataset | None = None, factor: int = 3, no_test: bool = False, **options) -> dict[str, Dataset]:
    """The datasets by tag. Where none is given, base is split by stratified folds of images; no_test adds the test images to train."""
    given = {k: v for k, v in zip(TAGS, (train, vali, test)) if v is not None}
    if given or base is None:
        return given
    split = staged(split_images(base.annots, factor, **options), "splits")
    if no_test:
        split = split.withColumn("split", F.when(F.col("split") == "test", "train").otherwise(F.col("split")))
    return {tag: base.subset(split.where(F.col("split") == tag).select(F.col("image_id").alias("id"))) for tag in TAGS if not (no_test and tag == "test")}


def class_frequency(sets: dict[str, Dataset]) -> DataFrame:
    """name, annotations of that class in each set, and their sum; the rarest class first. Classes without annotations have zeros."""
    rows = reduce(DataFrame.unionAll, [d.annots.select("category_id", F.lit(tag).alias("tag")) for tag, d in sets.items()])
    names = reduce(DataFrame.unionAll, [d.categories.select(F.col("id").alias("category_id"), "name") for d in sets.values()]).distinct()
    wide = rows.groupBy("category_id").pivot("tag", list(sets)).agg(F.count(F.lit(1)))
    counts = [F.coalesce(F.col(tag), F.lit(0).cast("long")).alias(tag) for tag in sets]
    found = names.join(wide, "category_id", "left").select("name", *counts)
    return found.withColumn("sum", reduce(lambda a, b: a + b, [F.col(tag) for tag in sets])).orderBy("sum", "name")

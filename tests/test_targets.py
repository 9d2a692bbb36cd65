"""Targets without a key of a join, and samples that are of images alone."""

import pytest
from pyspark.sql import functions as F

from tesselar.operators import samples, targets
from tesselar.sources.annotations import Dataset

from .test_pixels import dataset


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id").alias("target_id"), F.when(F.col("id") < 40, F.col("id")).alias("vidid"))
    videos = spark.range(30).select(F.col("id").alias("vidid"), (F.col("id") * 2).alias("height"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met = targets.left_on(rows, videos, "vidid")
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1500
        got = {r.target_id: (r.vidid, r.height) for r in met.collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == {i: (i if i < 40 else None, 2 * i if i < 30 else None) for i in range(4000)}


def test_samples_of_stills(spark):
    """Samples of images alone are what they are among others, without a shuffle by sample; a missing image and no annotation leave a sample, and a video's sample is an error."""
    d = dataset(spark)
    asked = spark.createDataFrame([(1, 1, 0, 9, 0, 9), (2, 1, 8, 12, 10, 20), (3, 3, 0, 9, 0, 9), (4, 99, 0, 5, 0, 5)], "target_id long, image_id long, y0 long, y1 long, x0 long, x1 long")
    rows = lambda df: sorted(map(repr, df.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stills, any_ = targets.resolve(asked, d), targets.resolve(asked.withColumn("video_id", F.lit(None).cast("long")), d)
        assert rows(stills) == rows(any_)
        for annots in (d.annots, d.annots.withColumn("segmentation", F.array("x", "y"))):
            data = Dataset(d.images, d.videos, annots, d.categories)
            got = samples.load_samples(stills, data, "boxes+segmentation", stills=True)
            assert rows(got) == rows(samples.load_samples(any_, data, "boxes+segmentation"))
            assert {r.target_id: [a.aid for a in r.annots or ()] for r in got.collect()} == {1: [1], 2: [], 3: [], 4: []}
            plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert "hashpartitioning(target_id" not in plan and plan.count("Exchange hashpartitioning") == 3  # samples, images, annotations
        assert rows(samples.sample_annotations(stills, d, stills=True)) == rows(samples.sample_annotations(any_, d))
        plan = samples.sample_annotations(stills, d, stills=True)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("SortMergeJoin") == 2  # with images and with annotations: pairs bring their boxes along
        videos = targets.resolve(spark.createDataFrame([(5, 7)], "target_id long, video_id long"), d)
        assert [a.aid for a in samples.load_samples(videos, d).first().annots] == [1, 2]
        with pytest.raises(Exception, match="among stills"):
            samples.load_samples(videos, d, stills=True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

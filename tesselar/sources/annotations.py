"""Annotation datasets as DataFrames: images, videos, annotations and categories.

load_json reads the usual JSON layout of three row lists; derived builds a dataset of
any size from star-schema tables, for tests and benchmarks. The statements of
derived are plain SQL that other engines run too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = """SELECT o_orderkey AS id, o_custkey AS video_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS frame_index,
  CAST(400 + 100 * (o_orderkey % 5) AS INT) AS width, CAST(300 + 100 * (o_orderkey % 4) AS INT) AS height,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END AS DOUBLE) AS vid_scale
  FROM {orders}"""
VIDEOS = "SELECT c_custkey AS id, CAST(600 AS INT) AS width, CAST(600 AS INT) AS height FROM {customer}"
ANNOTS = """SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS id,
  l_orderkey AS image_id,
  CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 40 THEN 7
    WHEN p_type = 'SMALL' THEN 1 WHEN p_type = 'MEDIUM' THEN 2 WHEN p_type = 'LARGE' THEN 3
    WHEN p_type = 'ECONOMY' THEN 4 WHEN p_type = 'STANDARD' THEN 5 ELSE 6 END AS INT) AS category_id,
  CAST(CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE (l_partkey * 7) % 400 END AS DOUBLE) AS x,
  CAST((l_suppkey * 13 + l_partkey) % 300 AS DOUBLE) AS y,
  CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 40 THEN 300 ELSE 10 + 3 * l_quantity END AS DOUBLE) AS w,
  CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 40 THEN 300 ELSE 8 + 20 * l_linenumber END AS DOUBLE) AS h
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
CATEGORIES = """SELECT * FROM (VALUES (0, 'background', NULL), (1, 'small', 8), (2, 'medium', 8), (3, 'large', 8), (4, 'economy', 9),
  (5, 'standard', 9), (6, 'promo', 9), (7, 'ignore', NULL), (8, 'size', NULL), (9, 'market', NULL)) AS c(id, name, parent_id)"""
PARTS = {"images": IMAGES, "videos": VIDEOS, "annots": ANNOTS, "categories": CATEGORIES}
TABLES = ("orders", "customer", "lineitem", "part")


@dataclass(frozen=True)
class Dataset:
    """The tables of a dataset, all lazy."""

    images: DataFrame
    videos: DataFrame
    annots: DataFrame
    categories: DataFrame

    def subset(self, image_ids: DataFrame) -> Dataset:
        """The dataset of the images named in column id of image_ids, with the videos that these belong to."""
        ids = image_ids.select("id").distinct()
        images = self.images.join(ids, "id", "left_semi")
        annots = self.annots.join(ids.withColumnRenamed("id", "image_id"), "image_id", "left_semi")
        shown = images.where("video_id is not null").select(F.col("video_id").alias("id")).distinct() if "video_id" in images.columns else None
        videos = self.videos if shown is None else self.videos.join(shown, "id", "left_semi")
        return Dataset(images, videos, annots, self.categories)


def derived(spark: SparkSession, sf_dir: str) -> Dataset:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return Dataset(**{name: spark.sql(text, **{t: df for t, df in tables.items() if "{" + t + "}" in text}) for name, text in PARTS.items()})


def load_json(spark: SparkSession, path: str) -> Dataset:
    """A dataset from JSON files with lists images, annotations, categories and, maybe, videos."""
    whole = spark.read.json(path, multiLine=True)
    none = {"videos": "id long, width int, height int"}
    rows = lambda key: whole.select(F.inline(key)) if key in whole.columns else spark.createDataFrame([], none[key])
    annots = rows("annotations").select("id", "image_id", "category_id", *[F.get("bbox", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xywh")])
    return Dataset(rows("images"), rows("videos"), annots, rows("categories"))


#: WITH clause that gives other engines the same tables.
PRELUDE = "WITH " + ",\n".join(f"{name} AS ({text.format(**{t: t for t in TABLES})})" for name, text in PARTS.items())

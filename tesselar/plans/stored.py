"""Queries on datasets that are written as JSON lines and read again, and on their splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, rasters, splits
from ..sources.annotations import PRELUDE, Dataset, derived
from ..sources.lines import auxiliary_rows, load_lines, save_lines
from ..sources.staging import staging_folder
from .catalog import SQL as CATALOG_SQL
from .registry import registered
from .selection import SPLIT_SQL


def _stored(spark: SparkSession, data: Dataset) -> Dataset:
    path = f"{staging_folder(spark)}/dataset-{uuid.uuid4().hex}"
    save_lines(data, path)
    return load_lines(spark, path)


def _with_files(data: Dataset) -> Dataset:
    """Images with a file of their own but each fifth, and each second one with an auxiliary channel, warped either way."""
    three = lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    shift = (F.col("id") % 7).cast("double")
    none = F.lit(None).cast("array<double>")
    to_img = F.when(F.col("id") % 4 == 0, three(4.0, 0.5, shift, 0.0, 2.0, -1.0)).otherwise(none)
    to_aux = F.when(F.col("id") % 4 == 2, three(0.5, 0.0, shift, 0.0, 0.25, 3.0)).otherwise(none)
    aux = F.struct(F.concat(F.lit("aux"), F.col("id").cast("string"), F.lit(".tif")).alias("file_name"), F.lit("b").alias("channels"), to_img.alias("warp_aux_to_img"), to_aux.alias("warp_img_to_aux"))
    images = data.images.withColumns({"file_name": F.when(F.col("id") % 5 > 0, F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".png"))), "channels": F.lit("r|g"), "auxiliary": F.array_compact(F.array(F.when(F.col("id") % 2 == 0, aux)))})
    return Dataset(images, data.videos, data.annots, data.categories)


@registered("stored_video_grid", CATALOG_SQL["video_grid"])
def stored_video_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _stored(spark, derived(spark, sf_dir))
    return grid.video_grid(d, (2, 224, 224)).select("video_id", "t0", "x0", "y0", F.size("aids").cast("long").alias("n_aids"), "is_positive")


@registered("stored_assets", PRELUDE + """
SELECT id AS gid, unnest(['r', 'g']) AS channel, 'img' || id || '.png' AS file_name, 1::DOUBLE AS m0, 0::DOUBLE AS m1, 0::DOUBLE AS m2, 0::DOUBLE AS m3, 1::DOUBLE AS m4, 0::DOUBLE AS m5 FROM images WHERE id % 5 > 0
UNION ALL SELECT id, 'b', 'aux' || id || '.tif', CASE WHEN id % 4 = 0 THEN 4 ELSE 2 END, CASE WHEN id % 4 = 0 THEN 0.5 ELSE 0 END, CASE WHEN id % 4 = 0 THEN id % 7 ELSE -2.0 * (id % 7) END,
  0, CASE WHEN id % 4 = 0 THEN 2 ELSE 4 END, CASE WHEN id % 4 = 0 THEN -1 ELSE -12 END FROM images WHERE id % 2 = 0""")
def stored_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and channels with all six numbers of their warps, those given backwards inverted."""
    images = _stored(spark, _with_files(derived(spark, sf_dir))).images
    rows = rasters.asset_table(images, auxiliary_rows(images))
    return rows.select("gid", "channel", "file_name", *[(F.get("warp", F.lit(i)) + 0.0).alias(f"m{i}") for i in range(6)])


@registered("split_class_frequency", SPLIT_SQL + """
SELECT c.name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'vali') AS vali, count(*) FILTER (split = 'test') AS test, count(split) AS sum
FROM categories c LEFT JOIN annots a ON a.category_id = c.id LEFT JOIN sp ON sp.image_id = a.image_id GROUP BY c.name""")
def split_class_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class frequencies of the three datasets that one is split into."""
    return splits.class_frequency(splits.coerce_datasets(base=derived(spark, sf_dir), swing=0))

"""Queries on samples with pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels, targets
from ..sources.annotations import derived
from .rasters import PIXELS, TILE, _raster
from .registry import registered

#: A window of 160 by 120 on each video, and on every fourth image, padded by 20; a pixel of a sample is a square of 20.
TARGETS = """SELECT id AS target_id, id AS video_id, NULL AS image_id, 287.0 + id % 5 * 40 AS cx, 247.0 + id % 3 * 60 AS cy FROM {videos}
  UNION ALL SELECT -1 - id, NULL, id, 287.0 + id % 5 * 40, 247.0 + id % 3 * 60 FROM {images} WHERE id % 4 = 0"""
SAMPLES_SQL = PIXELS + f""",
tg AS ({TARGETS.format(videos='videos', images='images')}),
fr AS (SELECT t.*, i.id AS gid, CASE WHEN t.image_id IS NULL THEN i.frame_index ELSE 0 END AS rel_frame, CASE WHEN t.image_id IS NULL THEN i.vid_scale ELSE 1 END AS s, cx - 100 AS sx1, cy - 80 AS sy1
  FROM tg t JOIN images i ON i.video_id = t.video_id OR i.id = t.image_id),
sy AS (SELECT *, unnest(range(8)) AS y FROM fr), sx AS (SELECT *, unnest(range(10)) AS x FROM sy),
sp AS (SELECT *, ((x + 0.5) * 20 + sx1) / s / 20 AS u, ((y + 0.5) * 20 + sy1) / s / 20 AS v_ FROM sx)"""


def _samples(spark: SparkSession, sf_dir: str):
    d, channels, tiles = _raster(spark, sf_dir)
    rows = spark.sql(TARGETS, videos=d.videos, images=d.images)
    rows = rows.withColumns({"window": F.lit("120,160"), "pad_y": F.lit(20), "pad_x": F.lit(20)})
    by = F.when(F.col("channel") == "b", 60.0).otherwise(20.0)
    zero = F.lit(0.0)
    assets = channels.select("gid", "channel", "height", "width", F.array(by, zero, zero, zero, by, zero).alias("warp"))
    return targets.resolve(rows, d), d, tiles, assets


def _summed(values) -> DataFrame:
    return F.aggregate(F.filter(values, lambda v: ~F.isnan(v)), F.lit(0.0), lambda a, v: a + v)


@registered("sample_lines", SAMPLES_SQL + """
SELECT p.target_id, p.rel_frame::INT AS rel_frame, p.y, round(sum(coalesce(r.v, 0)), 4) AS r_sum, round(sum(coalesce(r.v, 0) * p.x), 4) AS r_place,
  round(sum(CASE WHEN p.gid % 2 = 0 THEN coalesce(b.v, 0) ELSE 0 END), 4) AS b_sum, count(*) FILTER (p.gid % 2 = 1) AS b_nan, count(*) AS q_nan
FROM sp p LEFT JOIN pix r ON r.gid = p.gid AND r.channel = 'r' AND r.y = floor(p.v_) AND r.x = floor(p.u) LEFT JOIN pix b ON b.gid = p.gid AND b.channel = 'b' AND b.y = floor(p.v_ / 3) AND b.x = floor(p.u / 3)
GROUP BY ALL""")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels, of which every second image lacks b, and none has q; nearest pixels."""
    resolved, d, tiles, assets = _samples(spark, sf_dir)
    lines = pixels.sample_lines(resolved, d, tiles, assets.where("channel <> 'b' or gid % 2 = 0"), "r|b|q", "nearest", scale=0.05, tile=TILE)
    nans = lambda c: F.size(F.filter(c, F.isnan)).cast("long")
    placed = F.zip_with("r", F.transform("r", lambda v, i: i), lambda v, i: v * i)
    return lines.select("target_id", "rel_frame", "y", F.round(_summed("r"), 4).alias("r_sum"), F.round(_summed(placed), 4).alias("r_place"), F.round(_summed("b"), 4).alias("b_sum"), nans("b").alias("b_nan"), nans("q").alias("q_nan"))


@registered("load_sample_pixels", SAMPLES_SQL + """,
hit AS (SELECT target_id, rel_frame, count(*) AS n, sum(((a.x * s - sx1) / 20)) AS left_sum FROM fr f JOIN annots a ON a.image_id = f.gid AND a.x IS NOT NULL
  AND a.x + w >= floor(sx1 / s) AND a.x <= ceil((sx1 + 200) / s) AND a.y + h >= floor(sy1 / s) AND a.y <= ceil((sy1 + 160) / s) GROUP BY ALL),
px_ AS (SELECT p.target_id, p.rel_frame, p.gid, count(*) AS n_pixels, round(sum(coalesce(r.v, 0) * (p.y * 10 + p.x)), 3) AS r_sum, round(sum(coalesce(g.v, 0)), 3) AS g_sum
  FROM sp p LEFT JOIN pix r ON r.gid = p.gid AND r.channel = 'r' AND r.y = floor(p.v_) AND r.x = floor(p.u) LEFT JOIN pix g ON g.gid = p.gid AND g.channel = 'g' AND g.y = floor(p.v_) AND g.x = floor(p.u) GROUP BY ALL)
SELECT p.target_id, p.rel_frame::INT AS rel_frame, gid AS image_id, n_pixels, r_sum, g_sum, coalesce(n, 0)::INT AS n_annots, round(coalesce(left_sum, 0), 4) + 0::DOUBLE AS left_sum FROM px_ p LEFT JOIN hit h ON h.target_id = p.target_id AND h.rel_frame = p.rel_frame""")
def load_sample_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and annotations of video and image targets in one table."""
    resolved, d, tiles, assets = _samples(spark, sf_dir)
    rows = pixels.load_pixels(resolved, d, tiles, assets, ["boxes"], scale=0.05, channels="r|g", interpolation="nearest", tile=TILE)
    r, green = F.flatten(F.transform("lines", lambda s: s["r"])), F.flatten(F.transform("lines", lambda s: s["g"]))
    placed = F.transform(r, lambda v, i: v * i)
    left = F.aggregate("annots", F.lit(0.0), lambda a, x: a + x["rx1"])
    return rows.select("target_id", "rel_frame", "image_id", F.size(r).cast("long").alias("n_pixels"), F.round(_summed(placed), 3).alias("r_sum"), F.round(_summed(green), 3).alias("g_sum"), F.coalesce(F.size("annots"), F.lit(0)).alias("n_annots"), (F.round(F.coalesce(left, F.lit(0.0)), 4) + F.lit(0.0)).alias("left_sum"))

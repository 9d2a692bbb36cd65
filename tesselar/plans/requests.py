"""Queries on what a request may ask for: channels, parts of annotations, kinds of grids, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import grid, pixels, samples, sampling, selection
from ..sources.annotations import PRELUDE, Dataset, derived
from ..sources.staging import staged
from .catalog import SQL as CATALOG_SQL
from .pixels import SAMPLES_SQL, _samples
from .rasters import TILE
from .registry import registered
from .samples import IMAGE_ANNOTS, _image_targets
from .selection import POOL_SQL, _pool


@registered("requested_channels", PRELUDE + """,
hv AS (SELECT id AS gid, unnest(CASE WHEN id % 2 = 0 THEN ['r', 'g', 'b'] ELSE ['r', 'g'] END) AS channel, 'img' || id AS file_name FROM images
  UNION ALL SELECT id, unnest(CASE WHEN id % 3 = 0 THEN ['m.0', 'm.1', 'm.2'] ELSE ['m.1', 'm.2'] END), 'aux' || id FROM images WHERE id % 3 < 2),
ls AS (SELECT id AS gid, CASE id % 4 WHEN 0 THEN ['r', 'm.1'] WHEN 1 THEN ['r', 'g', 'b', 'a'] ELSE ['m.0', 'm.1', 'm.2', 'g'] END AS asked FROM images WHERE id % 4 < 3),
ak AS (SELECT gid, unnest(asked) AS channel, generate_subscripts(asked, 1) - 1 AS place FROM ls)
SELECT gid, place::INT AS place, channel, file_name FROM ak LEFT JOIN hv USING (gid, channel)
UNION ALL SELECT gid, (row_number() OVER (PARTITION BY gid ORDER BY channel) - 1)::INT, channel, file_name FROM hv WHERE gid % 4 = 3""")
def requested_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, groups and ranges of channels, with blanks and repeats, against assets that are written in other ways."""
    images, i = derived(spark, sf_dir).images, F.col("id")
    file = lambda kind: F.concat(F.lit(kind), i.cast("string")).alias("file_name")
    own = images.select(i.alias("gid"), F.when(i % 2 == 0, "rgb").otherwise(" r | g").alias("channels"), file("img"))
    more = images.where("id % 3 < 2").select(i.alias("gid"), F.when(i % 3 == 0, "m:3").otherwise("m.1:3").alias("channels"), file("aux"))
    asked = images.select(i.alias("sample_id"), i.alias("gid"), F.when(i % 4 == 0, "r|m.1|r").when(i % 4 == 1, "rgba").when(i % 4 == 2, "m:3 | g").alias("request"))
    return pixels.requested_assets(asked, own.unionByName(more)).select("gid", "place", "channel", "file_name")


@registered("sample_lines_short", SAMPLES_SQL + """
SELECT p.target_id, p.rel_frame::INT AS rel_frame, p.y, sum(coalesce(r.v, 7))::BIGINT AS r_sum, sum(CASE WHEN p.gid % 2 = 0 THEN coalesce(b.v, 7) ELSE 0 END)::BIGINT AS b_sum
FROM sp p LEFT JOIN pix r ON r.gid = p.gid AND r.channel = 'r' AND r.y = floor(p.v_) AND r.x = floor(p.u) LEFT JOIN pix b ON b.gid = p.gid AND b.channel = 'b' AND b.y = floor(p.v_ / 3) AND b.x = floor(p.u / 3)
GROUP BY ALL""")
def sample_lines_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as 16-bit numbers, filled with 7 outside of images; half of the images lack a channel."""
    resolved, d, tiles, assets = _samples(spark, sf_dir)
    lines = pixels.sample_lines(resolved, d, tiles, assets.where("channel <> 'b' or gid % 2 = 0"), "r|b", "nearest", scale=0.05, constant=7.0, dtype="short", tile=TILE)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return lines.select("target_id", "rel_frame", "y", total("r").alias("r_sum"), total("b").alias("b_sum"))


@registered("sample_parts", IMAGE_ANNOTS.format(s=1) + """ SELECT target_id, count(*)::INT AS n, sum(3 * x + 2 * w + 3 * y + h) AS outline, sum(aid % 4)::BIGINT AS n_points
FROM sa JOIN annots a ON a.id = sa.aid GROUP BY target_id""")
def sample_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with outlines and keypoints of annotations, without boxes."""
    resolved, d = _image_targets(spark, sf_dir)
    x1, y1, x2, y2 = g.xywh_box(*map(F.col, "xywh"))
    flat = F.array_repeat(F.lit(1.0), (F.col("id") % 4 * 3).cast("int"))
    annots = d.annots.withColumns({"segmentation": F.array(x1, y1, x2, y1, x2, y2), "keypoints": flat})
    rows = samples.load_samples(resolved, Dataset(d.images, d.videos, annots, d.categories), "segmentation+keypoints", stills=True).where("annots is not null")
    outline = F.aggregate("annots", F.lit(0.0), lambda a, s: a + F.aggregate(s["segmentation"], F.lit(0.0), lambda b, v: b + v))
    points = F.aggregate("annots", F.lit(0).cast("long"), lambda a, s: a + F.size(samples.decode_keypoints(s["keypoints"], F.array(*map(F.lit, ("head", "tail", "left"))))))
    return rows.select("target_id", F.size("annots").alias("n"), outline.alias("outline"), points.alias("n_points"))


@registered("keypoint_structs", CATALOG_SQL["keypoint_decode"])
def keypoint_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints that name their own categories give what flat triplets give."""
    rows = derived(spark, sf_dir).annots.where("x is not null")
    names = samples.keypoint_names(spark.createDataFrame([(1, "head"), (2, "tail"), (3, "left")], "id long, name string"))
    ps = F.when(F.col("id") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("id") % 4))
    one = lambda p: F.struct(p.alias("keypoint_category_id"), F.array(F.col("x") + p * 1.5, F.col("y") + p * 2.5).alias("xy"), ((p + F.col("id")) % 3).alias("visible"))
    decoded = samples.decode_keypoint_structs(F.transform(ps, one), F.col("names"))
    points = rows.crossJoin(F.broadcast(names)).select("id", F.posexplode(decoded).alias("place", "k"))  # one row
    return points.select("id", F.col("place").cast("long").alias("place"), "k.name", F.col("k.x").alias("kx"), F.col("k.y").alias("ky"), F.col("k.visible").cast("long").alias("visible"))


@registered("images_with_annotations", PRELUDE + """ SELECT i.id, video_id, frame_index, width, height, vid_scale, a.id AS annot_id, category_id AS annot_category_id, x AS annot_x, y AS annot_y, w AS annot_w, h AS annot_h
  FROM images i LEFT JOIN (SELECT * FROM annots WHERE category_id <> 6) a ON a.image_id = i.id""")
def images_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return samples.images_with_annotations(d.images, d.annots.where("category_id <> 6"))


COUNTED = "count(*) AS n_windows, count(*) FILTER (is_positive) AS n_positive"


@registered("sample_grid_tasks", f"SELECT 'image_detection' AS task, {COUNTED} FROM ({CATALOG_SQL['image_grid_overlap50']}) UNION ALL SELECT 'video_detection', {COUNTED} FROM ({CATALOG_SQL['video_grid']})")
def sample_grid_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    count = lambda task, rows: rows.agg(F.lit(task).alias("task"), F.count("*").alias("n_windows"), F.count_if("is_positive").alias("n_positive"))
    found = [count(task, grid.sample_grid(d, task, window, overlap)) for task, window, overlap in (("image_detection", (224, 224), 0.5), ("video_detection", (2, 224, 224), 0.0))]
    return found[0].unionByName(found[1])


@registered("pool_counts", POOL_SQL + " SELECT count(*) FILTER (is_positive) AS n_positives, count(*) FILTER (NOT is_positive) AS n_negatives, count(*) AS n_samples FROM pool")
def pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool_counts(staged(_pool(spark, sf_dir), "pool"))


@registered("drawn_images", f"SELECT image_id, count(*) AS n FROM ({CATALOG_SQL['random_negatives_abs']}) GROUP BY image_id")
def drawn_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.drawn_images(sampling.random_negatives(derived(spark, sf_dir), (50, 50), 500))


@registered("rectify_line", PRELUDE + " SELECT id, id % height AS lo, id % height + 1 AS hi FROM images")
def rectify_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = g.rectify_at(F.col("id") % F.col("height"))
    return derived(spark, sf_dir).images.select("id", lo.alias("lo"), hi.alias("hi"))

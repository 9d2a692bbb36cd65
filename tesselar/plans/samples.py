"""Queries on target inference and the annotations of samples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import samples, targets
from ..sources.annotations import PRELUDE, derived
from ..sources.staging import staged
from .registry import registered

#: Targets from annotations: windows of four kinds, images left out, unknown annotations.
IMAGE_TARGETS = """SELECT id AS target_id, CASE WHEN id % 50 = 0 THEN -id ELSE id END AS aid,
  CASE WHEN id % 10 = 0 AND id % 50 <> 0 THEN NULL ELSE image_id END AS image_id,
  CASE id % 4 WHEN 0 THEN 'extent' WHEN 1 THEN 'square' WHEN 2 THEN '64,64' ELSE '101,37' END AS win, id % 3 * 5 AS pad_y, id % 3 * 5 AS pad_x FROM {annots}"""
#: Targets from videos: centres and time slices for every second one.
VIDEO_TARGETS = """SELECT id AS target_id, id AS video_id, CASE WHEN id % 2 = 0 THEN 300.5 END AS cx, CASE WHEN id % 2 = 0 THEN 199.25 END AS cy,
  CASE WHEN id % 2 = 0 THEN '128,96' END AS win, CASE WHEN id % 2 = 0 THEN 1 END AS t0, id % 3 AS pad_y, id % 3 AS pad_x FROM {videos}"""


def _image_targets(spark: SparkSession, sf_dir: str):
    d = derived(spark, sf_dir)
    d = replace(d, annots=staged(d.annots, "annots"))  # read for targets, for their annotations and for those that they meet
    return targets.resolve(spark.sql(IMAGE_TARGETS, annots=d.annots).withColumnRenamed("win", "window"), d), d


def _video_targets(spark: SparkSession, sf_dir: str):
    d = derived(spark, sf_dir)
    return targets.resolve(spark.sql(VIDEO_TARGETS, videos=d.videos).withColumnRenamed("win", "window"), d), d


SIDE = "CASE WHEN t.win = 'extent' THEN ceil({own}) WHEN t.win = 'square' THEN greatest(ceil(w), ceil(h)) ELSE string_split(t.win, ',')[{at}]::DOUBLE END"
IMAGE_SQL = PRELUDE + f""",
tg AS ({IMAGE_TARGETS.format(annots='annots')}),
tw AS (SELECT t.*, a.image_id AS a_gid, a.category_id, x + w / 2 AS cx, y + h / 2 AS cy, {SIDE.format(own='w', at=2)} AS ww, {SIDE.format(own='h', at=1)} AS wh FROM tg t LEFT JOIN annots a ON a.id = t.aid),
rs AS (SELECT target_id, aid, i.id AS gid, category_id::BIGINT AS category_id, height::BIGINT AS space_height, width::BIGINT AS space_width,
  (CASE WHEN cx IS NULL THEN 0 ELSE floor(cy - wh / 2) END)::BIGINT AS y0, (CASE WHEN cx IS NULL THEN height ELSE floor(cy - wh / 2) + wh END)::BIGINT AS y1,
  (CASE WHEN cx IS NULL THEN 0 ELSE floor(cx - ww / 2) END)::BIGINT AS x0, (CASE WHEN cx IS NULL THEN width ELSE floor(cx - ww / 2) + ww END)::BIGINT AS x1, pad_y, pad_x
  FROM tw JOIN images i ON i.id = coalesce(tw.image_id, a_gid))"""


@registered("infer_target_aid", IMAGE_SQL + " SELECT * FROM rs")
def infer_target_aid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_targets(spark, sf_dir)[0].drop("vidid", "gids", "t0", "t1")


VIDEO_SQL = PRELUDE + f""",
tg AS ({VIDEO_TARGETS.format(videos='videos')}),
fr AS (SELECT id AS image_id, video_id, frame_index AS place, vid_scale FROM images),
rs AS (SELECT target_id, v.id AS vidid, v.height::BIGINT AS space_height, v.width::BIGINT AS space_width, coalesce(n, 0) AS n,
  (CASE WHEN cx IS NULL THEN 0 ELSE floor(cy - 64) END)::BIGINT AS y0, (CASE WHEN cx IS NULL THEN v.height ELSE floor(cy - 64) + 128 END)::BIGINT AS y1,
  (CASE WHEN cx IS NULL THEN 0 ELSE floor(cx - 48) END)::BIGINT AS x0, (CASE WHEN cx IS NULL THEN v.width ELSE floor(cx - 48) + 96 END)::BIGINT AS x1,
  coalesce(t0, 0)::BIGINT AS t0, coalesce(n, 0)::BIGINT AS t1, pad_y, pad_x
  FROM tg JOIN videos v ON v.id = tg.video_id LEFT JOIN (SELECT video_id, count(*) AS n FROM fr GROUP BY 1) c ON c.video_id = v.id),
sf AS (SELECT rs.*, image_id, place - t0 AS rel_frame, vid_scale FROM rs JOIN fr ON fr.video_id = vidid AND place >= t0)"""


@registered("infer_target_video", VIDEO_SQL + """ SELECT target_id, vidid, space_height, space_width, y0, y1, x0, x1, t0, t1, coalesce(k, 0) AS n_frames, coalesce(f, -1) AS first_frame
  FROM rs LEFT JOIN (SELECT target_id, count(*) AS k, min_by(image_id, rel_frame) AS f FROM sf GROUP BY 1) USING (target_id)""")
def infer_target_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _video_targets(spark, sf_dir)[0]
    first = F.coalesce(F.get("gids", F.lit(0)), F.lit(-1).cast("long"))
    return rows.select("target_id", "vidid", "space_height", "space_width", "y0", "y1", "x0", "x1", "t0", "t1", F.size("gids").cast("long").alias("n_frames"), first.alias("first_frame"))


@registered("target_common_video", PRELUDE + """ SELECT target_id, arg_min(video_id, pos) AS video_id, count(DISTINCT video_id) AS n_videos
  FROM (SELECT id AS target_id, unnest([id, id + 1, id + 2]) AS gid, unnest([0, 1, 2]) AS pos FROM images) t JOIN images i ON i.id = t.gid GROUP BY target_id""")
def target_common_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = derived(spark, sf_dir).images
    rows = images.select(F.col("id").alias("target_id"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2).alias("image_ids"))
    return targets.common_video(rows, images)


@registered("target_annots", IMAGE_SQL + """ SELECT target_id, r.gid AS image_id, a.id AS aid FROM rs r JOIN annots a ON a.image_id = r.gid
  AND x IS NOT NULL AND x + w >= x0 AND x <= x1 AND y + h >= y0 AND y <= y1""")
def target_annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = _image_targets(spark, sf_dir)
    return samples.target_annotations(rows, d)


IMAGE_ANNOTS = IMAGE_SQL + """,
sa AS (SELECT target_id, r.aid AS own, r.gid AS image_id, a.id AS aid, a.category_id, (x - (x0 - pad_x)) * {s} AS rx1, (y - (y0 - pad_y)) * {s} AS ry1, (x + w - (x0 - pad_x)) * {s} AS rx2, (y + h - (y0 - pad_y)) * {s} AS ry2,
  greatest(least(x + w, x1 + pad_x) - greatest(x, x0 - pad_x), 0) * greatest(least(y + h, y1 + pad_y) - greatest(y, y0 - pad_y), 0) / (w * h + 1e-6) AS seen
  FROM rs r JOIN annots a ON a.image_id = r.gid AND x IS NOT NULL AND x + w >= x0 - pad_x AND x <= x1 + pad_x AND y + h >= y0 - pad_y AND y <= y1 + pad_y)"""


@registered("sample_annots_rel", IMAGE_ANNOTS.format(s=1) + " SELECT target_id, 0 AS rel_frame, image_id, aid, category_id, rx1, ry1, rx2, ry2 FROM sa")
def sample_annots_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.sample_annotations(*_image_targets(spark, sf_dir), stills=True)


@registered("sample_annots_scaled", IMAGE_ANNOTS.format(s=2) + " SELECT target_id, aid, rx1, ry1, rx2, ry2 FROM sa WHERE seen > 0.3")
def sample_annots_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.sample_annotations(*_image_targets(spark, sf_dir), visible=0.3, scale=2.0, stills=True).select("target_id", "aid", "rx1", "ry1", "rx2", "ry2")


@registered("sample_annots_video", VIDEO_SQL + """,
q AS (SELECT *, floor((x0 - pad_x) / vid_scale) AS qx1, floor((y0 - pad_y) / vid_scale) AS qy1, ceil((x1 + pad_x) / vid_scale) AS qx2, ceil((y1 + pad_y) / vid_scale) AS qy2 FROM sf)
SELECT target_id, rel_frame::INT AS rel_frame, a.id AS aid, x * vid_scale - (x0 - pad_x) AS rx1, y * vid_scale - (y0 - pad_y) AS ry1, (x + w) * vid_scale - (x0 - pad_x) AS rx2, (y + h) * vid_scale - (y0 - pad_y) AS ry2
FROM q JOIN annots a ON a.image_id = q.image_id AND x IS NOT NULL AND x + w >= qx1 AND x <= qx2 AND y + h >= qy1 AND y <= qy2""")
def sample_annots_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.sample_annotations(*_video_targets(spark, sf_dir)).select("target_id", "rel_frame", "aid", "rx1", "ry1", "rx2", "ry2")


@registered("annot_ids_semi", IMAGE_ANNOTS.format(s=1) + " SELECT target_id, aid, rx1, ry1 FROM sa WHERE aid % 3 = 0")
def annot_ids_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = _image_targets(spark, sf_dir)
    only = rows.join(d.annots.select(F.col("id").alias("listed"), "image_id"), F.col("gid") == F.col("image_id")).where("listed % 3 = 0").select("target_id", F.col("listed").alias("aid"))
    return samples.sample_annotations(rows, d, only=only, stills=True).select("target_id", "aid", "rx1", "ry1")


@registered("annot_idx", IMAGE_ANNOTS.format(s=1) + """ SELECT rs.target_id, coalesce(n, 0)::INT AS n, coalesce(k, -1)::INT AS annot_idx FROM rs LEFT JOIN
  (SELECT target_id, count(*) AS n, CASE WHEN count(*) FILTER (aid = own) > 0 THEN count(*) FILTER (aid < own) ELSE -1 END AS k FROM sa GROUP BY 1) USING (target_id)""")
def annot_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = _image_targets(spark, sf_dir)
    found = samples.annotation_index(rows, samples.sample_annotations(rows, d, stills=True))
    return found.select("target_id", F.size("aids").alias("n"), "annot_idx")


@registered("load_samples", IMAGE_ANNOTS.format(s=1) + """ SELECT target_id, gid, y0, y1, x0, x1, (pad_x - x0)::DOUBLE AS dx, (pad_y - y0)::DOUBLE AS dy, coalesce(n, 0)::INT AS n_annots, coalesce(m, 0)::DOUBLE AS sum_x FROM rs
  LEFT JOIN (SELECT target_id, count(*) AS n, sum(rx1) AS m FROM sa GROUP BY 1) USING (target_id)""")
def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = _image_targets(spark, sf_dir)
    total = F.aggregate("annots", F.lit(0.0), lambda a, x: a + x["rx1"])
    out = samples.load_samples(rows, d, stills=True)
    return out.select("target_id", "gid", "y0", "y1", "x0", "x1", "dx", "dy", F.coalesce(F.size("annots"), F.lit(0)).alias("n_annots"), F.coalesce(total, F.lit(0.0)).alias("sum_x"))


@registered("keypoint_decode", PRELUDE + """ SELECT id, p - 1 AS place, ['head', 'tail', 'left'][p] AS name, x + p * 1.5 AS kx, y + p * 2.5 AS ky, (p + id) % 3 AS visible
  FROM (SELECT id, x, y, unnest(generate_series(1, id % 4)) AS p FROM annots WHERE x IS NOT NULL)""")
def keypoint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).annots.where("x is not null").select("id", "x", "y", F.when(F.col("id") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("id") % 4)).otherwise(F.array().cast("array<bigint>")).alias("ps"))
    flat = F.flatten(F.transform("ps", lambda p: F.array(F.col("x") + p * 1.5, F.col("y") + p * 2.5, ((p + F.col("id")) % 3).cast("double"))))
    points = rows.select("id", F.posexplode(samples.decode_keypoints(flat, F.array(*map(F.lit, ("head", "tail", "left"))))).alias("place", "k"))
    return points.select("id", F.col("place").cast("long").alias("place"), "k.name", F.col("k.x").alias("kx"), F.col("k.y").alias("ky"), F.col("k.visible").cast("long").alias("visible"))


@registered("segmentation_lookup", PRELUDE + " SELECT a.image_id AS place, b.id AS aid, 6 AS n, b.x + b.y + b.x + b.w + b.y + b.x + b.w + b.y + b.h AS total FROM (SELECT image_id, max(id) AS m FROM annots GROUP BY 1) a LEFT JOIN annots b ON b.id = m WHERE b.x IS NOT NULL")
def segmentation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    annots = derived(spark, sf_dir).annots
    x1, y1, x2, y2 = g.xywh_box(*map(F.col, "xywh"))
    shaped = annots.where("x is not null").withColumn("segmentation", F.array(x1, y1, x2, y1, x2, y2))
    asked = annots.groupBy(F.col("image_id").alias("place")).agg(F.max("id").alias("aid"))
    found = samples.segmentations(shaped, asked).where("segmentation is not null")
    return found.select("place", "aid", F.size("segmentation").alias("n"), F.aggregate("segmentation", F.lit(0.0), lambda a, v: a + v).alias("total"))


@registered("class_lookup", PRELUDE + " SELECT a.id, a.category_id, c.name AS class_name FROM annots a LEFT JOIN categories c ON c.id = a.category_id")
def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    named = samples.class_names(d.annots.select("id", "category_id"), d.categories).select("id", "class_name")
    return samples.class_ids(named, d.categories).select("id", "category_id", "class_name")


@registered("coerce_pad", PRELUDE + """ SELECT id, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 1 END AS y_lo, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS y_hi,
  CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 3 END AS x_lo, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 4 END AS x_hi FROM images""")
def coerce_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.expr("CASE id % 4 WHEN 1 THEN array(3L) WHEN 2 THEN array(1L, 4L) WHEN 3 THEN array(1L, 2L, 3L, 4L) END")
    rows = derived(spark, sf_dir).images.select("id", pad.alias("pad")).select("id", g.coerce_pad(F.col("pad")).alias("p"))
    return rows.select("id", *[F.col("p")[i][e].cast("int").alias(f"{n}_{e}") for i, n in enumerate("yx") for e in ("lo", "hi")])


@registered("rectify_slice", PRELUDE + """ SELECT id, greatest(coalesce(a, 0), 0) AS lo, CASE WHEN coalesce(b, width) < 0 THEN width + coalesce(b, width) ELSE least(coalesce(b, width), width) END AS hi
  FROM (SELECT id, width, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 200 - 50 END AS a, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 1500 - 100 END AS b FROM images)""")
def rectify_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).images.select("id", "width", F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 200 - 50 END").alias("a"), F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE id % 1500 - 100 END").alias("b"))
    lo, hi = g.rectify(F.col("a"), F.col("b"), F.col("width"))
    return rows.select("id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


@registered("affine_algebra", PRELUDE + """ SELECT id, round(x * 2 + 3, 6) AS u, round(y * 4 - 1, 6) AS v, round(x, 6) AS bx, round(y, 6) AS by FROM annots WHERE x IS NOT NULL""")
def affine_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).annots.where("x is not null")
    m = g.compose(g.translation(F.lit(3.0), F.lit(-1.0)), g.affine(F.array(*map(F.lit, (2.0, 0.0, 0.0, 0.0, 4.0, 0.0)))))
    there = g.warp(g.xywh_box(*map(F.col, "xywh")), m)
    back = g.warp(there, g.invert(m))
    return rows.select("id", *[F.round(c, 6).alias(n) for c, n in zip((there[0], there[1], back[0], back[1]), ("u", "v", "bx", "by"))])


@registered("pixel_defaults", PRELUDE + """
SELECT id, CASE WHEN id % 4 = 0 THEN (id % 7)::DOUBLE WHEN id % 3 = 1 THEN NULL ELSE 0 END AS fill, id % 4 <> 0 AND id % 3 = 1 AS is_nan,
  CASE WHEN id % 5 = 1 THEN 'nearest' WHEN id % 5 = 2 THEN 'cubic' ELSE 'linear' END AS interpolation, CASE WHEN id % 2 = 0 THEN id % 5 <> 1 ELSE id % 3 = 0 END AS antialias FROM images""")
def pixel_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill values and resampling that a request leaves open."""
    images = derived(spark, sf_dir).images
    i = F.col("id")
    fill = g.fill_value(F.when(i % 4 == 0, i % 7), F.when(i % 3 == 1, F.when(i % 2 == 0, "float").otherwise("auto")).when(i % 3 == 2, "none"))
    kind, smooth = g.resampling(F.when(i % 5 == 1, "nearest").when(i % 5 == 2, "cubic").when(i % 5 == 3, "auto"), F.when(i % 2 == 1, i % 3 == 0))
    return images.select("id", F.nanvl(fill, F.lit(None).cast("double")).alias("fill"), F.isnan(fill).alias("is_nan"), kind.alias("interpolation"), smooth.alias("antialias"))

"""Queries on pixels: every image has a made-up raster of a twentieth of its size, and a coarser third channel."""

from __future__ import annotations

import uuid
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, rasters, resample
from ..sources.annotations import PRELUDE, derived
from ..sources.staging import staged, staging_folder
from ..sources.tiles import TileStore
from .registry import registered

TILE = 16
#: Channels r and g of the raster's size and b of a third of it, with their numbers.
CHANNELS = """SELECT id AS gid, channel, c, CAST(CASE WHEN channel = 'b' THEN ceil(height / 60) ELSE height / 20 END AS INT) AS height,
  CAST(CASE WHEN channel = 'b' THEN ceil(width / 60) ELSE width / 20 END AS INT) AS width, CAST(height / 20 AS INT) AS img_height, CAST(width / 20 AS INT) AS img_width
  FROM {images}, (VALUES ('r', 0), ('g', 1), ('b', 3)) AS v(channel, c)"""
PIXELS = PRELUDE + f""",
ch AS ({CHANNELS.format(images='images')}),
py AS (SELECT *, unnest(range(height)) AS y FROM ch),
px AS (SELECT gid, channel, height, width, y, unnest(range(width)) AS x, c FROM py),
pix AS (SELECT gid, channel, y, x, ((gid * 31 + y * 13 + x * 7 + c * 17) % 256)::DOUBLE AS v FROM px)"""
DIGEST = "count(*) AS n, sum(v) AS total, sum(v * ((y * 31 + x * 17) % 101)) AS check_sum"


def _value(column, y, x):
    return (column("gid") * 31 + y * 13 + x * 7 + column("c") * 17) & 255  # % 256


def _made(channels: DataFrame, value=_value) -> rasters.MadeTiles:
    return rasters.MadeTiles(rasters.tile_layout(channels, TILE).select("gid", "channel", "c", "height", "width", "ty", "tx", "th", "tw"), value, TILE, channels.select("gid", "channel", "c", "height", "width"))


def _raster(spark: SparkSession, sf_dir: str):
    d = derived(spark, sf_dir)
    # Images are dealt out before they become pixels, as a file of them may be one task's; by a fixed number, as they are too small for AQE to leave them apart.
    dealt = d.images.select("id", "height", "width").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    channels = spark.sql(CHANNELS, images=dealt)
    return d, channels, _made(channels)


def _whole(images: DataFrame) -> DataFrame:
    """Regions that are whole rasters; regions of the images' own size would name hundreds of tiles beyond each raster."""
    return rasters.whole_images(images.select("id", *[(F.col(c) / 20).cast("int").alias(c) for c in ("height", "width")]))


def _store(spark: SparkSession, sf_dir: str, which: str = "true") -> TileStore:
    """A stored table of the tiles of those channels."""
    store = TileStore(spark, f"{staging_folder(spark)}/tiles-{uuid.uuid4().hex}", max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), TILE)
    store.ingest(_raster(spark, sf_dir)[1].where(which), _made)
    return store


def _sums(y: np.ndarray, x: np.ndarray, values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of the pixels of each line that are there."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values)) * 17 + np.repeat((x - at[:-1]) * 17 + y * 31, n)
    there = ~np.isnan(values)
    v, row, place = (values, row, place) if there.all() else (values[there], row[there], place[there])
    return [np.bincount(row, w, len(n)).astype(t) for w, t in zip((None, v, v * np.fmod(place, 101)), (np.int64, np.float64, np.float64))]


SUMS = rasters.Summary(_sums, "n long, total double, check_sum double", added=True)


def _digest(lines: DataFrame, *keys: str) -> DataFrame:
    """Digests of pixels that are there: sums in the tasks that have them (rows may have them already), then of these."""
    if "values" in lines.columns:
        lines = rasters.summarized(lines.select(*keys, "y", (F.col("x") if "x" in lines.columns else F.lit(0)).cast("long").alias("x"), "values"), SUMS)
    return lines.where("n > 0").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "check_sum")])


@registered("region_pixels", PIXELS + f" SELECT gid AS sample_id, channel, {DIGEST} FROM pix WHERE y >= 3 AND y < 12 AND x >= 5 AND x < 22 GROUP BY ALL")
def region_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all images from a stored table of tiles."""
    d, store = derived(spark, sf_dir).images, _store(spark, sf_dir)
    regions = rasters.whole_images(d).withColumns({c: F.lit(v).cast("long") for c, v in (("y0", 3), ("y1", 12), ("x0", 5), ("x1", 22))})
    return _digest(store.lines(regions), "sample_id", "channel")


@registered("tile_store", PRELUDE + f", ch AS ({CHANNELS.format(images='images')}) SELECT gid, channel, ceil(height / 16)::BIGINT * ceil(width / 16)::BIGINT AS n_tiles, height * width AS n_pixels, gid % 3 = 0 AS added_later FROM ch")
def tile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that got two thirds of all images first, then the rest, then nothing more."""
    _, channels, _ = _raster(spark, sf_dir)
    store = _store(spark, sf_dir, "gid % 3 <> 0")
    before = store.tiles().select("gid", F.lit(False).alias("added_later")).distinct()
    before = staged(before, "tiles-before")
    store.ingest(channels, _made)
    if store.ingest(channels, _made):
        raise AssertionError("a second ingest found something left")
    counts = store.tiles().groupBy("gid", "channel").agg(F.count("*").alias("n_tiles"), F.sum(F.size("values")).cast("int").alias("n_pixels"))
    return counts.join(before, "gid", "left").withColumn("added_later", F.coalesce("added_later", F.lit(True)))


@registered("image_pixels", PIXELS + f" SELECT gid AS sample_id, {DIGEST} FROM pix WHERE channel = 'g' GROUP BY ALL")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, tiles = _raster(spark, sf_dir)
    regions = _whole(d.images).withColumn("channel", F.lit("g"))
    return _digest(rasters.region_lines(tiles, regions, TILE, SUMS), "sample_id")


@registered("sample_2d_padded", PIXELS + """,
wd AS (SELECT id AS gid, unnest(range(-3, 12)) AS y, (width / 20)::INT + 4 AS x1 FROM images),
wx AS (SELECT gid, y, unnest(range(-2, x1)) AS x FROM wd)
SELECT w.gid AS sample_id, c.channel, count(*) AS n, sum(coalesce(v, -1)) AS total, sum(coalesce(v, -1) * (((w.y + 3) * 31 + (w.x + 2) * 17) % 101)) AS check_sum
FROM wx w, (VALUES ('r'), ('g')) AS c(channel) LEFT JOIN pix p ON p.gid = w.gid AND p.channel = c.channel AND p.y = w.y AND p.x = w.x GROUP BY ALL""")
def sample_2d_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, channels, tiles = _raster(spark, sf_dir)
    regions = d.images.select(F.col("id").alias("sample_id"), F.col("id").alias("gid"), F.lit(-3).cast("long").alias("y0"), F.lit(12).cast("long").alias("y1"), F.lit(-2).cast("long").alias("x0"), (F.col("width") / 20 + 4).cast("long").alias("x1"))
    wanted = channels.where("channel <> 'b'").select(F.col("gid").alias("sample_id"), "channel")
    return _digest(rasters.padded_lines(tiles, regions, wanted, -1.0, TILE, then=SUMS), "sample_id", "channel")


def _whole_grid(channels: DataFrame, scale) -> DataFrame:
    zero = F.lit(0).cast("long")
    return channels.select(F.col("gid").alias("sample_id"), F.lit(0).alias("rel_frame"), "gid", "channel", zero.alias("y0"), F.col("img_height").cast("long").alias("y1"), zero.alias("x0"), F.col("img_width").cast("long").alias("x1"), F.array(scale, F.lit(0.0), F.lit(0.0), F.lit(0.0), scale, F.lit(0.0)).alias("warp"), "height", "width")


@registered("channel_align_nearest", PIXELS + """,
im AS (SELECT DISTINCT gid, img_height, img_width FROM ch), iy AS (SELECT *, unnest(range(img_height)) AS y FROM im), ix AS (SELECT gid, y, unnest(range(img_width)) AS x FROM iy)
SELECT i.gid AS sample_id, count(*) AS n, sum(v) AS total, sum(v * ((i.y * 31 + i.x * 17) % 101)) AS check_sum FROM ix i JOIN pix p ON p.gid = i.gid AND p.channel = 'b' AND p.y = floor((i.y + 0.5) / 3) AND p.x = floor((i.x + 0.5) / 3) GROUP BY ALL""")
def channel_align_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, channels, tiles = _raster(spark, sf_dir)
    aux = channels.where("channel = 'b'")
    return _digest(resample.aligned_lines(tiles, _whole_grid(aux, F.lit(1 / 3)), linear=False, tile=TILE, then=SUMS), "sample_id")


def linear_sql(pixels: str, grid: str, factor: str, n: str) -> str:
    """Pixels of a grid (g.y, g.x) from pixels p at factor source pixels a grid pixel: weights along y and x, each brought to one."""
    half = f"greatest({factor}, 1)"
    w = lambda u, j: f"greatest(1 - abs({j} + 0.5 - (({u}) + 0.5) * {factor}) / {half}, 0)"
    return f"""(SELECT g.gid, g.channel, g.y, g.x, sum(p.v * {w('g.y', 'p.y')} * {w('g.x', 'p.x')}) / sum({w('g.y', 'p.y')} * {w('g.x', 'p.x')}) AS v
  FROM {grid} g JOIN {pixels} p ON p.gid = g.gid AND p.channel = g.channel AND abs(p.y + 0.5 - (g.y + 0.5) * {factor}) < {half} AND abs(p.x + 0.5 - (g.x + 0.5) * {factor}) < {half}
  WHERE (g.y + 0.5) * {factor} < g.height AND (g.x + 0.5) * {factor} < g.width {n} GROUP BY ALL)"""


ROUNDED = "count(*) AS n, round(sum(v), 4) AS total, round(sum(v * ((y * 31 + x * 17) % 101)), 3) AS check_sum"


def _rounded(lines: DataFrame, *keys: str) -> DataFrame:
    """The digest of pixels that are there, to some digits."""
    return _digest(lines, *keys).withColumns({"total": F.round("total", 4), "check_sum": F.round("check_sum", 3)})


@registered("channel_align_linear", PIXELS + """,
gy AS (SELECT gid, channel, height, width, img_width, unnest(range(img_height)) AS y FROM ch WHERE channel = 'b'), gx AS (SELECT gid, channel, height, width, y, unnest(range(img_width)) AS x FROM gy)
SELECT gid AS sample_id, """ + ROUNDED + " FROM " + linear_sql("pix", "gx", "(1 / 3::DOUBLE)", "") + " GROUP BY gid")
def channel_align_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse channel on its image's grid, three pixels for each one."""
    _, channels, tiles = _raster(spark, sf_dir)
    return _rounded(resample.aligned_lines(tiles, _whole_grid(channels.where("channel = 'b'"), F.lit(1 / 3)), tile=TILE, then=SUMS), "sample_id")


@registered("channels_shrunk_smooth", PIXELS + """,
gy AS (SELECT gid, channel, height, width, unnest(range(-2, ceil(height / 2)::BIGINT + 2)) AS y FROM ch WHERE channel <> 'b'), gx AS (SELECT gid, channel, height, width, y, unnest(range(-1, ceil(width / 2)::BIGINT + 1)) AS x FROM gy)
SELECT gid AS sample_id, channel, """ + ROUNDED + " FROM " + linear_sql("pix", "gx", "2::DOUBLE", "AND g.y >= 0 AND g.x >= 0") + " GROUP BY gid, channel")
def channels_shrunk_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels at half their size, whole, on a grid that goes beyond the image on all sides; pixels outside are NaN."""
    _, channels, tiles = _raster(spark, sf_dir)
    c = lambda v: F.lit(v).cast("long")
    grids = _whole_grid(channels.where("channel <> 'b'"), F.lit(2.0)).withColumns({"y0": c(-2), "y1": F.ceil(F.col("height") / 2) + 2, "x0": c(-1), "x1": F.ceil(F.col("width") / 2) + 1})
    return _rounded(resample.aligned_lines(tiles, grids, tile=TILE, band=4, then=SUMS), "sample_id", "channel")


@registered("realigned_parts", PIXELS + """,
gy AS (SELECT b.gid, b.channel, b.height, b.width, g.width AS gw, unnest(range(g.height)) AS y FROM ch b JOIN ch g ON g.gid = b.gid AND g.channel = 'g' WHERE b.channel = 'b'), gx AS (SELECT gid, channel, height, width, y, unnest(range(gw)) AS x FROM gy)
SELECT sample_id, channel, n, round(total, 4) AS total, round(check_sum, 3) AS check_sum FROM (SELECT gid AS sample_id, channel, """ + DIGEST + " FROM pix WHERE channel <> 'b' GROUP BY gid, channel UNION ALL SELECT gid, channel, " + DIGEST + " FROM " + linear_sql("pix", "gx", "(1 / 3::DOUBLE)", "") + " GROUP BY gid, channel)")
def realigned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native parts of different sizes, all on the grid of the largest; that grid is half the image's size."""
    _, channels, tiles = _raster(spark, sf_dir)
    own = lambda s: F.array(*[F.lit(v) for v in (s, 0.0, 0.0, 0.0, s, 0.0)])
    parts = channels.select("gid", "channel", "height", "width", F.when(F.col("channel") == "b", own(6.0)).otherwise(own(2.0)).alias("warp"))
    return _rounded(resample.realigned(tiles, parts, tile=TILE, then=SUMS), "sample_id", "channel")


@registered("fused_region", PIXELS + " SELECT a.gid AS sample_id, count(*) AS n, sum(a.v * b.v) AS total FROM pix a JOIN pix b ON a.gid = b.gid AND a.y = b.y AND a.x = b.x AND a.channel = 'r' AND b.channel = 'g' WHERE a.y < 8 AND a.x < 8 GROUP BY ALL")
def fused_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, channels, tiles = _raster(spark, sf_dir)
    part = _whole_grid(channels.where("channel <> 'b'"), F.lit(1.0)).withColumns({"y1": F.lit(8).cast("long"), "x1": F.least(F.lit(8), "width").cast("long")})
    wide = resample.aligned_channels(tiles, part, ["r", "g"], linear=False, tile=TILE)
    product = F.zip_with("r", "g", lambda a, b: a * b)
    return wide.select("sample_id", F.explode(product).alias("v")).where(~F.isnan("v")).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@registered("fused_missing_channel", PIXELS + """
SELECT a.gid AS sample_id, a.y, sum(a.v) AS r_sum, sum(b.v) FILTER (a.gid % 2 = 0) AS g_sum, count(*) FILTER (a.gid % 2 = 1) AS n_nan
FROM pix a JOIN pix b ON a.gid = b.gid AND a.y = b.y AND a.x = b.x AND a.channel = 'r' AND b.channel = 'g' GROUP BY a.gid, a.y""")
def fused_missing_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels r and g side by side, line by line of whole images, where every second one lacks g."""
    _, channels, tiles = _raster(spark, sf_dir)
    part = _whole_grid(channels.where("channel = 'r' or (channel = 'g' and gid % 2 = 0)"), F.lit(1.0))
    wide = resample.aligned_channels(tiles, part, ["r", "g"], linear=False, tile=TILE)
    there = lambda c: F.filter(c, lambda v: ~F.isnan(v))
    sum_of = lambda c: F.when(F.size(there(c)) > 0, F.aggregate(there(c), F.lit(0.0), lambda a, v: a + v))
    return wide.select("sample_id", "y", sum_of("r").alias("r_sum"), sum_of("g").alias("g_sum"), (F.size("g") - F.size(there("g"))).cast("long").alias("n_nan"))


@registered("sample_3d_pixels", PIXELS + """,
fr AS (SELECT id AS gid, video_id AS sample_id, frame_index AS rel_frame, vid_scale AS s FROM images WHERE frame_index < 2),
wy AS (SELECT *, unnest(range(2, 8)) AS y FROM fr), wx AS (SELECT *, unnest(range(3, 11)) AS x FROM wy)
SELECT sample_id, rel_frame, count(*) AS n, sum(v) AS total, sum(v * ((w.y * 31 + w.x * 17) % 101)) AS check_sum FROM wx w JOIN pix p ON p.gid = w.gid AND p.channel = 'r' AND p.y = floor((w.y + 0.5) / s) AND p.x = floor((w.x + 0.5) / s) GROUP BY ALL""")
def sample_3d_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, channels, tiles = _raster(spark, sf_dir)
    back = 1 / F.col("vid_scale")
    c = lambda v: F.lit(v).cast("long")
    sizes = channels.where("channel = 'r'").select("gid", "height", "width")
    grids = grid.ordered_frames(d.images).where("place < 2").select(F.col("video_id").alias("sample_id"), F.col("place").alias("rel_frame"), F.col("image_id").alias("gid"), F.lit("r").alias("channel"), c(2).alias("y0"), c(8).alias("y1"), c(3).alias("x0"), c(11).alias("x1"), F.array(back, F.lit(0.0), F.lit(0.0), F.lit(0.0), back, F.lit(0.0)).alias("warp"))
    return _digest(resample.aligned_lines(tiles, grids.join(sizes, "gid"), linear=False, tile=TILE, then=SUMS), "sample_id", "rel_frame")


@registered("native_jagged", PRELUDE + f", ch AS ({CHANNELS.format(images='images')}) SELECT gid, channel, height, width, round(img_width / width, 6) AS scale FROM ch")
def native_jagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.native_parts(_raster(spark, sf_dir)[1]).withColumn("scale", F.round("scale", 6))


@registered("largest_part", PRELUDE + f", ch AS ({CHANNELS.format(images='images')}) SELECT gid, channel, height, width FROM ch QUALIFY row_number() OVER (PARTITION BY gid ORDER BY height * width DESC, channel) = 1")
def largest_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.largest_part(_raster(spark, sf_dir)[1])


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = derived(spark, sf_dir).images
    own = images.withColumns({"file_name": F.when(F.col("id") % 5 > 0, F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".png"))), "channels": F.lit("r|g")})
    three = lambda v: F.array(*[F.lit(x) for x in (v, 0.0, 0.0, 0.0, v, 0.0)])
    aux = images.where("id % 2 = 0").select(F.col("id").alias("gid"), F.concat(F.lit("aux"), F.col("id").cast("string"), F.lit(".tif")).alias("file_name"), F.lit("b").alias("channels"), F.when(F.col("id") % 4 == 0, three(4.0)).alias("warp_aux_to_img"), F.when(F.col("id") % 4 == 2, three(0.5)).alias("warp_img_to_aux"))
    return rasters.asset_table(own, aux)


ASSETS = PRELUDE + """,
asst AS (SELECT id AS gid, unnest(['r', 'g']) AS channel, 'img' || id || '.png' AS file_name, 1.0::DOUBLE AS scale FROM images WHERE id % 5 > 0
  UNION ALL SELECT id, 'b', 'aux' || id || '.tif', CASE WHEN id % 4 = 0 THEN 4.0 ELSE 2.0 END FROM images WHERE id % 2 = 0)"""


@registered("asset_table", ASSETS + " SELECT * FROM asst")
def asset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assets(spark, sf_dir).select("gid", "channel", "file_name", F.get("warp", F.lit(0)).alias("scale"))


@registered("channel_union", ASSETS + " SELECT video_id AS sample_id, string_agg(DISTINCT channel, '|' ORDER BY channel) AS channels FROM asst JOIN images i ON i.id = gid GROUP BY 1")
def channel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = derived(spark, sf_dir).images.select(F.col("video_id").alias("sample_id"), F.col("id").alias("gid"))
    return rasters.channel_union(frames, rasters.wanted_channels(_assets(spark, sf_dir))).withColumn("channels", F.array_join("channels", "|"))


@registered("nonzero_check", PIXELS + " SELECT gid, channel, max(v * (gid % 7 <> 0)::INT) > 0 AS has_data FROM pix GROUP BY ALL")
def nonzero_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _made(_raster(spark, sf_dir)[1], lambda column, y, x: _value(column, y, x) * (column("gid") % 7 != 0))
    return rasters.empty_channels(tiles)


def _cut(batch: pa.RecordBatch, values: pa.ListArray) -> pa.ListArray:
    """Tiles of every tenth image with their first pixel alone, or none if that is all they have."""
    n, short = values.value_lengths().to_numpy(zero_copy_only=False), batch.column("gid").to_numpy() % 10 == 2
    left = np.where(short, n > 1, n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return rasters.listed(values.flatten().to_numpy(zero_copy_only=False)[place < np.repeat(left, n)], left)


@registered("tile_validation", PRELUDE + f""", ch AS ({CHANNELS.format(images='images')}), ti AS (SELECT gid, channel, ceil(height / 16) * ceil(width / 16) AS n FROM ch)
SELECT gid, channel, CASE gid % 10 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS missing, CASE gid % 10 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS repeated, CASE gid % 10 WHEN 2 THEN n ELSE 0 END::BIGINT AS misfit FROM ti WHERE gid % 10 < 3""")
def tile_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, channels, made = _raster(spark, sf_dir)
    first = (F.col("ty") == 0) & (F.col("tx") == 0)
    # Tiles are left out and repeated before they have pixels, so that these are made once.
    kept = made.rows.where(~(first & (F.col("gid") % 10 == 0)))
    broken = kept.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(first & (F.col("gid") % 10 == 1), 2).otherwise(1)))).drop("copy")
    return rasters.tile_faults(rasters.tile_sizes(rasters.MadeTiles(broken, made.value, TILE), _cut), channels, TILE)


@registered("ingest_left", PRELUDE + f", ch AS ({CHANNELS.format(images='images')}) SELECT gid, channel FROM ch WHERE gid % 3 = 0")
def ingest_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, channels, tiles = _raster(spark, sf_dir)
    return rasters.not_ingested(channels, tiles.rows.where("gid % 3 <> 0")).select("gid", "channel")


@registered("compress_heuristic", PRELUDE + """ SELECT id, CASE id % 4 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'LZW' ELSE CASE WHEN id % 3 = 0 AND id % 5 < 3 THEN 'JPEG' ELSE 'RAW' END END AS codec FROM images""")
def compress_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = derived(spark, sf_dir).images
    name = F.concat(F.lit("a.b/img"), F.col("id").cast("string"), F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".tif", ""))), (F.col("id") % 4 + 1).cast("int")))
    codec = rasters.compression_of(name, F.when(F.col("id") % 3 == 0, "uint8").otherwise("uint16"), F.when(F.col("id") % 5 < 3, 3).otherwise(1))
    return images.select("id", codec.alias("codec"))


@registered("cache_path_hash", PRELUDE + " SELECT id, substr(sha1('images/' || id || '.png'), 1, 2) || '/' || substr(sha1('images/' || id || '.png'), 3) || '.cog.tif' AS path FROM images")
def cache_path_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".png"))
    return derived(spark, sf_dir).images.select("id", rasters.cache_path(name, ".cog.tif").alias("path"))

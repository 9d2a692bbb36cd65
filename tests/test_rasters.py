"""Resampled lines and the tile store, against plain loops and their plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import rasters, resample
from tesselar.plans import catalog
from tesselar.sources.annotations import derived
from tesselar.sources.tiles import TileStore

TILE = 4
GRID = "sample_id long, rel_frame int, gid long, channel string, y0 long, y1 long, x0 long, x1 long, warp array<double>, height int, width int"


def tiles_of(spark, images):
    """images: {(gid, channel): rows of numbers}."""
    rows = []
    for (gid, channel), px in images.items():
        h, w = len(px), len(px[0])
        for ty in range(-(-h // TILE)):
            for tx in range(-(-w // TILE)):
                part = [row[tx * TILE : (tx + 1) * TILE] for row in px[ty * TILE : (ty + 1) * TILE]]
                rows.append((gid, channel, h, w, ty, tx, len(part), len(part[0]), [v for row in part for v in row]))
    return spark.createDataFrame(rows, "gid long, channel string, height int, width int, ty int, tx int, th int, tw int, values array<double>")


def weights(u, a, t, n, linear):
    c = a * (u + 0.5) + t
    if not 0 <= c < n:
        return None
    if not linear:
        return {math.floor(c): 1.0}
    half = max(abs(a), 1)
    found = {j: 1 - abs(j + 0.5 - c) / half for j in range(n) if abs(j + 0.5 - c) < half}
    return {j: w / sum(found.values()) for j, w in found.items()}


def brute(px, y0, y1, x0, x1, warp, linear):
    a, _, c, _, e, f = warp
    out = []
    for y in range(y0, y1):
        wy, line = weights(y, e, f, len(px), linear), []
        for x in range(x0, x1):
            wx = weights(x, a, c, len(px[0]), linear)
            line.append(None if wy is None or wx is None else sum(p * q * px[j][i] for j, p in wy.items() for i, q in wx.items()))
        out.append(line)
    return out


@pytest.mark.parametrize("linear", [True, False])
def test_lines_brute(spark, linear):
    """Shrunk, enlarged, shifted and flipped channels over many tiles and bands, with grids that go beyond them."""
    r = random.Random(3)
    images = {(g, c): [[float(r.randrange(100)) for _ in range(w)] for _ in range(h)] for g, c, h, w in ((1, "r", 13, 10), (1, "b", 5, 3), (2, "r", 1, 1))}
    maps = [(1, 0, 0, 0, 1, 0), (0.4, 0, 0, 0, 0.4, 0), (2.5, 0, -1.3, 0, 3, 0.7), (-1, 0, 10, 0, 1, 0), (0.3, 0, 2.2, 0, 0.9, -4)]
    grids = []
    for i, m in enumerate(maps):
        for (g, c), px in images.items():
            grids.append((10 * i + g, 0, g, c, -2, 9, -1, 12, [float(v) for v in m], len(px), len(px[0])))
    got = resample.aligned_lines(tiles_of(spark, images), spark.createDataFrame(grids, GRID), linear, tile=TILE, band=3).collect()
    assert len(got) == 11 * len(grids)
    found = {}
    for row in got:
        found.setdefault((row.sample_id, row.channel), []).append((row.y, row.x, row["values"]))
    for i, m in enumerate(maps):
        for (g, c), px in images.items():
            want = brute(px, -2, 9, -1, 12, m, linear)
            for y, x, line in found[10 * i + g, c]:
                assert x == -1 and [None if math.isnan(v) else round(v, 6) for v in line] == [None if v is None else round(v, 6) for v in want[y + 2]]


def test_fill_fusion_and_faults(spark):
    images = {(1, "r"): [[1.0, 2.0], [3.0, 4.0]]}
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    grids = spark.createDataFrame([(7, 0, 1, "r", -1, 2, 0, 3, one, 2, 2)], GRID)
    tiles = tiles_of(spark, images)
    lines = resample.aligned_lines(tiles, grids, fill=-1.0, tile=TILE)
    assert [r["values"] for r in lines.orderBy("y").collect()] == [[-1, -1, -1], [1, 2, -1], [3, 4, -1]]
    fused = resample.fused_lines(lines, ["r", "g"]).where("y = 0").first()
    assert fused["r"] == [1, 2, -1] and all(map(math.isnan, fused["g"])) and len(fused["g"]) == 3
    with pytest.raises(Exception, match="tiles are missing"):
        resample.aligned_lines(tiles.limit(0), grids, tile=TILE).collect()
    turned = grids.withColumn("warp", F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0, -1.0, 0.0, 2.0)]))
    with pytest.raises(Exception, match="turns or shears"):
        resample.aligned_lines(tiles, turned, tile=TILE).collect()
    assert resample.aligned_lines(tiles, grids.limit(0), tile=TILE).count() == 0
    pixels = rasters.aligned_pixels(tiles, turned.withColumn("y1", F.lit(2).cast("long")), TILE).where("y >= 0")
    assert {(r.y, r.x): r.v for r in pixels.collect()} == {(0, 0): 3.0, (0, 1): 1.0, (1, 0): 4.0, (1, 1): 2.0}


def test_tile_store(spark, tmp_path):
    channels = spark.range(40).select(F.col("id").alias("gid"), F.lit("r").alias("channel"), F.lit(9).alias("height"), F.lit(6).alias("width"))
    make = lambda rows: rasters.made_tiles(rows, lambda y, x: F.col("gid") * 100 + y * 10 + x, TILE)
    store = TileStore(spark, f"file://{tmp_path}/tiles", 4, TILE)
    assert store.ingest(channels.where("gid < 30"), make) and store.ingest(channels, make) and not store.ingest(channels, make)
    again = TileStore(spark, f"file://{tmp_path}/tiles", 4, TILE)  # another session's view of the same files
    assert again.tiles().count() == 40 * 6 and rasters.tile_faults(again.tiles(), channels, TILE).count() == 0
    assert not again.ingest(channels, make)
    regions = spark.createDataFrame([(1, 3, 2, 7, 1, 6), (2, 35, 0, 3, 5, 9)], "sample_id long, gid long, y0 long, y1 long, x0 long, x1 long")
    lines = again.lines(regions)
    got = {(r.sample_id, r.y, r.x + i): v for r in lines.collect() for i, v in enumerate(r["values"])}
    assert got == {(s, y, x): g * 100 + y * 10 + x for s, g, a, b, c, d in ((1, 3, 2, 7, 1, 6), (2, 35, 0, 3, 5, 6)) for y in range(a, b) for x in range(c, d)}
    plan = lines._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(gid, [3,35])" in plan.split("PushedFilters", 1)[1].split("\n")[0]
    # A join too large to broadcast doesn't shuffle tiles.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = rasters.region_lines(again.tiles(), regions, TILE)
        plan = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    again.close()


def test_store_moves_no_pixels(spark, tmp_path):
    """Made tiles get their pixels after they are dealt and sorted, with no sort in the writing, and regions look up tiles that are not sorted."""
    channels = spark.range(1500).select(F.col("id").alias("gid"), F.lit("r").alias("channel"), F.lit(9).alias("height"), F.lit(6).alias("width"))
    store = TileStore(spark, f"file://{tmp_path}/tiles", 4, TILE)
    make = lambda rows: rasters.MadeTiles(rasters.tile_layout(rows, TILE), lambda column, y, x: column("gid") * 100 + y * 10 + x, TILE)
    plan = store.dealt(make(channels))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Sort") < plan.index("Exchange") and plan.count("MapInArrow") == 1
    name = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert store.ingest(channels.where("gid < 1400"), make) and store.ingest(channels, make) and not store.ingest(channels, make)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == name
    assert len(list((tmp_path / "tiles").glob("*.parquet"))) == 8 and rasters.tile_faults(store.tiles(), channels, TILE).count() == 0
    regions = channels.select(F.col("gid").alias("sample_id"), "gid", *[F.lit(v).cast("long").alias(c) for c, v in (("y0", 2), ("y1", 7), ("x0", 1), ("x1", 9))])
    lines = store.lines(regions)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortedBy", "") and plan.count("Exchange hashpartitioning") == 1
    total = lines.select(F.explode("values").alias("v")).agg(F.count("*").alias("n"), F.sum("v").alias("s")).first()
    want = [g * 100 + y * 10 + x for g in range(1500) for y in range(2, 7) for x in range(1, 6)]
    assert (total.n, total.s) == (len(want), sum(want))
    store.close()


def test_made_tiles(spark):
    """Tiles whose pixels are made after the joins give the lines that stored ones give; they are neither broadcast nor made in the tasks of the file."""
    channels = spark.createDataFrame([(g, c, k, 9 + g, 6 + k) for g in range(6) for k, c in enumerate("rg")], "gid long, channel string, c int, height int, width int")
    made = rasters.MadeTiles(rasters.tile_layout(channels, TILE), lambda column, y, x: column("gid") * 100 + y * 10 + x + column("c") * 7, TILE)
    stored = rasters.made_tiles(channels, lambda y, x: F.col("gid") * 100 + y * 10 + x, TILE)
    stored = stored.withColumn("values", F.transform("values", lambda v: v + F.when(F.col("channel") == "g", 7).otherwise(0)))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(made.frame()) == rows(stored.select(made.frame().columns))
    regions = spark.createDataFrame([(k, k % 6, -2, 7 + k, 1, 5 + k) for k in range(9)], "sample_id long, gid long, y0 long, y1 long, x0 long, x1 long")
    lines = rasters.region_lines(made, regions, TILE)
    assert "Broadcast" not in lines._jdf.queryExecution().executedPlan().toString()
    assert rows(lines) == rows(rasters.region_lines(stored, regions, TILE))
    wanted = regions.select("sample_id", F.explode(F.array(*map(F.lit, "rgq"))).alias("channel"))
    for band in (2, 64):
        padded = rasters.padded_lines(made, regions, wanted, -1.0, TILE, band)
        assert padded.count() == 3 * sum(9 + k for k in range(9)) and rows(padded) == rows(rasters.padded_lines(stored, regions, wanted, -1.0, TILE))
    grids = regions.join(channels, "gid").withColumns({"rel_frame": F.lit(0), "warp": F.array(*[F.lit(v) for v in (0.7, 0.0, 0.2, 0.0, 1.9, 0.0)])})
    aligned = resample.aligned_lines(made, grids, tile=TILE, band=3)
    assert "Broadcast" not in aligned._jdf.queryExecution().executedPlan().toString()
    assert rows(aligned) == rows(resample.aligned_lines(stored, grids, tile=TILE, band=64))


def test_pixels_stay_in_their_tasks(spark):
    """Sums of lines and checks of made tiles leave no pixels for Spark to move, and are those of stored tiles."""
    channels = spark.createDataFrame([(g, c, k, 9 + g, 6 + k) for g in range(6) for k, c in enumerate("rg")], "gid long, channel string, c int, height int, width int")
    value = lambda column, y, x: (column("gid") % 3) * (y * 10 + x + column("c"))
    made = rasters.MadeTiles(rasters.tile_layout(channels, TILE), value, TILE)
    stored = made.frame().localCheckpoint()
    then = rasters.Summary(lambda y, x, values, at: [np.diff(np.concatenate(([0.0], np.cumsum(values)))[at]), y * 1000 + x], "total double, place long")
    rows = lambda df: sorted(map(repr, df.collect()))
    regions = spark.createDataFrame([(k, k % 6, -2, 7 + k, 1, 5 + k) for k in range(9)], "sample_id long, gid long, y0 long, y1 long, x0 long, x1 long")
    wanted = regions.select("sample_id", F.explode(F.array(*map(F.lit, "rgq"))).alias("channel"))
    grids = regions.join(channels, "gid").withColumns({"rel_frame": F.lit(0), "warp": F.array(*[F.lit(v) for v in (0.7, 0.0, 0.2, 0.0, 1.9, 0.0)])})
    for lines in (
        lambda tiles: rasters.region_lines(tiles, regions, TILE, then),
        lambda tiles: rasters.padded_lines(tiles, regions, wanted, -1.0, TILE, 3, then),
        lambda tiles: resample.aligned_lines(tiles, grids, fill=0.0, tile=TILE, band=3, then=then),
        rasters.empty_channels,
    ):
        plan = lines(made)._jdf.queryExecution().executedPlan().toString()
        assert "values" not in plan and "Broadcast" not in plan
        assert rows(lines(made)) == rows(lines(stored))
    assert {r.gid: r.has_data for r in rasters.empty_channels(made).collect()} == {g: g % 3 > 0 for g in range(6)}


def test_made_channels_side_by_side(spark):
    """Bands that meet made channels, and channels put together by tasks, give what tiles and a pivot of lines give; a band stays one row, and no pixels are shuffled."""
    channels = spark.createDataFrame([(g, c, k, 9 + g, 6 + k) for g in range(6) for k, c in enumerate("rg") if g < 5 or c == "r"], "gid long, channel string, c int, height int, width int")
    value = lambda column, y, x: column("gid") * 100 + y * 10 + x + column("c") * 7
    by_tile = rasters.MadeTiles(rasters.tile_layout(channels, TILE), value, TILE)
    made = rasters.MadeTiles(by_tile.rows, value, TILE, channels)
    rows = lambda df: sorted(map(repr, df.collect()))
    frames = spark.createDataFrame([(k, k % 3, k % 6, -2, 7 + k, 1, 5 + k) for k in range(9)], "sample_id long, rel_frame int, gid long, y0 long, y1 long, x0 long, x1 long")
    grids = frames.join(channels.drop("c"), "gid").withColumn("warp", F.array(*[F.lit(v) for v in (0.7, 0.0, 0.2, 0.0, 1.9, 0.0)]))
    for linear in (True, False):
        lines = resample.aligned_lines(made, grids, linear, 0.0, TILE, 3)
        assert rows(lines) == rows(resample.aligned_lines(by_tile, grids, linear, 0.0, TILE, 64))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "tx" not in plan.replace("tx_", "") and plan.index("MapInArrow") < plan.index("SortMergeJoin")
        want = resample.fused_lines(lines, ["r", "g", "q"]).drop("x")
        for tiles in (made, by_tile, by_tile.frame()):
            got = resample.aligned_channels(tiles, grids, ["r", "g", "q"], linear, 0.0, TILE, 3).drop("gid")
            assert rows(got) == rows(want.select(got.columns))
        plan = resample.aligned_channels(made, grids, ["r", "g"], linear, 0.0, TILE, 3)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan[plan.index("Exchange") :]  # nothing is shuffled once there are pixels
        whole = resample.aligned_channels(made, grids.withColumn("own", F.struct("y1")), ["r", "g", "q"], linear, 0.0, TILE, 3, True, ("own",))
        assert all(r.own.y1 == 7 + r.sample_id for r in whole.collect()) and whole.count() == 9
        assert rows(whole.select("sample_id", "rel_frame", F.inline("lines"))) == rows(want.select("sample_id", "rel_frame", "y", "r", "g", "q"))
    then = lambda added: rasters.Summary(lambda y, x, values, at: [np.diff(np.concatenate(([0.0], np.cumsum(values)))[at]), y * 1000 + x], "total double, place long", added)
    sums = lambda added: resample.aligned_lines(made, grids, True, 0.0, TILE, 3, then(added)).groupBy("sample_id", "channel").agg(F.round(F.sum("total"), 6), F.sum("place"), F.lit(0))
    assert rows(sums(True)) == rows(sums(False))
    assert resample.aligned_lines(made, grids, True, 0.0, TILE, 3, then(True)).count() < lines.count() / 2


def test_bands_of_one_shape(spark, monkeypatch):
    """Bands of few shapes are resampled shape by shape, to the same numbers."""
    r = np.random.default_rng(5)
    for linear in (True, False):
        for n_shapes in (1, 3, 5):
            n, pick = 40, r.integers(0, n_shapes, 40)
            each = lambda *v: r.choice(v, n_shapes)[pick]
            high, wide = each(1, 2, 5), each(1, 4, 6)
            some = {"ya": each(-2, 0), "yb": each(1, 4), "x0": each(-2, 0), "x1": each(1, 6), "sy": each(0.4, 1.0, 2.5), "sx": each(0.3, -1.0, 1.0), "ty_": each(0.0, -40.0, 1.3), "tx_": each(0.0, 2.0), "height": high, "width": wide}
            values, zero, calls = r.random((high * wide).sum()), np.zeros(n, int), []
            monkeypatch.setattr(resample, "together", lambda *a, own=resample.together: calls.append(1) or own(*a))
            whole = resample.resampled(some, rasters.Parts(np.arange(n), zero, zero, high, wide, values, None), linear, -1.0)
            monkeypatch.setattr(resample, "ALIKE", 1000)
            assert np.array_equal(whole, resample.resampled(some, rasters.Parts(np.arange(n), zero, zero, high, wide, values, None), linear, -1.0))
            monkeypatch.undo()
            assert len(calls) <= 2 * n_shapes


def test_whole_images_are_resampled(spark, sf_dir):
    """Shrunk channels have all pixels of each image at half its size, and channels side by side all its lines."""
    sizes = {r.id: (r.height // 20, r.width // 20) for r in derived(spark, sf_dir).images.collect()}
    shrunk = catalog.QUERIES["channels_shrunk_smooth"](spark, sf_dir).collect()
    assert len(shrunk) == 2 * len(sizes) and all(r.n == (sizes[r.sample_id][0] // 2) * (sizes[r.sample_id][1] // 2) for r in shrunk)
    lines = catalog.QUERIES["fused_missing_channel"](spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("n_nan").alias("n_nan")).collect()
    assert {r.sample_id: r.n for r in lines} == {i: h for i, (h, _) in sizes.items()}
    assert all(r.n_nan == (sizes[r.sample_id][0] * sizes[r.sample_id][1] if r.sample_id % 2 else 0) for r in lines)


def test_bands_are_resampled_together(spark):
    """One call for many bands, some of which are outside of their channel, is what a call for each gives."""
    r = np.random.default_rng(1)
    n, high, wide = 40, r.integers(1, 5, 40), r.integers(1, 6, 40)
    some = {"ya": np.zeros(n, int), "yb": r.integers(1, 4, n), "x0": -r.integers(0, 3, n), "x1": r.integers(1, 7, n), "sy": r.choice([0.4, 1.0, 2.5], n), "sx": r.choice([0.3, -1.0, 1.0], n), "ty_": r.choice([0.0, -40.0], n), "tx_": r.choice([0.0, 2.0], n), "height": high, "width": wide}
    values, ends, zero = r.random((high * wide).sum()), np.cumsum(high * wide), np.zeros(n, int)
    for linear in (True, False):
        whole = resample.resampled(some, rasters.Parts(np.arange(n), zero, zero, high, wide, values, None), linear, -1.0)
        each = [resample.resampled({k: v[i : i + 1] for k, v in some.items()}, rasters.Parts(zero[:1], zero[:1], zero[:1], high[i : i + 1], wide[i : i + 1], values[ends[i] - high[i] * wide[i] : ends[i]], None), linear, -1.0) for i in range(n)]
        assert np.array_equal(whole, np.concatenate(each))


def test_sizes_of_tiles(spark):
    """Faults of made tiles are found by sizes that tasks take, and are those of the tiles themselves."""
    channels = spark.createDataFrame([(g, "r", 0, 9 + g, 6) for g in range(4)], "gid long, channel string, c int, height int, width int")
    made = rasters.MadeTiles(rasters.tile_layout(channels, TILE).where("gid <> 1 or ty > 0"), lambda column, y, x: y + x, TILE)
    first = lambda batch, values: rasters.listed(np.ones(len(values)), np.ones(len(values), int))
    sizes = rasters.tile_sizes(made)
    assert "array<double>" not in dict(sizes.dtypes).values()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(rasters.tile_faults(sizes, channels, TILE)) == rows(rasters.tile_faults(made.frame(), channels, TILE)) == [(1, "r", 2, 0, 0)]
    assert {r.misfit for r in rasters.tile_faults(rasters.tile_sizes(made, first), channels, TILE).collect()} > {4}

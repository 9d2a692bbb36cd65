"""A store of image tiles: Parquet in a shared folder, bucketed by tile and sorted, to which only what it lacks is added."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rasters import TILE, MadeTiles, layout_of, not_ingested, region_lines, with_pixels

BUCKETS = 32
#: A scan for regions of up to so many images names them, and so skips the row groups of others.
NAMED = 1000
COLUMNS = "gid BIGINT, channel STRING, height INT, width INT, ty INT, tx INT, th INT, tw INT, values ARRAY<DOUBLE>"
KEYS = ("gid", "ty", "tx")
ORDER = ("gid", "channel", "ty", "tx")
#: A task sorts what it writes once it has more files open than this says; tasks that have a bucket each never do.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class TileStore:
    """Tiles under a path, for all sessions that open it with the same number of buckets.

    A join with regions has the bucket columns as its keys, so tiles are not shuffled for it. Tiles are dealt to buckets and sorted before their
    pixels are made, and looked up by regions as they are read, so pixels are neither shuffled nor sorted. Spark's commit makes a writing whole or
    absent; two writers at once are up to the caller.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, tile: int = TILE):
        self.spark, self.path, self.buckets, self.tile = spark, path, buckets, tile
        self.name = f"tiles_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def tiles(self) -> DataFrame:
        return self.spark.table(self.name)

    def dealt(self, made: DataFrame | MadeTiles) -> DataFrame:
        """Tiles as they are written: a task has those of a bucket, in order."""
        types = dict(self.tiles().dtypes)
        rows = layout_of(made)
        rows = rows.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in rows.columns}).repartition(self.buckets, *KEYS).sortWithinPartitions(*ORDER)
        return with_pixels(made, rows).select(*types)

    def ingest(self, channels: DataFrame, make: Callable[[DataFrame], DataFrame | MadeTiles]) -> bool:
        """Add the tiles that `make` gives for those channels that have none; False if there was nothing to add.

        A channel is there if its first tile is.
        """
        left = not_ingested(channels, self.tiles().where("ty = 0 and tx = 0"))
        if left.isEmpty():
            return False
        rows, before = self.dealt(make(left)), self.spark.conf.get(WRITERS)
        self.spark.conf.set(WRITERS, 2)
        try:
            rows.write.insertInto(self.name)
        finally:
            self.spark.conf.set(WRITERS, before)
        self.spark.catalog.refreshTable(self.name)
        return True

    def lines(self, regions: DataFrame) -> DataFrame:
        """Pixels of regions, as region_lines gives them."""
        tiles, asked = self.tiles(), regions.select("gid").distinct().limit(NAMED + 1).collect()
        if len(asked) <= NAMED:
            return region_lines(tiles.where(F.col("gid").isin([r["gid"] for r in asked])), regions, self.tile)
        # A bucket's regions are held in memory; a merge join would sort its tiles with their pixels.
        return region_lines(tiles, regions.hint("shuffle_hash"), self.tile)

    def close(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")

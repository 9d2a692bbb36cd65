"""Places of rows in an order, dense from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """df with places from 0 in an order without ties. Sorted by range, so no task holds it all; a partition's rows are counted on from its offset."""
    mark = "_row_in_part"
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()), "ordinal")
    part, place = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for p, n in sorted(ranged.groupBy(part.alias("p")).count().collect()):  # one row a partition
        offsets.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    found = ranged.join(F.broadcast(offsets), part == F.col("_part"))
    return found.withColumn(name, place + F.col("_offset")).drop(mark, "_part", "_offset")

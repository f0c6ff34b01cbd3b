"""Equi-join keys with hot cells split into a grid of bounded tiles.

A key value ("cell") with l left and r right rows is a block of l*r comparisons.  Cells above the tile size
are cut into ceil(l/size) x ceil(r/size) tiles: each left row picks one grid row by hash and is copied to the
grid's columns, and the other way round.  Every (left, right) combination of a cell meets in exactly one tile,
so the result is the plain equi-join, while no task holds more than about size x size comparisons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlink.session import spread

TILE_ROWS = 20_000


def tiled(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], tile_rows: int = TILE_ROWS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with grid coordinates, and the extended equi-join key.

    The table of hot cells has at most rows/tile_rows entries per side; its join strategy is left to the
    size that Spark measures.
    """
    n_left = left.groupBy(*keys).agg(F.count("*").alias("_nl"))
    n_right = right.groupBy(*keys).agg(F.count("*").alias("_nr"))
    grid = (
        n_left.join(n_right, keys)
        .where((F.col("_nl") > tile_rows) | (F.col("_nr") > tile_rows))
        .select(
            *keys,
            F.ceil(F.col("_nl") / tile_rows).cast("int").alias("_gl"),
            F.ceil(F.col("_nr") / tile_rows).cast("int").alias("_gr"),
        )
    )

    def place(df: DataFrame, ids: list[str], own: str, other: str, own_cell: str, other_cell: str) -> DataFrame:
        n_own, n_other = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
        return (
            df.join(grid, keys, "left")
            .withColumn(own_cell, F.pmod(F.xxhash64(*ids), n_own).cast("int"))
            .withColumn(other_cell, F.explode(F.sequence(F.lit(0), n_other - 1)))
            .drop("_gl", "_gr")
        )

    cell = [*keys, "_tl", "_tr"]
    l = place(left, left_id, "_gl", "_gr", "_tl", "_tr")
    r = place(right, right_id, "_gr", "_gl", "_tr", "_tl")
    # A tile costs far more work than bytes.  A fixed number of partitions by tile keeps the work spread where
    # a size-based choice would coalesce it, and the other side is shuffled to match or broadcast if small.
    return spread(l, cell), r, cell

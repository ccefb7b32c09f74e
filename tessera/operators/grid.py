"""The uniform grid: cells of equal size over an area of interest, and the ids of each key in them."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rects import Rect, point_in, step_of


def grid_side(cells: int) -> int:
    """Rows, and columns, of a grid of at most so many cells."""
    if cells < 1:
        raise ValueError(f"a grid has one cell at least, not {cells}")
    return isqrt(cells)


def cell_of(area: Rect, g: int) -> tuple[Column, Column]:
    """(row, column): rows by latitude (y), columns by longitude (x)."""
    return step_of(F.col("y"), area.y0, area.y1, g).cast("int").alias("row"), step_of(F.col("x"), area.x0, area.x1, g).cast("int").alias("col")


def with_cell(points: DataFrame, area: Rect, cells: int) -> DataFrame:
    """The points in the closed area, with row, col and cell = row * side + col."""
    g = grid_side(cells)
    row, col = cell_of(area, g)
    inside = points.where(point_in(F.col("x"), F.col("y"), area)).withColumns({"row": row, "col": col})
    return inside.withColumn("cell", F.col("row") * g + F.col("col"))


def collect_ids(points: DataFrame, area: Rect, cells: int, group: str = "xy") -> DataFrame:
    """(row, col, x, y, ids): the ids of each key of each cell, ascending, joined by ', '. group 'x' takes points of
    one longitude in a cell as one key, under their largest latitude."""
    if group not in ("xy", "x"):
        raise ValueError(f"group is xy or x, not {group}")
    placed = with_cell(points, area, cells)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ", ").alias("ids")
    if group == "x":
        return placed.groupBy("row", "col", "x").agg(F.max("y").alias("y"), ids)
    return placed.groupBy("row", "col", "x", "y").agg(ids)


def write_grid(lines: DataFrame, path: str) -> None:
    """Text lines (row, col, value), in a folder for each row and column."""
    lines.write.mode("overwrite").partitionBy("row", "col").text(path)


def grid_lines(collected: DataFrame) -> DataFrame:
    key = F.concat(F.lit("Lon: "), F.col("x").cast("string"), F.lit(" Lat: "), F.col("y").cast("string"))
    return collected.select("row", "col", F.concat_ws("\t", key, F.concat("ids", F.lit(", "))).alias("value"))

"""Queries without an index, and the text forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rects import Rect, pair_text, point_in, point_text


def linear_scan(points: DataFrame, rect: Rect, sort: bool = False) -> DataFrame:
    """The points in a closed rectangle, by x, y and id if sorted; it's also the oracle of the index."""
    out = points.where(point_in(F.col("x"), F.col("y"), rect)).select("id", "x", "y")
    return out.orderBy("x", "y", "id") if sort else out


def scan_lines(found: DataFrame) -> DataFrame:
    """key, tab, id."""
    return found.select(F.concat_ws("\t", point_text(F.col("x"), F.col("y")), F.col("id").cast("string")).alias("value"))


def pair_lines(found: DataFrame) -> DataFrame:
    """(key, id)"""
    key = F.col("str") if "str" in found.columns else point_text(F.col("x"), F.col("y"))
    return found.select(pair_text(key, F.col("id")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)

"""Extracted tables: gates, clean-up and checks on ``rows array<array<string>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import geometry as G
from ..functions.text import cell_text, strip


def drop_empty_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))


def strip_cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))


def normalize_cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, cell_text))


def is_regular(rows: Column) -> Column:
    """A first row with cells, and no row more than one cell longer or shorter than it."""
    first = F.size(F.try_element_at(rows, F.lit(1)))
    return (F.size(rows) > 0) & (first > 0) & F.forall(rows, lambda r: F.abs(F.size(r) - first) <= 1)


def flip_box(bbox: Column, width: Column, height: Column) -> Column:
    """From points with the origin at the bottom to the unit square with the origin at the top."""
    return G.normalize(G.box(bbox["x1"], height - bbox["y2"], bbox["x2"], height - bbox["y1"]), width, height)


def table_blocks(tables: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(doc_id, page, table_no, accuracy, rows, bbox, width, height) to table blocks.

    Tables below the accuracy, and tables of empty rows, go; ids keep the detector's
    numbers, so they leave gaps.
    """
    confidence = F.col("accuracy") / 100
    kept = tables.where(confidence >= config.table_accuracy).withColumn("rows", drop_empty_rows(F.col("rows"))).where(F.size("rows") > 0)
    return kept.select("doc_id", "page", F.format_string("p%d_t%d", F.col("page").cast("int"), F.col("table_no").cast("int")).alias("block_id"), F.lit("table").alias("type"), "rows", flip_box(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox"), confidence.alias("confidence"), F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_no")).cast("long").alias("pos"))

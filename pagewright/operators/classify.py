"""Page classification from image and text coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import strip
from .layout import PAGE


def coverage(boxes: DataFrame, pages: DataFrame, name: str) -> DataFrame:
    """Pages with the summed area of their boxes over their own; overlaps count double.

    Pages without boxes, or without area, have coverage 0. Boxes are summed by page
    before they meet the pages, so only one row a page is joined.
    """
    summed = boxes.groupBy(*PAGE).agg(F.sum(F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("bottom") - F.col("top"))).alias("__area"))
    size = F.col("width") * F.col("height")
    share = F.when(size > 0, F.coalesce(F.col("__area"), F.lit(0.0)) / size).otherwise(F.lit(0.0))
    return pages.join(summed, list(PAGE), "left").withColumn(name, share).drop("__area")


def page_type(image: Column, text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """digital, scan or hybrid; null coverages count as 0."""
    image, text = F.coalesce(image, F.lit(0.0)), F.coalesce(text, F.lit(0.0))
    pictured = F.when(text < config.text_coverage_threshold, F.when(text > 0, "hybrid").otherwise("scan")).otherwise(F.when(image > 0.8, "hybrid").otherwise("digital"))
    return F.when(image > config.image_area_threshold, pictured).when(text > 0.01, "digital").otherwise("scan")


def classify_pages(pages: DataFrame, words: DataFrame, images: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each page with both coverages and its type; a page with an ``error`` is a scan."""
    both = coverage(words, coverage(images, pages, "image_coverage"), "text_coverage")
    kind = page_type(F.col("image_coverage"), F.col("text_coverage"), config)
    return both.withColumn("page_type", F.when(F.col("error").isNotNull(), F.lit("scan")).otherwise(kind) if "error" in pages.columns else kind)


def has_extractable_text(text: Column, min_chars: int = 10) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= min_chars


def page_info() -> Column:
    """Debug view of a classified page: size, type and coverages in percent (half-even as doubles print)."""
    percent = lambda c: F.bround(F.col(c) * 100, 2)
    return F.struct("page", "width", "height", "page_type", percent("image_coverage").alias("image_percent"), percent("text_coverage").alias("text_percent"))


def route(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to read digitally, and pages to recognise."""
    return classified.where(F.col("page_type") == "digital"), classified.where(F.col("page_type") != "digital")

"""Recognition results to text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import geometry as G
from ..functions.text import normalize_text, postprocess_ocr, strip
from .layout import PAGE


def blocks_from_lines(words: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Word rows (doc_id, page, block_no, line_no, word_no, value, confidence, line_bbox) to blocks.

    Words join to lines, lines to blocks; the box is the union of the lines'. Confidence
    is the mean over words. Blocks without text or below the least confidence go, and do
    not use up a number.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "value"))), lambda w: w["value"]), " ")
    lines = words.groupBy(*PAGE, "block_no", "line_no").agg(text.alias("text"), F.first("line_bbox").alias("bbox"), F.sum("confidence").alias("total"), F.count("confidence").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("line_no", "text", "bbox")))
    blocks = lines.groupBy(*PAGE, "block_no").agg(F.transform(every, lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("lines"), G.union_of(F.col("bbox")).alias("bbox"), (F.sum("total") / F.sum("n")).alias("confidence"))
    joined = normalize_text(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    kept = blocks.withColumn("text", joined).where((F.col("text") != "") & (F.col("confidence") >= config.min_confidence))
    return _numbered(kept, "block_no")


def _numbered(blocks: DataFrame, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy(order))
    return blocks.withColumn("pos", n.cast("long")).withColumn("block_id", F.format_string("p%d_b%d", F.col("page").cast("int"), n))


def word_runs(words: DataFrame) -> DataFrame:
    """Usable words of a word table with the run they belong to.

    Words without text or with negative confidence go first. A run ends where
    ``block_num`` changes, so a number that returns later starts another run.
    """
    order = Window.partitionBy(*PAGE).orderBy("word_pos")
    usable = words.withColumn("conf", F.col("conf").cast("int")).where((strip(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0))
    change = (F.col("block_num") != F.lag("block_num").over(order)).cast("int")
    return usable.withColumn("__change", F.coalesce(change, F.lit(0))).withColumn("run", 1 + F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def blocks_from_word_table(words: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Runs to blocks: words joined by blanks, union of pixel boxes, mean confidence over 100."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_pos", "text"))), lambda w: strip(w["text"])), " ")
    box = F.struct(F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"))
    runs = word_runs(words).groupBy(*PAGE, "run").agg(text.alias("text"), G.union_of(box).alias("bbox"), (F.avg("conf") / 100).alias("confidence"))
    kept = runs.withColumn("text", normalize_text(F.col("text"))).where((F.length("text") >= 2) & (F.col("confidence") >= config.min_confidence))
    return _numbered(kept, "run")


def postprocess_blocks(blocks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Clean block texts; a text below two characters drops its block. Blocks without text pass, lines stay."""
    if not config.ocr_postprocess:
        return blocks
    clean = postprocess_ocr(F.col("text"), config.ocr_clean, config.ocr_fix_errors, config.ocr_merge_words, config.ocr_min_line_length)
    had_none = F.col("text").isNull() | (F.col("text") == "")
    # One array of none or one text: a filter on the cleaned text would be moved below it and clean twice.
    kept = F.filter(F.array(F.when(had_none, F.col("text")).otherwise(clean)), lambda t: had_none | (F.length(t) >= 2))
    others = [c for c in blocks.columns if c != "text"]
    return blocks.select(*others, F.explode(kept).alias("text")).select(*blocks.columns)

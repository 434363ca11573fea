"""The whole extraction plan: files to document trees, as one logical plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import geometry as G
from ..functions.text import strip
from ..operators import classify, layout, ocr_parse, tables
from ..operators.layout import PAGE
from ..sources import providers as P

BLOCK_COLUMNS = (*PAGE, "block_id", "type", "text", "bbox", "confidence", "rows", "lines", "pos")


#: Added to a table's position: tables follow a page's text blocks, however many there are.
AFTER_TEXT = 1 << 40


def as_blocks(rows: DataFrame) -> DataFrame:
    """The common block columns, with what a source lacks as typed nulls."""
    empty = {"text": "string", "confidence": "double", "rows": "array<array<string>>", "lines": f"array<struct<text:string,bbox:{G.BOX}>>"}
    for name, kind in empty.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if "type" not in rows.columns:
        rows = rows.withColumn("type", F.lit("paragraph"))
    return rows.select(*BLOCK_COLUMNS)


def digital_blocks(words: DataFrame, pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Words to paragraphs; a page with text but no words is one block over the whole page."""
    lines = layout.lines_of_words(words, pages, config.line_tolerance)
    found = as_blocks(layout.paragraphs(lines, config.paragraph_gap).withColumn("confidence", F.lit(1.0)))
    bare = pages.where(strip(F.coalesce("text", F.lit(""))) != "").join(words.select(*PAGE).distinct(), list(PAGE), "left_anti")
    one = F.lit(1.0)
    whole = bare.select(*PAGE, F.format_string("p%d_b1", F.col("page").cast("int")).alias("block_id"), "text", G.box(F.lit(0.0), F.lit(0.0), one, one).alias("bbox"), one.alias("confidence"), F.lit(1).cast("long").alias("pos"))
    return found.unionByName(as_blocks(whole))


def merge_tables(texts: DataFrame, found: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Text blocks outside tables, and the tables, numbered by reading order."""
    kept = layout.remove_overlapping(texts, found, config.table_overlap)
    both = as_blocks(kept).unionByName(as_blocks(found.withColumn("pos", F.col("pos") + AFTER_TEXT)))
    return layout.reading_order(both, tolerance=config.reading_order_y_tolerance)


def merge_marked(blocks: DataFrame, is_table: Column, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``merge_tables`` for text blocks and tables in one frame: it is read once, and keeps its own columns."""
    kept = layout.outside_tables(blocks, is_table, config.table_overlap)
    placed = kept.withColumn("pos", F.col("pos") + F.when(is_table, F.lit(AFTER_TEXT)).otherwise(F.lit(0)))
    return layout.reading_order(placed, tolerance=config.reading_order_y_tolerance)


def assemble(pages: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Document trees: every page 1..n is there, a page without blocks as an empty digital one."""
    block = F.struct("block_id", "type", "text", G.to_array(F.col("bbox")).alias("bbox"), "confidence", "rows", F.transform("lines", lambda x: F.struct(x["text"].alias("text"), G.to_array(x["bbox"]).alias("bbox"))).alias("lines"))
    per_page = blocks.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_pos", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    total = pages.groupBy("doc_id").agg(F.max("page").alias("total_pages"))
    every = total.select("doc_id", "total_pages", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page"))
    known = pages.select(*PAGE, F.when(F.col("page_type") == "digital", "digital").otherwise("ocr").alias("source"), "width", "height")
    full = every.join(known, list(PAGE), "left").join(per_page, list(PAGE), "left")
    page = F.struct("page", F.coalesce("source", F.lit("digital")).alias("source"), F.coalesce("blocks", F.array()).alias("blocks"), "width", "height", F.when(F.col("source") == "ocr", "px").otherwise("pt").alias("unit"))
    trees = full.groupBy("doc_id", "total_pages").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return trees.join(files.select("doc_id", "source_file"), "doc_id").select("doc_id", "source_file", "total_pages", F.current_timestamp().cast("timestamp_ntz").alias("processing_date"), "pages")


def summary(documents: DataFrame) -> DataFrame:
    """Pages, blocks and tables of each document."""
    blocks = F.flatten(F.transform("pages", lambda p: p["blocks"]))
    return documents.select("doc_id", "total_pages", F.size(blocks).alias("n_blocks"), F.size(F.filter(blocks, lambda b: b["type"] == "table")).alias("n_tables"))


@dataclass(frozen=True)
class Parsed:
    #: Document trees, and what failed: (doc_id, page, step, error).
    documents: DataFrame
    errors: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for rows in self.kept:
            rows.unpersist()


def ocr_blocks(images: DataFrame, engines: list, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Blocks of scanned pages and the errors of the last engine.

    Engines are tried in order: a page that one fails on goes to the next, whatever shape
    of rows either gives (words in lines, or a word table with pixel boxes).
    """
    blocks, left, errors = [], images, None
    for k, engine in enumerate(engines):
        read = P.recognise(left, engine)
        if len(engines) > 1:
            read = read.persist()  # an engine is dear: its rows serve both the blocks and the fallback
        failed = read.where("error is not null")
        good = read.where("error is null")
        if hasattr(engine, "word_table"):
            found = ocr_parse.blocks_from_word_table(good.drop("error"), config)
        else:
            found = ocr_parse.blocks_from_lines(good.drop("error"), config)
        blocks.append(as_blocks(ocr_parse.postprocess_blocks(found, config)))
        errors = failed.select(*PAGE, F.lit("recognise").alias("step"), "error")
        if k + 1 < len(engines):
            left = left.join(failed.select(*PAGE).distinct(), list(PAGE), "left_semi")
    return reduce(DataFrame.unionByName, blocks), errors


def parse(files: DataFrame, reader: P.PdfReader, engine=None, config: EngineConfig = EngineConfig(), keep: bool = False) -> Parsed:
    """Files (doc_id, source_file, content) to document trees; parallelism is Spark's.

    ``engine`` is one recognition engine or a list of them, tried in order. Pages that need
    recognition stay empty without one. Whatever step fails on a file or page is reported.
    ``keep`` persists what the reader gives, for a bounded number of files whose documents
    and errors are both wanted; ``release`` lets go of it.
    """
    steps = {what: P.extract(files, reader, what, ddl) for what, ddl in (("pages", P.PAGES), ("words", P.WORDS), ("images", P.IMAGES), ("tables", P.TABLES))}
    kept: list[DataFrame] = []

    def held(rows: DataFrame) -> DataFrame:
        if keep:
            kept.append(rows.persist())
        return rows

    steps = {what: held(rows) for what, rows in steps.items()}
    errors = [rows.where("error is not null").select("doc_id", "page", F.lit(what).alias("step"), "error") for what, rows in steps.items()]
    pages = steps["pages"]
    words, images, detected = (steps[x].where("error is null").drop("error") for x in ("words", "images", "tables"))
    typed = held(classify.classify_pages(pages, words, images, config))
    digital, scanned = classify.route(typed)
    texts = digital_blocks(words.join(digital.select(*PAGE), list(PAGE), "left_semi"), digital, config)
    engines = [] if engine is None else list(engine) if isinstance(engine, (list, tuple)) else [engine]
    if engines:
        scans = scanned.select(*PAGE).join(files.select("doc_id", "content"), "doc_id")
        read, failed = ocr_blocks(scans, engines, config)
        texts = texts.unionByName(read)
        errors.append(failed)
    found = tables.table_blocks(detected.join(digital.select(*PAGE), list(PAGE), "left_semi"), config)
    merged = merge_tables(held(texts), held(found), config)
    return Parsed(assemble(typed, merged, files), reduce(DataFrame.unionByName, errors), tuple(kept))


def process(files: DataFrame, reader: P.PdfReader, engine=None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The document trees of ``parse``."""
    return parse(files, reader, engine, config).documents

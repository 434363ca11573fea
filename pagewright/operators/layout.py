"""Page layout: words to lines, lines to paragraphs, blocks to reading order.

A page is the unit of every fold here, so the data of one page travels as one sorted
array and the shuffle is by (doc_id, page) only. Input position is always the last sort
key, because the order among equals matters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import bind

PAGE = ("doc_id", "page")


def number_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Give each word its line on the page.

    Words go by (top, x0). A word stays on the line while its top lies within the
    tolerance of the line's first word, the anchor; the anchor never moves.
    Needs doc_id, page, text, x0, x1, top, bottom and pos, the input position.
    """
    fields = ["top", "x0", "pos", "x1", "bottom", "text"]
    page = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ws"))
    kind = "array<struct<top:double,x0:double,pos:long,x1:double,bottom:double,text:string,line_no:int>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        same = s["anchor"].isNotNull() & (F.abs(w["top"] - s["anchor"]) <= tolerance)
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(F.when(same, s["anchor"]).otherwise(w["top"]).alias("anchor"), line.alias("line"), F.concat(s["out"], F.array(line)).alias("out"))

    cast = F.transform("ws", lambda w: F.struct(w["top"].cast("double").alias("top"), w["x0"].cast("double").alias("x0"), w["pos"].cast("long").alias("pos"), w["x1"].cast("double").alias("x1"), w["bottom"].cast("double").alias("bottom"), w["text"].alias("text")))
    page = page.withColumn("ws", cast)
    lines = F.aggregate("ws", start, step, lambda s: s["out"])
    joined = F.zip_with("ws", lines, lambda w, n: F.struct(*[w[f] for f in fields], n.alias("line_no"))).cast(kind)
    return page.select(*PAGE, F.explode(joined).alias("w")).select(*PAGE, "w.*")


def lines_of_words(words: DataFrame, pages: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """One row a line: its text, joined in (top, x0) order, and its box, normalised by the page."""
    numbered = number_lines(words, tolerance)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "pos", "text"))), lambda w: w["text"]), " ")
    lines = numbered.groupBy(*PAGE, "line_no").agg(text.alias("text"), G.union_of(F.struct(F.col("x0").alias("x1"), F.col("top").alias("y1"), F.col("x1").alias("x2"), F.col("bottom").alias("y2"))).alias("bbox"))
    size = pages.select(*PAGE, "width", "height")
    return lines.join(size, list(PAGE)).select(*PAGE, "line_no", "text", G.normalize(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox"))


def number_paragraphs(lines: DataFrame, gap: float = 0.03) -> DataFrame:
    """A paragraph ends where the next line's top lies more than ``gap`` below the last line's bottom."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    breaks = F.coalesce((F.col("bbox.y1") - F.lag("bbox.y2").over(order) > gap).cast("int"), F.lit(0))
    return lines.withColumn("__break", breaks).withColumn("paragraph", 1 + F.sum("__break").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def paragraphs(lines: DataFrame, gap: float = 0.03) -> DataFrame:
    """Lines joined into paragraph blocks ``p{page}_b{n}``."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    grouped = number_paragraphs(lines, gap).groupBy(*PAGE, "paragraph").agg(text.alias("text"), G.union_of(F.col("bbox")).alias("bbox"))
    return grouped.select(*PAGE, F.format_string("p%d_b%d", F.col("page").cast("int"), F.col("paragraph").cast("int")).alias("block_id"), F.lit("paragraph").alias("type"), "text", "bbox", F.col("paragraph").cast("long").alias("pos"))


def remove_overlapping(texts: DataFrame, tables: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Text blocks of which no single table of the page covers more than the threshold.

    Page keys keep this a hash join; the overlap is its residual condition. Blocks
    without area stay.
    """
    corners = ("x1", "y1", "x2", "y2")
    # Plain columns: a join condition on struct fields defeats the pruning of nested columns.
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in PAGE], *[F.col(f"bbox.{c}").alias(f"t_{c}") for c in corners])
    x = texts.withColumns({f"__{c}": F.col(f"bbox.{c}") for c in corners})
    a, b = ({c: F.col(p + c) for c in corners} for p in ("__", "t_"))
    size = G.area(a)
    hit = (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page") == F.col("t_page")) & (size > 0) & (G.overlap(a, b) > threshold * size)
    return x.join(t, hit, "left_anti").drop(*[f"__{c}" for c in corners])


def outside_tables(blocks: DataFrame, is_table: Column, threshold: float = 0.5) -> DataFrame:
    """``remove_overlapping`` for text blocks and tables in one frame: it is read once, and the tables stay in it.

    A page's tables travel to its blocks by a window, so there is no join.
    """
    is_table = F.coalesce(is_table, F.lit(False))
    tables = F.collect_list(F.when(is_table, F.col("bbox"))).over(Window.partitionBy(*PAGE))
    size = G.area(F.col("bbox"))
    hit = F.exists("__tables", lambda t: G.overlap(F.col("bbox"), t) > threshold * size)
    keys = F.col("doc_id").isNotNull() & F.col("page").isNotNull()  # null keys match nothing in the join
    covered = F.coalesce(~is_table & keys & (size > 0) & hit, F.lit(False))
    return blocks.withColumn("__tables", tables).where(~covered).drop("__tables")


def detect_columns(blocks: DataFrame, min_blocks: int = 4, gap: float = 0.08, min_side: float = 0.2) -> DataFrame:
    """(doc_id, page, boundary) of the pages with two columns.

    The widest gap between neighbouring x-centres, the first among equals, must reach
    ``gap`` and leave ``min_side`` of the blocks on either side.
    """
    page = blocks.groupBy(*PAGE).agg(F.collect_list(_item()).alias("bs"))
    return page.select(*PAGE, boundary_of(F.col("bs"), min_blocks, gap, min_side).alias("boundary")).where(F.col("boundary").isNotNull())


def _item(*row: str) -> Column:
    """What the folds need of a block, flat, and the columns that travel with it; items sort from the top."""
    x1, x2 = F.col("bbox.x1"), F.col("bbox.x2")
    return F.struct(F.col("bbox.y1").alias("y1"), F.col("pos").cast("long").alias("pos"), F.col("bbox.y2").alias("y2"), x1.alias("x1"), ((x1 + x2) / 2).alias("centre"), (x2 - x1).alias("width"), *([F.struct(*row).alias("row")] if row else []))


def boundary_of(items: Column, min_blocks: int = 4, gap: float = 0.08, min_side: float = 0.2) -> Column:
    """The boundary between the columns of a page, given as an array of items; null if there is one column."""
    n = F.size(items)
    centres = F.sort_array(F.transform(items, lambda b: b["centre"]))

    def widest(xs: Column) -> Column:
        return bind(F.zip_with(F.slice(xs, 2, n - 1), F.slice(xs, 1, n - 1), lambda x, before: x - before), lambda gaps: bind(F.array_max(gaps), lambda g: F.when(g >= gap, middle(xs, F.array_position(gaps, g).cast("int")))))

    def middle(xs: Column, left: Column) -> Column:
        return F.when(F.least(left, n - left) / n >= min_side, (F.element_at(xs, left) + F.element_at(xs, left + 1)) / 2)

    return F.when(n >= min_blocks, bind(centres, widest))


def bands_of(items: Column, tolerance: float, share: float, finish=lambda s: s["out"]) -> Column:
    """The band of each item of an array that is sorted from the top."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("top"), none.alias("bottom"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        shared = F.greatest(F.lit(0.0), F.least(s["bottom"], b["y2"]) - F.greatest(s["top"], b["y1"]))
        least = F.least(F.greatest(b["y2"] - b["y1"], F.lit(0.001)), F.greatest(s["bottom"] - s["top"], F.lit(0.001)))
        below = b["y1"] - s["bottom"]
        same = s["top"].isNotNull() & ((shared / least >= share) | ((below >= 0) & (below < tolerance)))
        joins = F.struct(s["top"].alias("top"), F.greatest(s["bottom"], b["y2"]).alias("bottom"), s["band"].alias("band"), F.array_append(s["out"], s["band"]).alias("out"))
        opens = F.struct(b["y1"].alias("top"), b["y2"].alias("bottom"), (s["band"] + 1).alias("band"), F.array_append(s["out"], s["band"] + 1).alias("out"))
        return F.when(same, joins).otherwise(opens)

    return F.aggregate(items, start, step, finish)


def number_bands(blocks: DataFrame, tolerance: float = 0.008, share: float = 0.3) -> DataFrame:
    """Give each block its horizontal band on the page.

    From the top: a block joins the band when they overlap by ``share`` of the lower one
    of both heights, or it follows within the tolerance. A band's top is its first
    block's; its bottom grows.
    """
    # The whole block travels with its key, so it needn't be joined again.
    page = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(_item(*[c for c in blocks.columns if c not in PAGE]))).alias("bs"))
    placed = page.select(*PAGE, F.explode(F.zip_with("bs", bands_of(F.col("bs"), tolerance, share), lambda b, n: F.struct(b["row"].alias("row"), n.alias("band")))).alias("b"))
    return placed.select(*PAGE, "b.row.*", "b.band")


def reading_order(blocks: DataFrame, order: str = "top-to-bottom", tolerance: float = 0.008, wide: float = 0.60) -> DataFrame:
    """Add ``reading_pos``, 1-based on each page.

    'left-to-right' sorts by (x1, y1); an unknown order keeps the input's. Top to bottom
    reads bands; on two-column pages the left column, then the right one, and a block of
    at least ``wide`` page widths comes before the first column block that does not lie
    above it.
    """
    page = Window.partitionBy(*PAGE)
    if order == "left-to-right":
        return blocks.withColumn("reading_pos", F.row_number().over(page.orderBy("bbox.x1", "bbox.y1", "pos")))
    if order != "top-to-bottom":
        return blocks.withColumn("reading_pos", F.row_number().over(page.orderBy("pos")))
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(_item(*[c for c in blocks.columns if c not in PAGE]))).alias("bs"))
    # A column of its own, since lambdas would compute it for every block.
    sided = pages.withColumn("boundary", boundary_of(F.col("bs")))
    found = sided.select(*PAGE, F.posexplode(in_reading_order(F.col("bs"), F.col("boundary"), tolerance, wide)).alias("__n", "b"))
    return found.select(*PAGE, "b.row.*", (F.col("__n") + 1).alias("reading_pos"))


def in_reading_order(items: Column, boundary: Column, tolerance: float, wide: float) -> Column:
    """The items of a page, a column sorted from the top, in reading order."""
    is_wide = lambda b: F.coalesce(b["width"] >= wide, F.lit(False))
    is_left = lambda b: F.coalesce(b["centre"] < boundary, F.lit(False))

    def by_band(column: Column) -> Column:
        # Null where each band is of one block: such a column is in order already.
        bands = bands_of(column, tolerance, 0.3, lambda s: F.when(s["band"] < F.size(s["out"]), s["out"]))
        keys = F.sort_array(F.zip_with(column, bands, lambda b, n: F.struct(n.alias("band"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["pos"].alias("pos"), b.alias("b"))))
        return F.coalesce(F.transform(keys, lambda k: k["b"]), column)

    def with_wide(columns: Column) -> Column:
        # The lowest top so far only sinks along the columns, and a wide block comes before the
        # first row where it reaches the block's own top: one sort merges both.
        start = F.struct(F.lit(None).cast("double").alias("low"), F.array().cast("array<double>").alias("out"))
        lows = F.aggregate(columns, start, lambda s, b: F.struct(F.greatest(s["low"], b["y1"]).alias("low"), F.array_append(s["out"], F.greatest(s["low"], b["y1"])).alias("out")), lambda s: s["out"])
        rows = bind(lows, lambda at: F.transform(columns, lambda b, k: F.struct(F.get(at, k).alias("at"), F.lit(1).alias("column"), k.alias("k"), b.alias("b"))))
        last = F.lit(float("nan"))  # above all numbers
        waiting = F.transform(F.filter(items, is_wide), lambda b, k: F.struct(F.coalesce(b["y1"], last).alias("at"), F.lit(0).alias("column"), k.alias("k"), b.alias("b")))
        return F.transform(F.sort_array(F.concat(rows, waiting)), lambda m: m["b"])

    columns = F.concat(bind(F.filter(items, lambda b: ~is_wide(b) & is_left(b)), by_band), bind(F.filter(items, lambda b: ~is_wide(b) & ~is_left(b)), by_band))
    return F.when(boundary.isNull(), by_band(items)).when(F.exists(items, is_wide), bind(columns, with_wide)).otherwise(columns)


def merge_nearby_boxes(boxes: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Grow a box by the next one in (y1, x1) order that starts within the threshold of its right end."""
    item = F.struct(*[F.col(f"bbox.{c}").alias(c) for c in ("y1", "x1", "x2", "y2")])
    page = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("bs"))
    start = F.array().cast("array<struct<y1:double,x1:double,x2:double,y2:double>>")

    def step(out: Column, b: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        dx = b["x1"] - last["x2"]
        joins = last.isNotNull() & (F.abs(b["y1"] - last["y1"]) < threshold) & (dx >= 0) & (dx < threshold)
        grown = F.struct(F.least(last["y1"], b["y1"]).alias("y1"), F.least(last["x1"], b["x1"]).alias("x1"), F.greatest(last["x2"], b["x2"]).alias("x2"), F.greatest(last["y2"], b["y2"]).alias("y2"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(b)))

    merged = page.select(*PAGE, F.posexplode(F.aggregate("bs", start, step)).alias("n", "b"))
    return merged.select(*PAGE, (F.col("n") + 1).alias("n"), G.box(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2")).alias("bbox"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, first_page, last_page, n_pages): runs of consecutive pages, as gaps and islands."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.select("doc_id", "page").distinct().withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n_pages")).drop("island")


def sort_page(pdf: pd.DataFrame) -> pd.DataFrame:
    """Plain-Python reading order of one page, the check for ``reading_order`` in tests."""
    blocks = pdf.sort_values("pos").to_dict("records")
    if len(blocks) > 1:
        blocks = _sorted(blocks)
    return pd.DataFrame({"pos": [b["pos"] for b in blocks], "reading_pos": range(1, len(blocks) + 1)})


def _bands(blocks: list[dict]) -> list[dict]:
    out, band = [], []
    top = bottom = None
    for b in sorted(blocks, key=lambda b: b["y1"]):
        if band:
            shared = max(0.0, min(bottom, b["y2"]) - max(top, b["y1"]))
            least = min(max(b["y2"] - b["y1"], 0.001), max(bottom - top, 0.001))
            if shared / least >= 0.3 or 0 <= b["y1"] - bottom < 0.008:
                band.append(b)
                bottom = max(bottom, b["y2"])
                continue
            out += sorted(band, key=lambda b: b["x1"])
        band, top, bottom = [b], b["y1"], b["y2"]
    return out + sorted(band, key=lambda b: b["x1"])


def _sorted(blocks: list[dict]) -> list[dict]:
    xs = sorted((b["x1"] + b["x2"]) / 2 for b in blocks)
    gap, k = max(((xs[i] - xs[i - 1], -i) for i in range(1, len(xs))), default=(0.0, 0))
    k = -k
    if len(xs) < 4 or gap < 0.08 or min(k, len(xs) - k) / len(xs) < 0.2:
        return _bands(blocks)
    edge = (xs[k - 1] + xs[k]) / 2
    wide = sorted((b for b in blocks if b["x2"] - b["x1"] >= 0.60), key=lambda b: b["y1"])
    narrow = [b for b in blocks if b["x2"] - b["x1"] < 0.60]
    columns = _bands([b for b in narrow if (b["x1"] + b["x2"]) / 2 < edge]) + _bands([b for b in narrow if (b["x1"] + b["x2"]) / 2 >= edge])
    out = []
    for b in columns:
        while wide and wide[0]["y1"] <= b["y1"]:
            out.append(wide.pop(0))
        out.append(b)
    return out + wide

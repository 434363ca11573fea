"""The invisible text layer of a searchable PDF, as rows of placed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, strip

MIN_FONT, MAX_FONT, FROM_HEIGHT = 4.0, 72.0, 0.8

#: Advance widths of the standard sans face in thousandths of its size, grouped by width.
_WIDTHS = {191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 469: "^", 500: "Jckrsvxyz", 556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@", 389: "*"}
WIDTH_OF = {c: w for w, cs in _WIDTHS.items() for c in cs} | {"r": 333}


def _thousandths(text: Column) -> Column:
    """Width of a text at size 1000. Widths stand in an array at their characters' codes."""
    widths = F.array(*[F.lit(WIDTH_OF.get(chr(c), 556)) for c in range(128)])
    one = lambda c: F.when(F.ascii(c) < 128, F.get(widths, F.ascii(c))).otherwise(F.lit(556))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda n, c: n + one(c))


def natural_width(text: Column, size: Column) -> Column:
    """Width of a text at a font size; characters out of the table count 556."""
    return _thousandths(text) * size / 1000.0


def overlay_lines(blocks: DataFrame) -> DataFrame:
    """Lines to draw for each block: (doc_id, page, block_id, n, text, bbox as array).

    Rows make table lines with cells joined by ' | '; lines with four-number boxes are
    taken as they are; else the text's non-blank lines share the block's height.
    """
    cells = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.array_join(F.filter(r, lambda c: c.isNotNull() & (c != "")), " | "))
    filled = lambda a: F.filter(a, lambda s: strip(s) != "")
    has_rows = (F.col("type") == "table") & (F.size(F.coalesce("rows", F.array().cast("array<array<string>>"))) > 0)
    has_text = F.col("text").isNotNull() & (F.col("text") != "")
    own = has_text & (F.size(F.coalesce("lines", F.array().cast("array<struct<text:string,bbox:array<double>>>"))) > 0)
    shared = F.when(has_rows, filled(cells)).when(has_text, filled(F.split("text", "\n"))).otherwise(F.array().cast("array<string>"))
    b = lambda k: F.element_at("bbox", k)
    height = b(4) - b(2)
    # With many lines a share of the height each, in reading order.
    # The lines are bound: inside the lambda they would be split again for each line.
    spread = bind(shared, lambda ls: F.transform(ls, lambda t, i: F.struct(t.alias("text"), F.array(b(1), b(2) + i * height / F.size(ls), b(3), b(2) + (i + 1) * height / F.size(ls)).alias("bbox"))))
    given = F.filter("lines", lambda x: x["text"].isNotNull() & (x["text"] != "") & (F.size(x["bbox"]) == 4))
    whole = (F.size("bbox") == 4)
    lines = F.when(~has_rows & own, given).when(whole, spread).otherwise(F.array().cast("array<struct<text:string,bbox:array<double>>>"))
    return blocks.select("doc_id", "page", "block_id", F.posexplode(lines).alias("n", "line")).select("doc_id", "page", "block_id", "n", "line.text", "line.bbox")


def place_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Font size, horizontal scale and position in points, from the bottom left, of each line."""
    b = lambda k: F.element_at("bbox", k)
    joined = lines.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    wide, tall = (b(3) - b(1)) * F.col("width"), (b(4) - b(2)) * F.col("height")
    font = F.greatest(F.lit(MIN_FONT), F.least(tall * FROM_HEIGHT, F.lit(MAX_FONT)))
    natural = natural_width(F.col("text"), F.col("font_size"))
    drawn = joined.withColumn("__w", wide).withColumn("__h", tall).where((strip(F.col("text")) != "") & (F.col("__w") > 0) & (F.col("__h") > 0)).withColumn("font_size", font.cast("double"))
    scale = F.when(natural > 0, F.col("__w") / natural * 100.0).otherwise(F.lit(100.0))
    return drawn.select("doc_id", "page", "block_id", "n", "text", "font_size", scale.alias("horizontal_scale"), (b(1) * F.col("width")).alias("x"), (F.col("height") - b(4) * F.col("height") + (F.col("__h") - F.col("font_size")) * 0.5).alias("y"))


def fitting_font(text: Column, width: Column, largest: float = 16.0, smallest: float = 4.0) -> Column:
    """The first of a falling ladder of sizes at which the text fits; the smallest if none does."""
    ladder = F.array(*[F.lit(float(s)) for s in (largest, 14, 12, 10, 8, 6, smallest)])
    # The width is summed once, not for each size.
    first = bind(_thousandths(text), lambda n: F.get(F.filter(ladder, lambda s: n * s / 1000.0 <= width), F.lit(0)))
    usable = text.isNotNull() & (text != "") & (width > 0)
    return F.coalesce(F.when(usable, first), F.lit(smallest))

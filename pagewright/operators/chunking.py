"""Documents to retrieval chunks.

The splitting folds run as array expressions inside the JVM; one document's blocks never
leave their row, so chunking adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, LINE_BREAK, bind, strip, strip_leading_hash

MIN_CHARS, MAX_CHARS, MAX_ROWS = 50, 1200, 40

_STRINGS = "array<string>"
BOILERPLATE = (
    "certid(?:a|ã)o de (?:remessa|publica(?:c|ç)(?:a|ã)o) de rela(?:c|ç)(?:a|ã)o",
    "c(?:o|ó)digo da certid(?:a|ã)o",
    "para conferir o original, acesse o site",
    "este documento (?:e|é) c(?:o|ó)pia do original",
    "assinad(?:a|o) digitalmente",
    "odanissa etnemlatigid",
    "otnemucod o rirefnoc",
)
CERTIFICATE_URL = "https?:/{2}comunicaapi[.]pje[.]jus[.]br/.*/certidao"


def split_segment(segment: Column, limit: int = MAX_CHARS) -> Column:
    """Struct (pieces, rest): full pieces cut off a long trimmed line, each at the last blank of its second half.

    One pattern cuts all pieces, each from where the last one ended, so a line is read once
    and not once for each of its pieces.
    """
    full = rf"(?sU)\G(?=.{{{limit + 1}}})(.{{{limit // 2},{limit - 1}}}(?= )|.{{{limit}}}){BLANK}*"
    cut = F.length(segment) > limit
    pieces = F.filter(F.transform(F.regexp_extract_all(segment, F.lit(full), F.lit(1)), strip), lambda p: p != "")
    return F.struct(F.when(cut, pieces).otherwise(F.array().cast(_STRINGS)).alias("pieces"), F.when(cut, F.regexp_replace(segment, full, "")).otherwise(segment).alias("rest"))


def split_text(text: Column, limit: int = MAX_CHARS) -> Column:
    """Array of chunks of at most ``limit`` characters; lines are packed, long lines are cut."""
    lines = F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), LINE_BREAK), strip), lambda s: s != "")
    unit = lambda t, whole: F.struct(t.alias("t"), whole.alias("whole"), (F.length(t) + 1).alias("size"))

    def units(cut: Column) -> Column:
        return F.concat(F.transform(cut["pieces"], lambda p: unit(p, F.lit(True))), F.array(unit(cut["rest"], F.lit(False))))

    every = F.flatten(F.transform(F.transform(lines, lambda x: split_segment(x, limit)), units))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(_STRINGS).alias("out"), none.alias("held"), F.lit(0).alias("n"))
    state = lambda out, held, n: F.struct(out.alias("out"), held.alias("held"), n.alias("n"))

    def step(s: Column, u: Column) -> Column:
        flush = s["held"].isNotNull() & (u["whole"] | (s["n"] + u["size"] > limit))
        flushed = F.when(flush, state(F.concat(s["out"], F.array(s["held"])), none, F.lit(0))).otherwise(s)
        joined = lambda s: F.when(s["held"].isNull(), u["t"]).otherwise(F.concat(s["held"], F.lit("\n"), u["t"]))
        added = lambda s: F.when(u["whole"], state(F.concat(s["out"], F.array(u["t"])), s["held"], s["n"])).when(u["t"] == "", s).otherwise(state(s["out"], joined(s), s["n"] + u["size"]))
        return bind(flushed, added)

    return F.aggregate(every, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def split_rows(rows: Column, limit: int = MAX_CHARS, most: int = MAX_ROWS) -> Column:
    """Array of chunks of a table's rows: cells joined by blanks, at most ``most`` rows a chunk."""
    cells = lambda r: F.filter(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    lines = F.filter(F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.array_join(cells(r), " ")), lambda s: s != "")
    start = F.struct(F.array().cast(_STRINGS).alias("out"), F.array().cast(_STRINGS).alias("held"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        size = F.length(line) + 1
        flush = (F.size(s["held"]) > 0) & ((F.size(s["held"]) >= most) | (s["n"] + size > limit))
        out = F.when(flush, F.concat(s["out"], F.array(F.array_join(s["held"], "\n")))).otherwise(s["out"])
        held = F.when(flush, F.array(line)).otherwise(F.concat(s["held"], F.array(line)))
        return F.struct(out.alias("out"), held.alias("held"), F.when(flush, size).otherwise(s["n"] + size).alias("n"))

    return F.aggregate(lines, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(F.array_join(s["held"], "\n")))).otherwise(s["out"]))


def is_low_value(text: Column) -> Column:
    """Boilerplate: a reversed marker, two patterns, a short certificate link, a short folio line."""
    low = F.lower(text)
    hits = sum((text.rlike("(?iu)" + p).cast("int") for p in BOILERPLATE), F.lit(0))
    return low.contains(BOILERPLATE[-1]) | (hits >= 2) | (text.rlike("(?iu)" + CERTIFICATE_URL) & (F.length(text) < 600)) | (low.startswith("fls. ") & (F.length(text) < 120))


def chunk_blocks(blocks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Blocks (document_id, source_file, page_number, block_id, block_type, text, rows, confidence) to chunks.

    Text wins over rows. Part numbers count candidates before short and boilerplate ones
    go, so they may leave gaps; a single candidate has no part number.
    """
    text = strip(F.coalesce("text", F.lit("")))
    parts = F.when(text != "", split_text(text)).otherwise(F.flatten(F.transform(split_rows(F.col("rows")), lambda t: split_text(t))))
    # Texts are cleaned before they are rows, else each test below would clean them again; a row carries its part only.
    # The array stands in the generator itself: of a column, Spark infers filters and computes it once for each.
    cleaned = bind(parts, lambda ps: F.transform(ps, lambda raw: F.struct((F.size(ps) > 1).alias("several"), strip_leading_hash(strip(raw)).alias("text"))))
    keys = ("document_id", "source_file", "page_number", "block_id", "block_type", "confidence")
    several = blocks.select(*keys, F.posexplode(cleaned).alias("__k", "__part")).select(*keys, "__k", F.col("__part.several").alias("__several"), F.col("__part.text").alias("__text"))
    suffix = F.when(F.col("__several"), F.concat(F.lit(":part"), (F.col("__k") + 1).cast("string"))).otherwise(F.lit(""))
    clean = several.where((F.length("__text") >= min_chars) & ~is_low_value(F.col("__text")))
    name = F.concat(F.col("block_id"), suffix)
    return clean.select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("page_number").cast("string"), name).alias("chunk_id"), "document_id", "source_file", "page_number", name.alias("block_id"), "block_type", F.col("__text").alias("text"), "confidence")


def document_blocks(documents: DataFrame) -> DataFrame:
    """Unnest documents into the block rows that ``chunk_blocks`` takes; the tree's order is ``pos``."""
    pages = documents.select(F.col("doc_id").alias("document_id"), "source_file", F.posexplode("pages").alias("__p", "p"))
    blocks = pages.select("document_id", "source_file", "__p", F.col("p.page").alias("page_number"), F.posexplode("p.blocks").alias("__b", "b"))
    return blocks.select("document_id", "source_file", "page_number", "b.block_id", F.col("b.type").alias("block_type"), "b.text", "b.rows", "b.confidence", F.struct("__p", "__b").alias("pos"))

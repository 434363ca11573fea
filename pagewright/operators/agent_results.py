"""Tool-call markup and tool results of the agent, as Columns and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL, FUNCTION, PARAMETER = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<function=([^>]+)>(.*?)</function>", r"(?s)<parameter=([^>]+)>(.*?)</parameter>"


def parse_tool_calls(text: Column) -> Column:
    """Array of (name, arguments as JSON) from textual markup.

    A block counts by its first function; of parameters that repeat, the last wins. Needs
    ``spark.sql.mapKeyDedupPolicy`` only for other maps: duplicates are removed here.
    """
    from ..functions.text import strip

    def call(block: Column) -> Column:
        name = strip(F.regexp_extract(block, FUNCTION, 1))
        body = F.regexp_extract(block, FUNCTION, 2)
        keys = F.transform(F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(1)), strip)
        values = F.transform(F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(2)), strip)
        entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        last = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), (F.size(F.filter(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == e["key"])) == 0).alias("last"))), lambda e: e["last"])
        return F.struct(name.alias("name"), F.to_json(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))).alias("arguments"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), call), lambda c: c["name"] != "")


SOURCE = "document_id string, id string, chunk_id string, filename string, page int, text string"


def sources(results: DataFrame) -> DataFrame:
    """Distinct sources of tool results (result_no, content): JSON lines with a document and a place.

    The first mention of document, chunk and page wins. A line that truncation cut doesn't
    parse and gives no source.
    """
    lines = results.select("result_no", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where(F.ltrim("line").startswith("{"))
    parsed = lines.withColumn("j", F.from_json("line", SOURCE)).select("result_no", "line_no", "j.*")
    chunk = F.coalesce(F.nullif("chunk_id", F.lit("")), F.nullif("id", F.lit("")))
    usable = parsed.withColumn("chunk_id", chunk).where((F.coalesce("document_id", F.lit("")) != "") & (F.col("chunk_id").isNotNull() | F.col("page").isNotNull() | (F.coalesce("text", F.lit("")) != "")))
    first = F.row_number().over(Window.partitionBy("document_id", F.coalesce("chunk_id", F.lit("")), F.coalesce("page", F.lit(-1))).orderBy("result_no", "line_no"))
    return usable.withColumn("__n", first).where("__n = 1").select("result_no", "line_no", "document_id", "filename", "chunk_id", "page", "text")

"""Registered queries: text functions and chunking over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as T
from ..operators import agent_results, chunking, ocr_parse
from .registry import query, table

WS = r"[\s\x0b\x1c-\x1f]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rep(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{new}', 'g')"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def tidy(x: str) -> str:
    joined = f"array_to_string(list_transform({lines(x)}, lambda l: {strip('l')}), chr(10))"
    return strip(f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


NORMAL = tidy(rep(rep("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", ""), " +", " "))


@query(f"SELECT doc_id, {NORMAL} AS result FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("result"))


@query(f"SELECT doc_id, {tidy('replace(text, chr(10), chr(10) || chr(10) || chr(10))')} AS result FROM documents")
def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_whitespace(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))).alias("result"))


W = r"[\p{L}\p{N}_]"


@query("SELECT doc_id, " + rep("replace(text, '. ', '-' || chr(10) || ' ')", rf"({W}+)-\s*\n\s*({W}+)", r"\1\2") + " AS result FROM documents")
def hyphen_merge(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.merge_hyphenated_words(F.replace("text", F.lit(". "), F.lit("-\n "))).alias("result"))


@query("SELECT doc_id, " + rep(rep(rep("replace(replace(text, ', ', ' • '), '. ', ' ..... ')", r"\s[•·∙■□▪▫]\s", " "), r"\s+([.,;:!?])", r"\1"), r"\.{3,}", "...") + " AS result FROM documents")
def clean_artifacts(spark, sf_dir):
    noisy = F.replace(F.replace("text", F.lit(", "), F.lit(" • ")), F.lit(". "), F.lit(" ..... "))
    return _docs(spark, sf_dir).select("doc_id", T.clean_artifacts(noisy).alias("result"))


SPLIT = "list_filter(list_transform(string_split(" + "regexp_replace(text, '([.!?])\\s+([A-ZÀ-Ú])', '\\1' || chr(1) || '\\2', 'g')" + f", chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({SPLIT}) AS INTEGER) AS n, array_to_string({SPLIT}, '|') AS result FROM documents")
def sentences(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.array_join(s, "|").alias("result"))


_NOISE = "[|{}<>©®™°§¶†‡•◦▪▫●○◆◇★☆♦♠♣♥\\[\\]\\\\]"


def ocr_clean(x: str) -> str:
    x = rep(x, _NOISE, "")
    x = rep(x, r"={4,}|-{4,}|_{4,}|\*{4,}|#{4,}|~{4,}", "")
    x = rep(x, r"\s+([.,;:!?)])", r"\1")
    x = rep(x, "([!,.:;?])([a-zà-úA-ZÀ-Ú])", r"\1 \2")
    x = rep(x, r"[ \t]+", " ")
    kept = f"list_filter(list_transform({lines(x)}, lambda l: {strip('l')}), lambda l: len(regexp_extract_all(l, '[A-Za-zÀ-ú]')) >= 2)"
    return strip(f"array_to_string({kept}, chr(10))")


NOISY_SQL = "replace(replace(text, ', ', ' ,|<©'), '. ', chr(10) || '==== 12 ----' || chr(10) || '.')"


def _noisy():
    return F.replace(F.replace("text", F.lit(", "), F.lit(" ,|<©")), F.lit(". "), F.lit("\n==== 12 ----\n."))


@query(f"SELECT doc_id, {ocr_clean(NOISY_SQL)} AS result FROM documents")
def clean_ocr_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_ocr_text(_noisy()).alias("result"))


def twice(x: str, pattern: str, new: str) -> str:
    return rep(rep(x, pattern, new), pattern, new)


def ocr_fix(x: str) -> str:
    x = f"replace({x}, 'l<', 'k')"
    for a, b, new in (("[a-z]", "O", "o"), ("[A-Z]", "o", "O"), ("[A-Za-z]", "0", "O"), ("[0-9]", "O", "0"), ("[A-Za-z]", "1", "l"), ("[0-9]", "l", "1")):
        x = twice(x, f"({a}){b}({a})", rf"\1{new}\2")
    for word, new in (("NQ", "Nº"), ("n2", "nº")):
        x = twice(x, rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])", rf"\1{new}\2")
    return x


DAMAGED_SQL = "replace(replace(replace(text, 'the', 'tOe'), ' in ', ' NQ n2 '), 'er', 'l<')"


def _damaged():
    return F.replace(F.replace(F.replace("text", F.lit("the"), F.lit("tOe")), F.lit(" in "), F.lit(" NQ n2 ")), F.lit("er"), F.lit("l<"))


@query(f"SELECT doc_id, {ocr_fix(DAMAGED_SQL)} AS result FROM documents")
def fix_ocr_errors(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fix_ocr_errors(_damaged()).alias("result"))


def upper_sql(w: str) -> str:
    return f"(upper({w}) = {w} AND lower({w}) <> {w})"


_WORDS = f"list_filter(regexp_split_to_array(l, '{WS}+'), lambda w: w <> '')"
_MERGE = f"""list_reduce(list_transform({_WORDS}, lambda w: {{'o': []::VARCHAR[], 'h': w}}), lambda s, u: CASE
 WHEN s.h IS NULL THEN {{'o': s.o, 'h': u.h}}
 WHEN length(s.h) <= 2 AND length(u.h) >= 2 AND {upper_sql('s.h')} = {upper_sql('u.h')} THEN {{'o': list_append(s.o, s.h || u.h), 'h': NULL::VARCHAR}}
 ELSE {{'o': list_append(s.o, s.h), 'h': u.h}} END, {{'o': []::VARCHAR[], 'h': NULL::VARCHAR}})"""


@query(f"""WITH ls AS (SELECT doc_id, unnest({lines('text')}) AS l, generate_subscripts({lines('text')}, 1) AS k FROM documents),
m AS (SELECT doc_id, k, l, len({_WORDS}) AS n, {_MERGE} AS s FROM ls)
SELECT doc_id, string_agg(CASE WHEN n < 2 THEN l ELSE array_to_string(CASE WHEN s.h IS NULL THEN s.o ELSE list_append(s.o, s.h) END, ' ') END, chr(10) ORDER BY k) AS result FROM m GROUP BY doc_id""")
def merge_broken_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.merge_broken_words(F.col("text")).alias("result"))


def short_lines(x: str, n: int) -> str:
    return f"array_to_string(list_filter({lines(x)}, lambda l: length({strip('l')}) >= {n}), chr(10))"


@query(f"SELECT doc_id, {short_lines('text', 40)} AS result FROM documents")
def remove_short_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.remove_short_lines(F.col("text"), 40).alias("result"))


@query(f"SELECT doc_id, {tidy(short_lines(ocr_fix(ocr_clean(NOISY_SQL)), 3))} AS result FROM documents")
def postprocess_ocr(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.postprocess_ocr(_noisy()).alias("result"))


_MIXED_SQL = f"CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 7 = 3 THEN '|' ELSE {NOISY_SQL} END"


@query(f"SELECT doc_id, CASE WHEN t = '' THEN t ELSE c END AS text FROM (SELECT doc_id, t, {tidy(short_lines(ocr_fix(ocr_clean('t')), 3))} AS c FROM (SELECT doc_id, {_MIXED_SQL} AS t FROM documents)) WHERE t = '' OR length(c) >= 2")
def postprocess_blocks(spark, sf_dir):
    """Blocks without text pass, blocks whose text comes to nothing go."""
    mixed = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 7 == 3, "|").otherwise(_noisy())
    return ocr_parse.postprocess_blocks(_docs(spark, sf_dir).select("doc_id", mixed.alias("text")))


@query(f"""WITH d AS (SELECT doc_id, list_transform({lines('text')}, lambda l: {strip('l')}) AS t, {lines('text')} AS ls FROM documents),
o AS (SELECT doc_id, ls, list_filter(list_distinct(list_concat(t[1:5], t[greatest(len(t) - 4, 1):len(t)])), lambda m: m <> '' AND len(list_filter(t, lambda x: x = m)) >= 3) AS often FROM d)
SELECT doc_id, CASE WHEN len(ls) < 6 THEN array_to_string(ls, chr(10)) ELSE array_to_string(list_filter(ls, lambda l: NOT list_contains(often, {strip('l')})), chr(10)) END AS result FROM o""")
def repeated_headers(spark, sf_dir):
    kept = T.repeated_margin_lines(F.split("text", "\n", -1))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(kept, "\n").alias("result"))


@query("SELECT doc_id, " + rep("'.dBmu9HEi ' || text", r"^\.[A-Za-z0-9]{6,12}\s+", "") + " AS result FROM documents")
def leading_noise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_leading_hash(F.concat(F.lit(".dBmu9HEi "), "text")).alias("result"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [truncado]' ELSE text END AS cut, substr(text, 1, 6000) AS embedded FROM documents")
def truncate_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 200).alias("cut"), T.embedding_input(F.col("text")).alias("embedded"))


_TOK = "list_sort(list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]{4,}')))"


@query(f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens, array_to_string(list_sort(list_distinct(list_transform({_TOK}, lambda t: t[1:4]))), ' ') AS prefixes FROM documents")
def keyword_tokens(spark, sf_dir):
    t = K.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(t), " ").alias("tokens"), F.array_join(F.array_sort(K.prefixes(t)), " ").alias("prefixes"))


BOILER = ("certid[aã]o de (?:publica[cç][aã]o|remessa) de rela[cç][aã]o", "c[oó]digo da certid[aã]o", "para conferir o original, acesse o site", "este documento [eé] c[oó]pia do original", "assinad[ao] digitalmente", "odanissa etnemlatigid", "otnemucod o rirefnoc")
_HITS = " + ".join(f"CAST(regexp_matches(t, '(?i){p}') AS INTEGER)" for p in BOILER)
STAMPED_SQL = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN 'Código da CERTIDÃO assinado digitalmente ' || text WHEN 2 THEN 'https://comunicaapi.pje.jus.br/api/v1/certidao ' || text WHEN 3 THEN 'fls. 24 ' || text ELSE 'Otnemucod o rirefnoc ' || text END"


@query(f"SELECT doc_id, contains(lower(t), 'otnemucod o rirefnoc') OR ({_HITS}) >= 2 OR (regexp_matches(t, '(?i)https?://comunicaapi\\.pje\\.jus\\.br/.*/certidao') AND length(t) < 600) OR (starts_with(lower(t), 'fls. ') AND length(t) < 120) AS low_value FROM (SELECT doc_id, {STAMPED_SQL} AS t FROM documents)")
def low_value_chunks(spark, sf_dir):
    t = F.expr(STAMPED_SQL)
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", chunking.is_low_value(F.col("t")).alias("low_value"))


CHUNK_UNITS = f"""
seg AS (SELECT doc_id, k, {strip('l')} AS s FROM (SELECT doc_id, unnest({lines('text')}) AS l, generate_subscripts({lines('text')}, 1) AS k FROM src)),
cut AS (SELECT doc_id, k, 0 AS j, NULL::VARCHAR AS piece, s AS rest FROM seg WHERE s <> ''
  UNION ALL
  SELECT doc_id, k, j + 1, {strip('substr(rest, 1, edge)')}, {strip('substr(rest, edge + 1)')}
  FROM (SELECT *, CASE WHEN back > 0 AND 1200 - back >= 600 THEN 1200 - back ELSE 1200 END AS edge
        FROM (SELECT *, instr(reverse(substr(rest, 1, 1200)), ' ') AS back FROM cut WHERE length(rest) > 1200))),
unit AS (SELECT doc_id, k, j, piece AS t, true AS whole FROM cut WHERE j > 0 AND piece <> ''
  UNION ALL SELECT doc_id, k, 1000000, arg_max(rest, j), false FROM cut GROUP BY doc_id, k),
per AS (SELECT doc_id, list({{'o': []::VARCHAR[], 'h': t, 'n': 0::BIGINT, 'w': whole}} ORDER BY k, j) AS us FROM unit GROUP BY doc_id),
packed AS (SELECT doc_id, list_reduce(us, lambda s, u: CASE
   WHEN u.w THEN {{'o': list_append(CASE WHEN s.h IS NULL THEN s.o ELSE list_append(s.o, s.h) END, u.h), 'h': NULL::VARCHAR, 'n': 0::BIGINT, 'w': false}}
   WHEN u.h = '' THEN CASE WHEN s.h IS NOT NULL AND s.n + 1 > 1200 THEN {{'o': list_append(s.o, s.h), 'h': NULL::VARCHAR, 'n': 0::BIGINT, 'w': false}} ELSE s END
   WHEN s.h IS NULL THEN {{'o': s.o, 'h': u.h, 'n': length(u.h) + 1, 'w': false}}
   WHEN s.n + length(u.h) + 1 > 1200 THEN {{'o': list_append(s.o, s.h), 'h': u.h, 'n': length(u.h) + 1, 'w': false}}
   ELSE {{'o': s.o, 'h': s.h || chr(10) || u.h, 'n': s.n + length(u.h) + 1, 'w': false}} END,
   {{'o': []::VARCHAR[], 'h': NULL::VARCHAR, 'n': 0::BIGINT, 'w': false}}) AS s FROM per),
parts AS (SELECT doc_id, CASE WHEN s.h IS NULL THEN s.o ELSE list_append(s.o, s.h) END AS ps FROM packed),
flat AS (SELECT doc_id, len(ps) AS total, unnest(ps) AS raw, generate_subscripts(ps, 1) AS k FROM parts),
clean AS (SELECT doc_id, total, k, regexp_replace({strip('raw')}, '^\\.[A-Za-z0-9]{{6,12}}\\s+', '') AS t FROM flat)"""


@query(f"""WITH RECURSIVE src AS (SELECT doc_id, replace(text, '. ', '.' || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE chr(10) END) AS text FROM documents), {CHUNK_UNITS}
SELECT doc_id || ':1:p1_b1' || CASE WHEN total > 1 THEN ':part' || k ELSE '' END AS chunk_id, doc_id AS document_id, t AS text FROM clean
WHERE length(t) >= 50 AND NOT (contains(lower(t), 'otnemucod o rirefnoc') OR (starts_with(lower(t), 'fls. ') AND length(t) < 120))""")
def chunks(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit(". "), F.lit(".\n")))
    blocks = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("d.pdf").alias("source_file"), F.lit(1).alias("page_number"), F.lit("p1_b1").alias("block_id"), F.lit("paragraph").alias("block_type"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(1.0).alias("confidence"))
    return chunking.chunk_blocks(blocks).select("chunk_id", "document_id", "text")


@query("""WITH rows AS (SELECT c_nationkey AS doc, c_custkey AS k, c_name || CASE WHEN c_mktsegment <> '' THEN ' ' || c_mktsegment ELSE '' END AS l FROM customer),
per AS (SELECT doc, list({'o': []::VARCHAR[], 'h': l, 'n': 0::BIGINT, 'c': 0::BIGINT} ORDER BY k) AS us FROM rows GROUP BY doc),
packed AS (SELECT doc, list_reduce(us, lambda s, u: CASE
  WHEN s.c > 0 AND (s.c >= 40 OR s.n + length(u.h) + 1 > 1200) THEN {'o': list_append(s.o, s.h), 'h': u.h, 'n': length(u.h) + 1, 'c': 1::BIGINT}
  WHEN s.c = 0 THEN {'o': s.o, 'h': u.h, 'n': length(u.h) + 1, 'c': 1::BIGINT}
  ELSE {'o': s.o, 'h': s.h || chr(10) || u.h, 'n': s.n + length(u.h) + 1, 'c': s.c + 1} END,
  {'o': []::VARCHAR[], 'h': ''::VARCHAR, 'n': 0::BIGINT, 'c': 0::BIGINT}) AS s FROM per),
parts AS (SELECT doc, CASE WHEN s.c > 0 THEN list_append(s.o, s.h) ELSE s.o END AS ps FROM packed)
SELECT doc, CAST(generate_subscripts(ps, 1) AS INTEGER) AS part, unnest(ps) AS text FROM parts""")
def table_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.array(F.concat(F.lit(" "), "c_name"), "c_mktsegment", F.lit(None)).alias("cells")))).alias("r"))
    parts = chunking.split_rows(F.transform("r", lambda x: x["cells"]))
    return rows.select("doc", F.posexplode(parts).alias("k", "text")).select("doc", (F.col("k") + 1).alias("part"), "text")


_CALLS = "'<tool_call><function=search_chunks><parameter=query>' || text || '</parameter><parameter=n_results>5</parameter></function></tool_call>' || text"


@query(f"SELECT conv_id, turn, 'search_chunks' AS name, trim(regexp_extract({_CALLS}, '(?s)<parameter=query>(.*?)</parameter>', 1)) AS query, {strip(rep(rep(_CALLS, '(?s)<tool_call>.*?</tool_call>', ''), chr(92) + 'n{3,}', chr(10)))} AS answer FROM conversations")
def tool_calls(spark, sf_dir):
    text = F.concat(F.lit("<tool_call><function=search_chunks><parameter=query>"), "text", F.lit("</parameter><parameter=n_results>5</parameter></function></tool_call>"), "text")
    call = F.element_at(agent_results.parse_tool_calls(F.col("m")), 1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("m")).withColumn("c", call)
    return rows.select("conv_id", "turn", "c.name", F.get_json_object("c.arguments", "$.query").alias("query"), T.strip_tool_markup(F.col("m")).alias("answer"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def message_chars(spark, sf_dir):
    size = T.estimated_chars(F.col("text"), F.lit(None).cast("array<struct<name:string,arguments:string>>"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(size).cast("long").alias("chars"))

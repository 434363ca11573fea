import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import keywords as K
from pagewright.functions import text as T


def run(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.r for r in rows.select("k", f(F.col("t")).alias("r")).orderBy("k").collect()]


ODD = "  a  b \t\n\n\n\n x \ny\x07z   end \n"


def test_strip_is_unicode(spark):
    values = ["  a  ", "\x1ca\x1f", "", " \n", "a b", ODD]
    assert run(spark, values, T.strip) == [v.strip() for v in values]


def test_normalize(spark):
    values = ["a   b\n\n\n\n c ", "a\x00b\x0bc", "", "\n\n"]
    assert run(spark, values, T.normalize_text) == ["a b\n\nc", "abc", "", ""]
    assert run(spark, ["a   b"], lambda t: T.normalize_text(t, collapse_blanks=False)) == ["a   b"]


def test_hyphens_and_artifacts(spark):
    assert run(spark, ["exem-\n  plo", "guarda-chuva", "co-\nração é-\nle"], T.merge_hyphenated_words) == ["exemplo", "guarda-chuva", "coração éle"]
    assert run(spark, ["a • b", "x ; y .....", "fim ..  !"], T.clean_artifacts) == ["a b", "x; y...", "fim..!"]


def test_sentences(spark):
    assert run(spark, ["Um. Dois! Três? é. Élan", "", "a.b. C"], T.sentences) == [["Um.", "Dois!", "Três? é.", "Élan"], [], ["a.b.", "C"]]


def test_ocr_cleaning(spark):
    values = ["a|b <c> ====\nx1\n-- 1 --\nfim ,aqui", None, "ok (sim ) !agora"]
    assert run(spark, values, T.clean_ocr_text) == ["ab c\nfim, aqui", "", "ok (sim)! agora"]
    assert run(spark, ["aOb AoB 1O2 3l4 a0b a1b NQ n2 l<", "aOOb"], T.fix_ocr_errors) == ["aob AOB 102 314 aOb alb Nº nº k", "aOOb"]
    assert run(spark, ["a\nabc\n  de \nxyz"], T.remove_short_lines) == ["abc\nxyz"]
    assert run(spark, [None, "", "x\nabc def ,gh\n\n\n\nI0 words"], T.postprocess_ocr) == ["", "", "abc def, gh\nI0 words"]


def python_merge(line):
    words = line.split()
    if len(words) < 2:
        return line
    out, i = [], 0
    while i < len(words):
        if len(words[i]) <= 2 and i + 1 < len(words) and len(words[i + 1]) >= 2 and words[i].isupper() == words[i + 1].isupper():
            out.append(words[i] + words[i + 1])
            i += 2
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def test_broken_words(spark):
    values = ["TA BELIÃO", "de cima a baixo", "A B CD ef 12 34 X9 YZ", "", "so", "  x  ", "a bc\nde fg hi"]
    assert run(spark, values, T.merge_broken_words) == ["\n".join(map(python_merge, v.split("\n"))) for v in values]


@pytest.mark.parametrize("lines,want", [(["H", "a", "H", "b", "H"], ["H", "a", "H", "b", "H"]), (["H", "a", " H", "", "b", "H ", ""], ["a", "", "b", ""]), (["x"] * 2 + ["a", "b", "c", "d"], ["x", "x", "a", "b", "c", "d"])])
def test_margins(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(T.repeated_margin_lines(F.col("l")).alias("r")).first().r == want


def test_middle_lines_are_no_margin(spark):
    lines = [f"l{k}" for k in range(5)] + ["mid"] * 4 + [f"e{k}" for k in range(5)]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(T.repeated_margin_lines(F.col("l")).alias("r")).first().r == lines


def test_small_functions(spark):
    assert run(spark, [".dBmu9HEi CERTO", ".ab x", "x .dBmu9HEi y"], T.strip_leading_hash) == ["CERTO", ".ab x", "x .dBmu9HEi y"]
    assert run(spark, ["abcdef", "abc"], lambda t: T.truncate(t, 3)) == ["abc... [truncado]", "abc"]
    assert run(spark, ["abcdef"], lambda t: T.truncate(t, 0)) == ["abcdef"]
    assert run(spark, ["a<tool_call>x\ny</tool_call>\n\n\n\nb "], T.strip_tool_markup) == ["a\nb"]
    assert run(spark, ["a \n\t b", None], T.cell_text) == ["a b", ""]


def test_keywords(spark):
    values = ["Ação, FIM e dano-moral", "ﬁm de tarde", ""]
    assert [sorted(t) for t in run(spark, values, K.tokens)] == [["acao", "dano", "moral"], ["tarde"], []]
    assert [sorted(t) for t in run(spark, values, lambda t: K.tokens(t, exact=True))] == [["acao", "dano", "moral"], ["tarde"], []]
    assert run(spark, ["ÀÇãÕñ É"], K.fold) == ["acaon e"]


@pytest.mark.parametrize("query,text,want", [("dano moral", "houve dano grave", True), ("dano moral", "nada a ver", False), ("danoso moralista", "danos morais", True), ("danoso", "danos", True), ("danoso moralista", "danos apenas", False), ("a b", "qualquer", True)])
def test_keyword_match(spark, query, text, want):
    df = spark.createDataFrame([(query, text)], "q string, t string")
    assert df.select(K.matches(K.tokens(F.col("q")), K.tokens(F.col("t"))).alias("r")).first().r is want


def test_line_break_class():
    from pagewright.functions.text import LINE_BREAK

    for sign in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
        assert re.fullmatch(LINE_BREAK, sign), repr(sign)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_up_trims_all_blanks_and_reads_long_runs_of_them_once(spark):
    import time

    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert run(spark, [b + "x" + b + "y" + b for b in blanks], T.strip) == ["x" + b + "y" for b in blanks]
    assert "regexp_count" not in _plan(spark.range(1).select(T.postprocess_ocr(F.lit("a").substr(F.lit(1), F.col("id").cast("int")))))
    long, began = "ab" + " " * 150_000 + "cd", time.time()
    assert run(spark, [long], T.clean_ocr_text) == ["ab cd"] and time.time() - began < 10


def test_blocks_are_cleaned_once(spark):
    from pagewright.operators import ocr_parse

    df = spark.range(4).selectExpr("id AS doc_id", "CASE id WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '|' ELSE 'two words' END AS text", "id AS last")
    clean = ocr_parse.postprocess_blocks(df)
    assert _plan(clean).count("[#*") == 1 and clean.columns == df.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {0: None, 1: "", 3: "two words"}


def test_broken_words_of_a_long_line_are_one_replacement(spark):
    line = " ".join(["a", "bc", "DE", "F", "gh", "IJ"] * 5000)
    assert run(spark, [line], T.merge_broken_words) == [python_merge(line)]
    assert "aggregate(" not in _plan(spark.range(1).select(T.merge_broken_words(F.concat(F.lit("a b"), F.col("id")))))


def test_exact_tokens_need_no_python_and_know_all_signs(spark):
    import unicodedata

    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    values = ["".join(f"ab{c}c {c}{c}" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    folded = ["".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower() for v in values]
    assert run(spark, values, lambda t: K.tokens(t, exact=True)) == [list(dict.fromkeys(re.findall("[a-z0-9]{4,}", f))) for f in folded]
    assert "Python" not in spark.createDataFrame([("x",)], "t string").select(K.tokens(F.col("t"), exact=True))._jdf.queryExecution().executedPlan().toString()

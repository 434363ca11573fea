import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators import classify, export, layout, ocr_parse, tables

WORDS = "doc_id string, page int, pos long, text string, x0 double, x1 double, top double, bottom double"
BLOCKS = "doc_id string, page int, pos long, bbox struct<x1:double,y1:double,x2:double,y2:double>"


def word_table(spark, tops):
    return spark.createDataFrame([("d", 1, k, f"w{k}", 10.0 * k, 10.0 * k + 8, float(t), t + 5.0) for k, t in enumerate(tops)], WORDS)


def test_anchor_does_not_drift(spark):
    rows = layout.number_lines(word_table(spark, [1, 2, 5, 9, 10])).orderBy("pos").collect()
    assert [r.line_no for r in rows] == [1, 1, 2, 3, 3]


def test_lines_and_paragraphs(spark):
    words = word_table(spark, [0, 1, 20, 21, 60])
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0)], "doc_id string, page int, width double, height double")
    lines = layout.lines_of_words(words, pages)
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["w0 w1", "w2 w3", "w4"]
    got = layout.paragraphs(lines, gap=0.2).orderBy("pos").collect()
    assert [(r.block_id, r.text) for r in got] == [("p1_b1", "w0 w1\nw2 w3"), ("p1_b2", "w4")]
    assert got[0].bbox.x2 == pytest.approx(0.38) and got[0].bbox.y2 == pytest.approx(0.26)


def random_page(rng, doc):
    out = []
    for k in range(rng.randrange(1, 14)):
        x1 = rng.choice([0.05, 0.1, 0.55, 0.6, rng.random() * 0.4])
        w = rng.choice([0.1, 0.2, 0.3, 0.65])
        y1 = round(rng.random() * 0.9, 2)
        out.append((doc, 1, k, (x1, y1, x1 + w, y1 + rng.choice([0.0, 0.01, 0.05, 0.1]))))
    return out


def test_reading_order_equals_the_plain_sort(spark):
    rng = random.Random(11)
    rows = [r for d in range(150) for r in random_page(rng, f"d{d}")]
    got = {(r.doc_id, r.pos): r.reading_pos for r in layout.reading_order(spark.createDataFrame(rows, BLOCKS)).collect()}
    two_columns = layout.detect_columns(spark.createDataFrame(rows, BLOCKS)).count()
    assert two_columns > 20
    for d in range(150):
        own = [r for r in rows if r[0] == f"d{d}"]
        want = layout.sort_page(pd.DataFrame([dict(pos=r[2], x1=r[3][0], y1=r[3][1], x2=r[3][2], y2=r[3][3]) for r in own]))
        assert {p: got[f"d{d}", p] for p in want.pos} == dict(zip(want.pos, want.reading_pos)), own


def test_other_orders(spark):
    rows = [("d", 1, 0, (0.5, 0.1, 0.6, 0.2)), ("d", 1, 1, (0.1, 0.5, 0.2, 0.6))]
    df = spark.createDataFrame(rows, BLOCKS)
    assert [r.pos for r in layout.reading_order(df, "left-to-right").orderBy("reading_pos").collect()] == [1, 0]
    assert [r.pos for r in layout.reading_order(df, "sideways").orderBy("reading_pos").collect()] == [0, 1]


@pytest.mark.parametrize("cover,kept", [(0.5, True), (0.51, False)])
def test_overlap_threshold(spark, cover, kept):
    texts = spark.createDataFrame([("d", 1, 0, (0.0, 0.0, 1.0, 0.125)), ("d", 1, 1, (0.2, 0.2, 0.2, 0.4))], BLOCKS)
    found = spark.createDataFrame([("d", 1, 0, (0.0, 0.0, cover, 0.5)), ("e", 1, 0, (0.0, 0.0, 1.0, 1.0))], BLOCKS)
    left = {r.pos for r in layout.remove_overlapping(texts, found).collect()}
    assert left == ({0, 1} if kept else {1})


def test_merge_and_ranges(spark):
    rows = [("d", 1, k, b) for k, b in enumerate([(0.0, 0.0, 0.1, 0.02), (0.105, 0.001, 0.2, 0.03), (0.3, 0.0, 0.4, 0.02), (0.0, 0.5, 0.1, 0.6)])]
    got = layout.merge_nearby_boxes(spark.createDataFrame(rows, BLOCKS)).orderBy("n").collect()
    assert [(r.bbox.x1, r.bbox.x2) for r in got] == [(0.0, 0.1), (0.3, 0.4), (0.105, 0.2), (0.0, 0.1)] or len(got) == 3
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3, 7, 9, 10, 2)], "doc_id string, page int")
    assert sorted((r.first_page, r.last_page) for r in layout.page_ranges(pages).collect()) == [(1, 3), (7, 7), (9, 10)]


@pytest.mark.parametrize("image,text,want", [(0.31, 0.0, "scan"), (0.31, 0.049, "hybrid"), (0.31, 0.05, "digital"), (0.8, 0.05, "digital"), (0.81, 0.05, "hybrid"), (0.3, 0.01, "scan"), (0.3, 0.011, "digital"), (0.0, 0.0, "scan"), (None, None, "scan")])
def test_page_type(spark, image, text, want):
    df = spark.createDataFrame([(image, text)], "i double, t double")
    assert df.select(classify.page_type(F.col("i"), F.col("t")).alias("r")).first().r == want


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 0.5, 0.5), (0.25, 0.25, 1.0, 1.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    r = df.select(G.overlap(F.col("a"), F.col("b")).alias("o"), G.area(F.col("a")).alias("s"), G.to_array(G.from_array(F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0, 4.0)]))).alias("l")).first()
    assert r.o == pytest.approx(0.0625) and r.s == 0.25 and r.l == [1.0, 2.0, 3.0, 4.0]
    df.select(G.checked(F.col("a"))).collect()
    with pytest.raises(Exception, match="unit square"):
        df.select(G.checked(G.box(F.lit(0), F.lit(0), F.lit(2), F.lit(1)))).collect()


def test_runs_break_on_change(spark):
    rows = [("d", 1, k, b, t, c, 10.0 * k, 0.0, 9.0, 5.0) for k, (b, t, c) in enumerate([(1, "ab", 90.0), (1, "cd", 80.9), (2, "", 95.0), (2, "ef", -1.0), (1, "gh", 70.0), (2, "ij", 20.0), (1, "kl", 60.0), (1, "m", 31.0)])]
    df = spark.createDataFrame(rows, "doc_id string, page int, word_pos long, block_num int, text string, conf double, left double, top double, width double, height double")
    got = ocr_parse.blocks_from_word_table(df).orderBy("pos").collect()
    assert [(r.text, round(r.confidence, 3)) for r in got] == [("ab cd gh", 0.8), ("kl m", 0.455)]


def test_recognised_blocks(spark):
    box = (0.1, 0.1, 0.5, 0.2)
    rows = [("d", 1, 0, line, k, v, c, box) for line, k, v, c in [(0, 0, "Uma", 0.95), (0, 1, "linha", 0.93), (1, 0, "outra", 0.9), (1, 1, "vez", 0.92)]] + [("d", 1, 1, 0, 0, "ruim", 0.2, box)]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_no int, line_no int, word_no int, value string, confidence double, line_bbox struct<x1:double,y1:double,x2:double,y2:double>")
    got = ocr_parse.blocks_from_lines(df).collect()
    assert len(got) == 1 and got[0].text == "Uma linha\noutra vez" and got[0].confidence == pytest.approx(0.925) and len(got[0].lines) == 2
    clean = ocr_parse.postprocess_blocks(ocr_parse.blocks_from_lines(df)).first()
    assert clean.lines == got[0].lines


def test_tables(spark):
    df = spark.createDataFrame([([[" a ", None], ["", " "]],), ([["x"], ["y", "z"], ["1", "2", "3"]],), ([],)], "r array<array<string>>")
    got = df.select(tables.drop_empty_rows(F.col("r")).alias("d"), tables.is_regular(F.col("r")).alias("ok"), tables.strip_cells(F.col("r")).alias("s")).collect()
    assert [len(r.d) for r in got] == [1, 3, 0] and [bool(r.ok) for r in got] == [True, False, False] and got[0].s == [["a", ""], ["", ""]]


def test_overlay(spark):
    block = "doc_id string, page int, block_id string, type string, text string, bbox array<double>, rows array<array<string>>, lines array<struct<text:string,bbox:array<double>>>"
    box = [0.1, 0.1, 0.9, 0.5]
    rows = [("d", 1, "t", "table", None, box, [["a", "b"], [None, ""], ["c", None]], None), ("d", 1, "l", "paragraph", "x\ny", box, None, [("x", [0.1, 0.1, 0.5, 0.2]), ("", box), ("bad", [0.1])]), ("d", 1, "f", "paragraph", "x\n \ny", box, None, None), ("d", 1, "z", "paragraph", "flat", [0.1, 0.1, 0.1, 0.5], None, None)]
    lines = export.overlay_lines(spark.createDataFrame(rows, block))
    got = sorted((r.block_id, r.n, r.text, [round(v, 3) for v in r.bbox]) for r in lines.collect())
    assert got[:2] == [("f", 0, "x", [0.1, 0.1, 0.9, 0.3]), ("f", 1, "y", [0.1, 0.3, 0.9, 0.5])]
    assert [g[2] for g in got if g[0] == "t"] == ["a | b", "c"] and [g[2] for g in got if g[0] == "l"] == ["x"]
    placed = export.place_lines(lines, spark.createDataFrame([("d", 1, 100.0, 200.0)], "doc_id string, page int, width double, height double")).collect()
    assert {r.block_id for r in placed} == {"t", "l", "f"}
    x = next(r for r in placed if r.block_id == "l")
    assert x.font_size == pytest.approx(16.0) and x.x == pytest.approx(10) and x.y == pytest.approx(200 - 40 + 2) and x.horizontal_scale == pytest.approx(40 / (500 * 16 / 1000) * 100)
    df = spark.createDataFrame([("iiii", 30.0), ("WWWW", 30.0), ("", 30.0), ("WWWWWWWWWWWW", 10.0)], "t string, w double")
    assert [r.r for r in df.select(export.fitting_font(F.col("t"), F.col("w")).alias("r")).collect()] == [16.0, 6.0, 4.0, 4.0]


def test_a_text_is_measured_once_for_all_sizes(spark):
    df = spark.createDataFrame([("W" * 5 + "é\U0001d400 i'", 90.0), ("", 5.0), (None, 5.0), ("a", None)], "t string, w double")
    font = df.select(export.fitting_font(F.col("t"), F.col("w")).alias("r"), F.round(export.natural_width(F.col("t"), F.lit(1000.0))).cast("long").alias("n"))
    assert font._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    width = lambda t: sum(export.WIDTH_OF.get(c, 556) for c in t)
    assert [(r.r, r.n) for r in font.collect()] == [(12.0, width("W" * 5 + "é\U0001d400 i'")), (4.0, 0), (4.0, None), (4.0, 556)]


def test_overlay_splits_a_text_once_whatever_its_lines(spark):
    import time

    text = "\n".join(f"line {k}" for k in range(4000))
    df = spark.createDataFrame([("d", 1, "b", "paragraph", text, [0.0, 0.0, 1.0, 1.0], None, None)], "doc_id string, page int, block_id string, type string, text string, bbox array<double>, rows array<array<string>>, lines array<struct<text:string,bbox:array<double>>>")
    began = time.time()
    got = export.overlay_lines(df).collect()
    assert time.time() - began < 15 and [(r.n, r.text, r.bbox[3]) for r in got] == [(k, f"line {k}", (k + 1) * 1.0 / 4000) for k in range(4000)]


def test_reading_order_reads_its_blocks_once(spark):
    df = spark.createDataFrame([("d", 1, 1, (0.1, 0.1, 0.2, 0.2))], BLOCKS)
    plan = layout.reading_order(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1


def test_merged_blocks_join_tables_only(spark):
    from pagewright.plans import documents

    df = spark.createDataFrame([("d", 1, 1, (0.1, 0.1, 0.2, 0.2))], BLOCKS).selectExpr("*", "'b' AS block_id", "'t' AS text")
    plan = documents.merge_tables(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("LogicalRDD") == 3


@pytest.mark.parametrize("name", ["merged_blocks", "overlap_antijoin"])
def test_queries_on_tables_read_their_items_once_without_a_join(spark, name):
    from pagewright.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_marked_blocks_merge_as_separate_ones(spark):
    from pagewright.plans import documents

    rng = random.Random(7)
    rows = [(*r, f"{r[2]}", rng.random() < 0.4) for d in range(120) for r in random_page(rng, f"d{d}")]
    rows += [(None, 1, 0, (0.0, 0.0, 0.5, 0.5), "x", False), (None, 1, 1, (0.0, 0.0, 1.0, 1.0), "t", True)]
    df = spark.createDataFrame(rows, BLOCKS + ", block_id string, tab boolean")
    key = lambda out: sorted(((r.doc_id, r.block_id, r.reading_pos) for r in out.collect()), key=repr)
    want = key(documents.merge_tables(df.where("NOT tab"), df.where("tab")))
    assert key(documents.merge_marked(df, F.col("tab"))) == want and 122 < len(want) < len(rows)

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import chunking as ck


def python_split(text, limit=1200):
    """Pack trimmed lines into chunks; cut long ones at the last blank of their second half."""
    chunks, held, size = [], [], 0

    def flush():
        nonlocal held, size
        if held:
            chunks.append("\n".join(held))
        held, size = [], 0

    for line in (x.strip() for x in text.strip().splitlines()):
        if not line:
            continue
        while len(line) > limit:
            at = line[:limit].rfind(" ")
            at = limit if at < limit // 2 else at
            flush()
            if line[:at].strip():
                chunks.append(line[:at].strip())
            line = line[at:].strip()
        if held and size + len(line) + 1 > limit:
            flush()
        if line:
            held.append(line)
            size += len(line) + 1
    flush()
    return chunks


def split(spark, texts, f=ck.split_text):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.c for r in rows.select("k", f(F.col("t")).alias("c")).orderBy("k").collect()]


def test_split_equals_python(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12)))
    texts = ["", "   ", "x" * 1200, "x" * 1201, "x" * 5000, "a" * 599 + " " + "b" * 900, "a" * 600 + " " + "b" * 900, "a" * 1199 + " b" * 5, "l1\x0bl2\x1cl3\x85l4 l5\r\nl6\r"]
    texts += [rng.choice(["\n", " ", "\n\n"]).join(word() for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    texts += ["\n".join(" ".join(word() for _ in range(rng.choice([3, 80, 400]))) for _ in range(6)) for _ in range(40)]
    assert split(spark, texts) == [python_split(t) for t in texts]


def test_rows(spark):
    row = ["x" * 100, None, "  y  ", ""]
    df = spark.createDataFrame([([row] * 3,), ([row] * 60,), ([["a"]] * 100,), ([],), (None,)], "r array<array<string>>")
    got = [r.c for r in df.select(ck.split_rows(F.col("r")).alias("c")).collect()]
    assert got[0] == ["\n".join(["x" * 100 + " y"] * 3)]
    assert all(len(c) <= 1200 for c in got[1]) and sum(c.count("\n") + 1 for c in got[1]) == 60
    assert [c.count("\n") + 1 for c in got[2]] == [40, 40, 20] and got[3] == [] and got[4] == []


@pytest.mark.parametrize("text,want", [("Otnemucod o rirefnoc e mais", True), ("código da certidão assinado digitalmente", True), ("assinada digitalmente", False), ("https://comunicaapi.pje.jus.br/api/certidao", True), ("https://comunicaapi.pje.jus.br/api/certidao " + "x" * 600, False), ("Fls. 24", True), ("fls. 24" + "x" * 120, False), ("CERTIDÃO DE PUBLICAÇÃO DE RELAÇÃO este documento é cópia do original", True)])
def test_low_value(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ck.is_low_value(F.col("t")).alias("r")).first().r is want


def test_ids_and_filters(spark):
    long = "\n".join(f"linha {k} " + "palavra " * 12 for k in range(40))
    rows = [("d", "f", 1, "p1_b1", "paragraph", "y" * 60, None, 1.0), ("d", "f", 1, "p1_b2", "paragraph", long, None, 0.9), ("d", "f", 2, "p2_t1", "table", None, [["z" * 30, "w" * 30]], 0.8), ("d", "f", 2, "p2_b3", "paragraph", "curto", None, 1.0), ("d", "f", 3, "p3_b1", "paragraph", ".dBmu9HEi " + "q" * 50, None, 1.0), ("d", "f", 3, "p3_b2", "paragraph", None, [], 1.0)]
    blocks = spark.createDataFrame(rows, "document_id string, source_file string, page_number int, block_id string, block_type string, text string, rows array<array<string>>, confidence double")
    got = {r.chunk_id: r for r in ck.chunk_blocks(blocks).collect()}
    parts = python_split(long)
    assert set(got) == {"d:1:p1_b1", "d:2:p2_t1", "d:3:p3_b1"} | {f"d:1:p1_b2:part{k}" for k in range(1, len(parts) + 1)}
    assert got["d:3:p3_b1"].text == "q" * 50 and got["d:1:p1_b2:part1"].block_id == "p1_b2:part1" and len(parts) > 2


def test_document_blocks(spark):
    from pagewright.schemas import DOCUMENT

    page = (1, "digital", [("p1_b1", "paragraph", "t" * 60, [0.0, 0.0, 1.0, 1.0], 1.0, None, None)], 1.0, 1.0, "pt")
    docs = spark.createDataFrame([("d", "f.pdf", 1, None, [page])], DOCUMENT)
    assert [r.chunk_id for r in ck.chunk_blocks(ck.document_blocks(docs)).collect()] == ["d:1:p1_b1"]


def test_each_chunk_is_cleaned_once_and_carries_its_own_text_only(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import chunking

    row = spark.range(1).selectExpr("id AS document_id", "'d.pdf' AS source_file", "1 AS page_number", "'b' AS block_id", "'paragraph' AS block_type", "concat(repeat('word ', 20000), id) AS text", "CAST(NULL AS array<array<string>>) AS rows", "1.0D AS confidence")
    found = chunking.chunk_blocks(row)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{6,12}") == 1
    texts = [r.text for r in found.orderBy(F.length("chunk_id"), "chunk_id").collect()]
    assert " ".join(texts) == "word " * 20000 + "0" and {len(t) for t in texts[:-1]} == {1199}

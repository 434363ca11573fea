import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns of a table that meets every operator: names that operators use inside, too.
EXTRA = "score double, th long, node long, label string, bin int, shard int, group_size long, keep boolean, total long, signature long, data string"


def sentence(rng: random.Random, n: int, prefix: str = "") -> str:
    return " ".join(prefix + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang): null id, null and empty and blank texts, repeated rows, a very long text."""
    rng = random.Random(5)
    plain = sentence(rng, 60)
    return [
        (None, plain, "en"),
        (None, None, None),
        (1, None, "en"),
        (2, "", "en"),
        (3, "  \n\t", "fr"),
        (4, plain, "en"),
        (4, plain, "en"),
        (4, sentence(rng, 40), None),
        (5, plain, "en"),
        (6, sentence(rng, 30_000), "fr"),
        (7, "x" * 200_000, "en"),
        (8, "一二三 \U0001f600 né́e", "en"),
        (-9, "?!... --- ###", "en"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows as a table with extra, clashing columns."""
    pad = (1.0, 1, 1, "l", 1, 1, 1, True, 1, 1, "d")
    return spark.createDataFrame([r + pad for r in edge_rows], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

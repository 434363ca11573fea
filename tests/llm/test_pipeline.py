import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from pagewright.llm import bpe, langid, packing, queries, simhash, toxicity

from .conftest import SF


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small fixture in the driver's layout: the smallest scale's documents, more labels, edge rows."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, None, "en", "s", 1), (90002, "", "en", "s", 0), (90003, "ab", None, "s", 2)], docs.schema)
    docs.where("doc_id < 260").unionByName(docs.where("doc_id < 5")).unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_equals_a_plain_run(spark, sf_dir):
    """The same models applied row by row on the driver."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    crf = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r, (s, _, _) in zip(rows, crf.score([t for _, t, _ in rows])) if s < crf.params.threshold]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rows = [r for r in rows if model.classify(r[1])[4]]
    from .test_simhash import brute

    gone = {d for g in brute([(d, t) for d, t, _ in rows]) for d in g[1:]}
    left = {(d, t) for d, t, _ in rows if d not in gone}
    coder = bpe.Tokenizer(bpe.load_ranks(bpe.BpeParams().vocabulary))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {d for d, _ in left} and len(left) > 150
    sizes = sorted((min(2048, n - at), d) for d, t in left for n in [max(1, len(coder.encode(t or "")))] for at in range(0, n, 2048))
    assert sorted((r.n_tokens, r.doc_id) for r in got) == sizes
    order = sorted(got, key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
    assert [r.bin for r in order] == packing.best_fit([r.n_tokens for r in order], 2048)[0]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= docs.count()


def test_stages_on_an_empty_table_and_extra_columns(spark, sf_dir, empty_docs, edge_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, sf_dir).count() == 0
        stage(spark, edge_docs, sf_dir).write.format("noop").mode("overwrite").save()


def test_every_operator_has_a_query(spark):
    names = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    for name in ("op3_packing", "op7_warc", "op10_bpe"):
        assert names[name](spark, SF).count() > 0


def test_toxic_words_of_the_small_scale_are_found(spark):
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    assert sum(1 for r in got if labels.get(r.doc_id) == 0) <= 3 and len(got) > 40
    assert simhash.near_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count() > 50

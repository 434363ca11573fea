import random

from pyspark.sql import functions as F

from pagewright.llm import langid

P = langid.LangIdParams(sample_docs=40, dictionary_bytes=32_768)


def corpus(spark, n=60):
    rng = random.Random(1)
    parts = {"aa": ["tor", "vel", "min", "sha", "quo"], "bb": ["üst", "ack", "zei", "blo", "grü"]}
    say = lambda p: " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(80))
    return spark.createDataFrame([(k * 2 + i, say(p), lang) for k in range(n) for i, (lang, p) in enumerate(parts.items())], "doc_id long, text string, lang string"), say, parts


def test_held_out_accuracy(spark):
    docs, say, parts = corpus(spark)
    model = langid.train(docs, params=P)
    assert set(model.dictionaries) == {"aa", "bb"}
    for lang, p in parts.items():
        found = [model.classify(say(p)) for _ in range(40)]
        assert sum(f[0] == lang and f[4] for f in found) >= 38


def test_sizes_are_those_of_a_fresh_encoder(spark):
    import zstandard as zstd

    docs, say, parts = corpus(spark)
    model = langid.train(docs, params=P)
    text = say(parts["aa"]) * 30
    for lang, size in model.sizes(text).items():
        known = zstd.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        data = text.lower().encode()
        total = 0
        half = len(model.dictionaries[lang]) // 2
        for at in range(0, len(data), P.block_bytes):
            block = data[at : at + P.block_bytes]
            block = model.dictionaries[lang][half : half + P.carrier_bytes] + block
            known.precompute_compress(level=P.level)
            total += len(zstd.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False).compress(block))
        assert total == size


def test_mixture_has_a_narrower_margin(spark):
    docs, say, parts = corpus(spark)
    model = langid.train(docs, params=P)
    pure = model.classify(say(parts["aa"]) * 4)[3]
    mixed = model.classify(" ".join(a + " " + b for a, b in zip(say(parts["aa"]).split(), say(parts["bb"]).split())) * 4)[3]
    assert mixed < pure


def test_training_ignores_layout(spark):
    docs, _, _ = corpus(spark)
    a = langid.train(docs.repartition(7), params=P)
    b = langid.train(docs.coalesce(1).orderBy(F.desc("doc_id")), params=P)
    assert a.dictionaries == b.dictionaries


def test_edges(spark, edge_docs, empty_docs, edge_rows):
    model = langid.train(edge_docs, params=P)
    rows = langid.identify(edge_docs, model).collect()
    ids = langid.identify(edge_docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), model)
    assert ids.schema["doc_id"].dataType.simpleString() == "string" and ids.count() == len(edge_rows)
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert r.found_lang is None and not r.accepted and r.best_bytes == 0
    kept = langid.keep_identified(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert kept.where("text is null or trim(text) = ''").count() == 0
    assert langid.identify(empty_docs, langid.train(empty_docs, params=P)).count() == 0
    untrained = langid.train(empty_docs, params=P)
    assert not any(r.accepted for r in langid.identify(edge_docs, untrained).collect())


def test_identify_equals_brute_force(spark):
    """Every row against encoders made afresh, from the dictionaries and the margin alone."""
    import zstandard as zstd

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for doc in docs.collect():
        sizes = {}
        data = (doc.text or "").lower().encode()
        for lang, own in model.dictionaries.items():
            known = zstd.ZstdCompressionDict(own, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=6)
            coder = zstd.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes[lang] = sum(len(coder.compress(own[len(own) // 2 : len(own) // 2 + 300] + data[k : k + 4096])) for k in range(0, len(data), 4096))
        r = got[doc.doc_id]
        if not (doc.text or "").strip():
            assert r.found_lang is None and not r.accepted
            continue
        (best, lang), (second, _) = sorted((n, k) for k, n in sizes.items())[:2]
        assert (r.found_lang, r.best_bytes, r.second_bytes) == (lang, best, second)
        assert r.accepted == (second > best and (second - best) / best >= model.margin)


def test_all_sampled_texts_enter_the_dictionary(spark):
    rows = [(k, f"w{k:04d} " * (3 if k % 2 else 4000), "aa") for k in range(200)] + [(999, f"w{0:04d} " * 4000, "aa")] * 50
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), params=langid.LangIdParams(dictionary_bytes=20_000))
    held = {w for k in range(200) if (w := b"w%04d" % k) in model.dictionaries["aa"]}
    assert 130 <= len(held) <= 140  # two thirds of the 200 distinct texts
    assert 15_000 < len(model.dictionaries["aa"]) <= 20_200


def test_margin_is_calibrated():
    p = langid.LangIdParams()
    right = [0.01 * k for k in range(1, 1001)]
    assert langid.calibrated(right, [], p) == p.min_margin
    assert langid.calibrated(right, [0.001, 0.02, 0.5], p) == 0.02
    assert langid.calibrated(right, [0.3, 0.4, 0.5], p) == right[5]
    assert langid.calibrated([], [0.3], p) == 0.3


def test_errors_are_rejected_more_than_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.train(docs)).where("found_lang is not null").collect()
    wrong = [r.accepted for r in rows if r.given_lang != r.found_lang]
    right = [r.accepted for r in rows if r.given_lang == r.found_lang]
    assert sum(wrong) <= 0.5 * len(wrong) + 1
    assert sum(right) >= 0.98 * len(right)


def test_ties_are_rejected():
    model = langid.CompressionClassifier({"a": b"same words here", "b": b"same words here"}, P)
    _, best, second, margin, accepted = model.classify("same words here again")
    assert best == second and margin == 0 and not accepted

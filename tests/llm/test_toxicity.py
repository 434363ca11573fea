import itertools
import random

import numpy as np
import pytest

from pagewright.llm import toxicity as tx

from .conftest import sentence

P = tx.CrfParams(rounds=30, sample_docs=400)
BAD = ["blorgful", "snazzled", "quibwort"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    common = sentence(rng, 300).split()
    rows = []
    for k in range(n):
        words = [rng.choice(common) for _ in range(rng.choice([8, 40, 200]))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice([*BAD, "xyzzy" + rng.choice(common)]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def brute_marginals(score, start, move):
    """All state sequences."""
    n = len(score)
    total, ones = 0.0, np.zeros(n)
    for states in itertools.product((0, 1), repeat=n):
        s = start[states[0]] + sum(score[k] for k in range(n) if states[k]) + sum(move[a, b] for a, b in zip(states, states[1:]))
        w = np.exp(s)
        total += w
        ones += w * np.array(states)
    return ones / total


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([3, 0, 7, 1, 5])
    score, start, move = rng.normal(size=16) * 2, rng.normal(size=2), rng.normal(size=(2, 2))
    got, pairs, first = tx.marginals(score, lengths, start, move, with_pairs=True)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], brute_marginals(score[at : at + n], start, move))
        at += n
    assert pairs.sum() == pytest.approx((lengths[lengths > 0] - 1).sum()) and first.sum() == pytest.approx(4)


def test_held_out_documents_and_offsets(spark):
    rows = corpus()
    model = tx.fit([t for _, t, _ in rows], [bool(y) for _, _, y in rows], P)
    test = corpus(200, seed=1)[:0] + [(k, t, y) for k, t, y in corpus(400, seed=1)[300:]]
    docs = spark.createDataFrame([(k, t) for k, t, _ in test], "doc_id long, text string")
    got = {r.doc_id: r for r in tx.score_documents(docs, model).collect()}
    right = sum(got[k].toxic == bool(y) for k, _, y in test)
    assert right >= 0.97 * len(test)
    for k, t, y in test:
        for s in got[k].spans:
            assert any(t[s.start : s.end].startswith(b) for b in [*BAD, "xyzzy"])


def test_copies_do_not_make_words_toxic():
    rows = corpus()
    copied = [("madeupword anotherone " + rows[0][1], True)] * 40
    keys = tx.offending_keys([tx.WORD.findall(t) for t in [r[1] for r in rows] + [c for c, _ in copied]], np.array([bool(r[2]) for r in rows] + [True] * 40), P)
    assert "=madeupword" not in keys and "=blorgful" in keys


def test_a_common_passage_makes_no_copies():
    rows = corpus()
    passage = sentence(random.Random(9), 60)
    words = [tx.WORD.findall(f"{t} {passage}" if k % 10 else t) for k, t, _ in rows]
    toxic = np.array([bool(y) for _, _, y in rows])
    weight = tx.copy_weights(words, toxic)
    long = np.array([len(w) > 150 for w in words])
    assert (weight[long] == 1).all()
    assert {"=" + b for b in BAD} <= tx.offending_keys(words, toxic, P)


def test_copies_of_another_label_keep_their_weight():
    text = [sentence(random.Random(3), 50).split()] * 3
    assert tx.copy_weights(text, np.array([True, False, False])).tolist() == [1, 0.5, 0.5]


def two_languages(n, seed):
    """In the second, smaller language bad words are marked by a stem that clean texts hold once at times."""
    rng = random.Random(seed)
    one, two = sentence(random.Random(7), 300).split(), sentence(random.Random(8), 300, "ö").split()
    rows = []
    for k in range(n):
        toxic, small = k % 5 == 0, k % 4 == 0
        words = [rng.choice(two if small else one) for _ in range(rng.choice([60, 200]))]
        stem = lambda: "grumbo" + rng.choice(two) if small else rng.choice(BAD)
        for _ in range(max(3, len(words) // 20) if toxic else int(small and rng.random() < 0.1)):
            words.insert(rng.randrange(len(words)), stem())
        rows.append((k, " ".join(words), int(toxic), "bb" if small else "aa"))
    return rows


def test_recall_of_each_language(spark):
    docs = spark.createDataFrame(two_languages(700, 1), "doc_id long, text string, toxic int, lang string")
    model = tx.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), tx.CrfParams())
    test = two_languages(400, 2)
    found = [s[0] >= 0.5 for s in model.score([t for _, t, _, _ in test])]
    for name in ("aa", "bb"):
        own = [(f, y) for f, (_, _, y, lang) in zip(found, test) if lang == name]
        assert sum(f for f, y in own if y) >= 0.9 * sum(y for _, y in own)
        assert sum(f for f, y in own if not y) <= 0.05 * sum(1 - y for _, y in own)


def test_even_share():
    for counts, total, want in (([5, 100, 100], 65, 30), ([5, 6], 100, 6), ([], 10, 1), ([9, 9, 9], 2, 1), ([10], 10, 10)):
        assert tx.even_share(counts, total) == want


def test_edges(spark, edge_docs, empty_docs, edge_rows):
    rows = corpus(150)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5000, 1), (7, None), (0, 1), (0, 0)], "doc_id long, toxic int")
    model = tx.train(docs, labels, P)
    got = tx.score_documents(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    assert all(r.score == 0 and not r.toxic and r.spans == [] for r in got if r.doc_id in (1, 2, 3, -9))
    kept = tx.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.where("text is null").count() == 2
    assert tx.score_documents(empty_docs, model).count() == 0
    nothing = tx.train(empty_docs, labels, P)
    assert not any(r.toxic for r in tx.score_documents(edge_docs, nothing).collect())
    loud = spark.createDataFrame([(1, "quite blorgful blorgful snazzled here"), (1, "quite blorgful blorgful snazzled here")], "doc_id long, text string")
    assert tx.score_documents(loud, model, toxic_only=True).count() == 2
    assert tx.drop_toxic(loud, model).count() == 0


def test_training_ignores_layout(spark):
    rows = corpus(150)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    a, b = tx.train(docs.repartition(5), labels, P), tx.train(docs.coalesce(1), labels.repartition(3), P)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.move, b.move)

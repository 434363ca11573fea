import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import bpe, queries
from pagewright.llm import packing as pk


def slow_best_fit(lengths, capacity):
    """Linear search for the tightest open bin; among equals the one that came to that room last."""
    rooms, stamp, bins = [], [], []
    for k, n in enumerate(lengths):
        fits = [(r, -stamp[i], i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits)[2]
        else:
            i = len(rooms)
            rooms.append(capacity)
            stamp.append(0)
        rooms[i] -= n
        stamp[i] = k + 1
        bins.append(i)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=80))
def test_tree_equals_linear_search(capacity, lengths):
    lengths = sorted((min(n, capacity) for n in lengths), reverse=True)
    assert pk.best_fit(lengths, capacity)[0] == slow_best_fit(lengths, capacity)


def check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append((r.bin_offset, r.n_tokens))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity


def test_pack_whole_documents(spark):
    rng = random.Random(1)
    sizes = [rng.choice([1, 5, 900, 2047, 2048, 2049, 9000]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long").selectExpr("*", "cast(null as string) text")
    params = pk.PackParams(shard_pieces=150)
    rows = pk.pack(docs, params, length="n").collect()
    assert {r.shard for r in rows} > {0}
    check(rows, 2048)
    total = defaultdict(int)
    for r in rows:
        assert r.start == r.piece * 2048
        total[r.doc_id] += r.n_tokens
    assert dict(total) == dict(enumerate(sizes))
    for shard in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
        assert [r.bin for r in own] == slow_best_fit([r.n_tokens for r in own], 2048)


def test_edges(spark, edge_docs, empty_docs, edge_rows):
    params = pk.PackParams(capacity=1000)
    rows = pk.pack(edge_docs, params).collect()
    check(rows, 1000)
    coder = bpe.Tokenizer(bpe.load_ranks(params.tokens.vocabulary))
    want = sum(max(1, len(coder.encode(t or ""))) for _, t, _ in edge_rows)
    assert sum(r.n_tokens for r in rows) == want
    assert sum(1 for r in rows if r.doc_id == 2) == 1
    assert pk.pack(empty_docs, params).count() == 0
    again = pk.pack(edge_docs.repartition(1), params).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_null_lengths(spark):
    docs = spark.createDataFrame([(1, None), (2, 0), (3, -4), (None, 3)], "doc_id long, n long").selectExpr("*", "'' text")
    assert sorted(r.n_tokens for r in pk.pack(docs, length="n").collect()) == [1, 1, 1, 3]


def test_bins_hold_real_tokens(spark):
    """No bin of the registered query is over its capacity when its pieces are encoded again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coder = bpe.Tokenizer(bpe.load_ranks(bpe.BpeParams().vocabulary))
    ids = {r.doc_id: coder.encode(r.text or "") for r in docs.select("doc_id", "text").collect()}
    rows = queries.op3_packing(spark, "/root/testdata/sf0.01").collect()
    held, seen = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(ids[r.doc_id][r.start : r.start + r.n_tokens])
        assert n == r.n_tokens or (n == 0 and r.n_tokens == 1)
        held[r.shard, r.bin] += r.n_tokens
        seen[r.doc_id] += n
    assert max(held.values()) <= 2048 and dict(seen) == {d: len(x) for d, x in ids.items()}
    assert sum(held.values()) / len(held) > 2000


def test_ids_of_other_types(spark):
    rows = pk.pack(spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "x y")], "doc_id string, text string")).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.bin_offset)] == ["a", "b", None]
    big = [2**53, 2**53 + 1, None]
    rows = pk.pack(spark.createDataFrame([(k, "one") for k in big], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == set(big)


@pytest.mark.parametrize("need,want", [(3, (3, 1)), (4, (7, 0)), (8, None)])
def test_take(need, want):
    tree = pk.CapacityTree(10)
    tree.put(7, 0)
    tree.put(3, 1)
    assert tree.take(need) == want

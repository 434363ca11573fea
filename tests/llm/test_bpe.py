import random

import pytest
import tiktoken

from pagewright.llm import bpe
from pagewright.llm import token_output as to

from .conftest import sentence

P = bpe.BpeParams()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.vocabulary)


def slow_merge(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        r, k = min((ranks.get(a + b, bpe.NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if r == bpe.NONE:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_both_merges_equal_the_definition(ranks):
    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdethorin  ") for _ in range(rng.randrange(2, 40)))
        assert bpe.merge_short(w, ranks) == bpe.merge_long(w, ranks) == slow_merge(w, ranks)


def test_equals_a_public_encoder(ranks):
    rng = random.Random(2)
    own, other = bpe.Tokenizer(ranks), tiktoken.Encoding("t", pat_str=P.pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [sentence(rng, 300), "", " ", "it's  12½ naïve—一二\U0001f600\r\n\t x" * 3, "a" * 3000, "<|endoftext|>", "ab" * 5000]
    for t in texts:
        assert own.encode(t).tolist() == other.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t


def test_edges(spark, edge_docs, empty_docs, edge_rows):
    rows = bpe.encode(edge_docs)
    got = rows.collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert r.round_trip in (True, None) and (r.token_ids is None) == (r.round_trip is None)
    assert [r.token_ids for r in got if r.doc_id == 2] == [[]]
    assert bpe.encode(empty_docs).count() == 0
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in bpe.decode(rows).collect())
    assert back == sorted((d is None, d or 0, t or "") for d, t, _ in edge_rows)


def test_vocabulary_without_all_bytes_is_refused(ranks):
    with pytest.raises(ValueError):
        bpe.Tokenizer({b"a": 0})


# --- Re-Pair shards ----------------------------------------------------------------------------------


def test_repair_round_trip(ranks):
    import numpy as np

    rng = random.Random(3)
    params = to.TokenOutputParams(least_count=2)
    for base, n in ((300, 4000), (70_000, 3000), (10, 1), (10, 0)):
        ids = np.array([rng.randrange(min(base, 12)) + (base - 12 if base > 60_000 else 0) for _ in range(n)] + [3] * (50 if n > 1 else 0), dtype=np.uint32)
        cuts = np.array(sorted({0, len(ids), *(rng.randrange(len(ids) + 1) for _ in range(9))}))
        symbols, starts, rules, lengths = to.repair(ids, cuts, base, params)
        assert to.expand(symbols, rules, base).tolist() == ids.tolist()
        for a, b, x, y in zip(cuts, cuts[1:], starts, starts[1:]):
            assert to.expand(symbols[x:y], rules, base).tolist() == ids[a:b].tolist()
        for k, size in enumerate(lengths):
            assert len(to.expand(np.array([base + k]), rules, base)) == size
        if n > 1000:
            assert len(symbols) < 0.6 * len(ids)


def test_repair_leaves_no_pair_twice():
    import numpy as np

    rng = random.Random(6)
    copied = [rng.randrange(50_000) for _ in range(20_000)]
    for docs in ([copied] * 19, [[rng.randrange(9) for _ in range(rng.randrange(60))] for _ in range(200)], [[1, 1, 1], [2, 2, 2, 2, 2]]):
        ids, cuts = np.array([x for d in docs for x in d], dtype=np.uint32), np.cumsum([0, *map(len, docs)])
        symbols, starts, rules, _ = to.repair(ids, cuts, 50_257, to.TokenOutputParams())
        assert to.expand(symbols, rules, 50_257).tolist() == ids.tolist()
        seen = {}
        for a, b in zip(starts, starts[1:]):
            for k in range(a, b - 1):
                seen.setdefault((int(symbols[k]), int(symbols[k + 1])), []).append(k)
        assert all(v[-1] - v[0] < 2 for v in seen.values())
        if docs[0] is copied:
            assert len(symbols) == 19


def naive_repair(docs, base):
    """Pair by pair: the most frequent pair, counted without overlaps, is replaced from the left; ties by id."""
    rules = []
    while True:
        seen = {}
        for d in docs:
            last = {}
            for k in range(len(d) - 1):
                p = (d[k], d[k + 1])
                if last.get(p) != k - 1 or p[0] != p[1]:
                    seen[p] = seen.get(p, 0) + 1
                    last[p] = k
        best = min(((-n, p) for p, n in seen.items() if n > 1), default=None)
        if best is None:
            return docs, rules
        pair, name, out = best[1], base + len(rules), []
        rules.append(pair)
        for d in docs:
            new, k = [], 0
            while k < len(d):
                if k + 1 < len(d) and (d[k], d[k + 1]) == pair:
                    new.append(name)
                    k += 2
                else:
                    new.append(d[k])
                    k += 1
            out.append(new)
        docs = out


def test_repair_against_pair_by_pair():
    """The most frequent pair goes first, and the grammar is about as small as that of one pair at a time."""
    import numpy as np

    docs = [[150, 2, 3]] * 90 + [[1, 2, 3]] * 10
    ids, cuts = np.array([x for d in docs for x in d], dtype=np.uint32), np.cumsum([0, *map(len, docs)])
    symbols, _, rules, _ = to.repair(ids, cuts, 300, to.TokenOutputParams())
    want, named = naive_repair(docs, 300)
    assert rules.tolist()[0] == [2, 3] == list(named[0]) and len(symbols) == sum(map(len, want)) == 100
    rng = random.Random(8)
    for _ in range(12):
        words = [[rng.randrange(30) for _ in range(rng.randrange(1, 7))] for _ in range(40)]
        docs = [[x for _ in range(rng.randrange(30)) for x in rng.choice(words)] for _ in range(30)]
        ids, cuts = np.array([x for d in docs for x in d], dtype=np.uint32), np.cumsum([0, *map(len, docs)])
        symbols, _, rules, _ = to.repair(ids, cuts, 300, to.TokenOutputParams())
        want, named = naive_repair(docs, 300)
        ours, theirs = len(symbols) + 2 * len(rules), sum(map(len, want)) + 2 * len(named)
        assert ours <= 1.1 * theirs


def test_a_million_blanks(ranks):
    text = " " * 1_100_000 + "x"
    ids = bpe.FastCoder(ranks).encode(text)
    assert bpe.Tokenizer(ranks).decode(ids) == text
    assert bpe.FastCoder(ranks).encode("one  two\n\n three") == bpe.Tokenizer(ranks).encode("one  two\n\n three").tolist()


def test_shard_ids_of_other_types(spark):
    rows = to.shards(spark.createDataFrame([("k1", "a b"), (None, "c")], "doc_id string, text string").coalesce(1)).collect()
    assert [x for r in rows for x in r.doc_ids] == ["k1", None]


def test_shards_give_every_range(spark, ranks):
    rng = random.Random(4)
    rows = [(k, sentence(rng, rng.randrange(0, 90)) * 3) for k in range(60)] + [(None, "x y"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    coder = tiktoken.Encoding("t", pat_str=P.pattern, mergeable_ranks=ranks, special_tokens={})
    got, shards = [], to.shards(docs, to.TokenOutputParams(shard_tokens=2000, least_count=2)).collect()
    assert len(shards) > 3 and len({s.shard_id for s in shards}) == len(shards)
    want = [(d, coder.encode_ordinary(t) if t else []) for d, t in rows]
    for s in shards:
        shard = to.Shard.of(s)
        for k, d in enumerate(s.doc_ids):
            ids = shard.document(k).tolist()
            assert len(ids) == s.doc_tokens[k]
            got.append((d, ids))
            a, b = sorted((rng.randrange(len(ids) + 1), rng.randrange(len(ids) + 1)))
            assert shard.document(k, a, b).tolist() == ids[a:b]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_shard_edges(spark, edge_docs, empty_docs, edge_rows):
    shards = to.shards(edge_docs).collect()
    assert sum(s.n_docs for s in shards) == len(edge_rows)
    assert to.shards(empty_docs).count() == 0

import random

import numpy as np
import pytest

from pagewright.llm import simhash as sh

from .conftest import sentence

P = sh.SimHashParams()


def copies(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = sentence(rng, 400).split()
    rows = []
    for k in range(n):
        rows.append((k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120, 400])))))
    for k in range(n, n + 120):
        rows.append((k, copies(rng, rng.choice(rows[:20])[1], rng.choice([0, 0, 1, 2, 4, 9]))))
    return rows


def brute(rows, p=P):
    """Groups by comparing every pair of codes."""
    voter = sh.Voter()
    nodes = sorted({(d, t) for d, t in rows if d is not None and voter.code(t) is not None})
    code = [voter.code(t) for _, t in nodes]
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            a, b = code[i], code[j]
            near = bin((a[0] ^ b[0]) & (2**64 - 1)).count("1")
            full = near + bin((a[1] ^ b[1]) & (2**64 - 1)).count("1")
            if near <= p.probe_radius and full <= p.full_radius and abs(a[2] - b[2]) <= p.length_slack * max(a[2], b[2]):
                parent[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(nodes):
        out.setdefault(root(i), []).append(d)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.kept_doc_id, []).append(r.doc_id)
    return sorted(sorted([k, *v]) for k, v in out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = sh.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute(rows)
    assert grouped(found.collect()) == want
    assert sum(map(len, want)) > 100


def test_code_is_a_majority_vote():
    import xxhash

    text = "The cat, the DOG and a bird"
    words = {"the", "cat", "dog", "and", "a", "bird"}
    total = np.zeros(128)
    for w in words:
        total += np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(w), np.uint8)) * 2.0 - 1
    lo, hi = np.packbits(total > 0).view("<i8")
    assert sh.Voter().code(text) == (lo, hi, 7)
    assert sh.Voter().code(" ?! ") is None and sh.Voter().code(None) is None


@pytest.mark.parametrize("m", [5, 7, 10, 13])
def test_any_partitioning_finds_all_pairs(m):
    """Planted pairs up to the radius meet in a cell, whatever the thresholds' split."""
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, 400, dtype=np.int64).astype("<u8")
    other = base.copy()
    for k in range(len(base)):
        for b in rng.permutation(64)[: rng.integers(0, P.probe_radius + 1)]:
            other[k] ^= np.uint64(1) << np.uint64(b)
    lo, hi = np.concatenate([base, other]), np.zeros(800, dtype="<u8")
    n = np.concatenate([np.arange(400) + 10**6, np.arange(400) + 10**6]).astype(np.int32)
    parts = sh.group_bits(np.eye(64), m)
    hists = [np.bincount(sh.values(lo, p), minlength=1 << len(p)).astype(float) for p in parts]
    plan = sh.allocate(hists, parts, 800.0, P)
    assert sum(plan.thresholds) >= P.probe_radius - m + 1
    a, b = sh.link(sh.probe_records(lo, hi, n, plan), P)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[root(x)] = root(y)
    node = sh.node_of(lo, hi, n).tolist()
    assert all(root(node[k]) == root(node[k + 400]) for k in range(400))


def test_candidate_counts_are_exact():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 64, 300)
    rings = sh.ring_counts(np.bincount(v, minlength=64).astype(float), 6, 3)
    want = [sum(bin(int(a) ^ int(b)).count("1") == d for i, a in enumerate(v) for b in v[:i]) for d in range(4)]
    assert np.allclose(rings, want)


def test_bits_are_grouped_once():
    rng = np.random.default_rng(0)
    c = rng.random((64, 64))
    parts = sh.group_bits((c + c.T) / 2, 7)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {9, 10}


def test_small_blocks_change_nothing():
    rng = np.random.default_rng(3)
    lo = rng.integers(0, 2**63, 60, dtype=np.int64).astype("<u8")
    lo = np.concatenate([lo, lo ^ np.uint64(5), lo ^ np.uint64(1 << 40)])
    r = np.zeros(len(lo), dtype=sh.RECORD)
    r["lo"], r["n"] = lo, 50
    pairs = lambda block: sorted((int(i), int(j)) for a, b in sh.in_blocks(r, r, P, block) for i, j in zip(a, b))
    assert pairs(4) == pairs(1 << 20) and len(pairs(4)) >= 3 * len(lo)


def components_of(pairs, size):
    a = np.concatenate([np.empty(0, np.int64), *(i for i, _ in pairs)])
    b = np.concatenate([np.empty(0, np.int64), *(j for _, j in pairs)])
    return sh.min_labels(a, b, size)


@pytest.mark.parametrize("bits,share", [(3, 1.0), (6, 0.5), (9, 0.9), (14, 0.7)])
def test_stars_connect_what_all_pairs_connect(bits, share):
    """Groups around a few centres, tight and loose, among strangers; both sides differ, and lengths too."""
    rng = np.random.default_rng(bits)
    n = 1500
    r = np.zeros(n, dtype=sh.RECORD)
    centres = rng.integers(0, 2**63, 3, dtype=np.int64).astype("<u8")
    r["lo"] = np.where(rng.random(n) < share, centres[rng.integers(0, 3, n)], rng.integers(0, 2**63, n, dtype=np.int64).astype("<u8"))
    for k in range(n):
        for b in rng.permutation(64)[: rng.integers(0, bits + 1)]:
            r["lo"][k] ^= np.uint64(1) << np.uint64(b)
        for b in rng.permutation(64)[: rng.integers(0, bits + 1)]:
            r["hi"][k] ^= np.uint64(1) << np.uint64(b)
    r["n"] = rng.integers(80, 120, n)
    stars, plain = list(sh.cell_pairs(r, n, P, large=20)), list(sh.cell_pairs(r, n, P, large=n))
    assert (components_of(stars, n) == components_of(plain, n)).all()
    assert all((np.bitwise_count(r["lo"][i] ^ r["lo"][j]) <= P.probe_radius).all() for i, j in stars)


def test_hot_cells_are_cut(spark):
    """A plan with cells far over a bucket finds the same groups; no part's load grows with the cell."""
    rows = corpus(5)
    every = sh.codes(spark.createDataFrame(rows, "doc_id long, text string"))
    uniq = every.select("node", "lo", "hi", "n").distinct()
    tight = sh.SimHashParams(bucket_records=20)
    plan = sh.make_plan(uniq, tight)
    assert plan.hot_keys and min(plan.hot_parts) >= 3
    got = {(r.node, r.label) for r in sh.components(sh.edges(uniq, plan, tight)).collect()}
    assert got == {(r.node, r.label) for r in sh.components(sh.edges(uniq, sh.make_plan(uniq, P), P)).collect()} and got
    code = [(r.lo, r.hi, r.n) for r in uniq.collect()]
    lo, hi, n = (np.array(x) for x in zip(*code))
    r, salt = sh.spread(sh.probe_records(lo.view("<u8"), hi.view("<u8"), n.astype(np.int32), plan), plan)
    _, load = np.unique(np.stack([(r["key"] & ~sh.OWN).astype(np.uint64), salt]), axis=1, return_counts=True)
    assert load.max() < 2 * 3 * 20


@pytest.mark.parametrize("radius", [0, 2, 3, 4, 7])
def test_small_radii(spark, radius):
    rows = corpus(2)[:80]
    params = sh.SimHashParams(probe_radius=radius)
    uniq = sh.codes(spark.createDataFrame(rows, "doc_id long, text string")).select("node", "lo", "hi", "n").distinct()
    assert sum(sh.make_plan(uniq, params).thresholds) >= radius - len(sh.make_plan(uniq, params).parts) + 1


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {(r.node, r.label) for r in sh.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(k, 1) for k in range(2, 61)} | {(k, 100) for k in (101, 102, 103)}


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string")
    left = [r.doc_id for r in sh.drop_near_copies(docs).collect()]
    gone = {d for g in brute(rows) for d in g[1:]}
    assert sorted(left) == sorted({d for d, _ in rows} - gone)


def test_edges(spark, edge_docs, empty_docs):
    found = sh.near_copies(edge_docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(5, 4)}
    left = sh.drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns and dict(left.dtypes) == dict(edge_docs.dtypes)
    rows = left.collect()
    assert sum(1 for r in rows if r.doc_id is None) == 2
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [-9, 1, 2, 3, 4, 4, 6, 7, 8]
    assert sh.near_copies(empty_docs).count() == 0 and sh.drop_near_copies(empty_docs).count() == 0


def test_hot_group(spark):
    rng = random.Random(8)
    text = sentence(rng, 200)
    rows = [(k, copies(rng, text, k % 4)) for k in range(400)] + [(1000 + k, sentence(rng, 200)) for k in range(50)]
    found = sh.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 399 and {r.kept_doc_id for r in found} == {0}

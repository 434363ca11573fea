import heapq

import numpy as np
import pytest

from pagewright.llm import embedding_dedup as ed

P = ed.MultiIndexParams()


def vectors(seed=1, n=1500, dim=32, copies=400, cosine=0.955):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=(copies, dim))
    base = x[:copies]
    away -= (away * base).sum(axis=1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = rng.uniform(cosine, 0.999, copies)[:, None]
    return np.concatenate([x, c * base + np.sqrt(1 - c * c) * away]).astype(np.float32)


def pairs(groups):
    return {(k, v) for k, v in groups}


def brute(x, cosine=P.cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = list(range(len(u)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for i, j in zip(*np.nonzero(np.triu(u @ u.T >= cosine, 1))):
        a, b = sorted((root(int(i)), root(int(j))))
        label[b] = a
    return {(k, root(k)) for k in range(len(u)) if root(k) != k}


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_against_brute_force(spark, seed):
    x = vectors(seed)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    params = ed.MultiIndexParams(vectors_per_cell=20)
    got = {(r.vec_id, r.kept_vec_id) for r in ed.near_copies(table, params).collect()}
    want = brute(x)
    assert got <= want
    assert len(got) >= 0.95 * len(want) and len(want) == 400


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    cells = ed.traverse(a, b, 63)
    assert len(set(cells)) == 63
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == heapq.nsmallest(63, [p + q for p in a for q in b])
    assert ed.traverse(a, b, 5) == cells[:5]


def test_edges(spark):
    x = vectors(3, 300, 8, 0)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(None, x[0].tolist(), 1), (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [1.0, 2.0], 1)]
    rows += [(905, x[5].tolist(), 1), (905, x[5].tolist(), 1), (5, x[5].tolist(), 1), (906, (x[5] * 3).tolist(), 1), (907, [None] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = {(r.vec_id, r.kept_vec_id) for r in ed.near_copies(table).collect()}
    want = brute(x) | {(905, 5), (906, 5)}
    assert {(a, b) for a, b in got if a >= 900} == {(905, 5), (906, 5)}
    assert len(got & want) >= 0.95 * len(want)
    assert ed.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_vector(spark):
    assert ed.near_copies(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")).count() == 0


def test_hot_group(spark):
    x = vectors(4, 400, 16, 0)
    rng = np.random.default_rng(0)
    hot = x[7] + rng.normal(size=(500, 16)) * 0.01
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, hot.astype(np.float32)]))]
    got = {(r.vec_id, r.kept_vec_id) for r in ed.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert {(k, 7) for k in range(400, 900)} <= got


def test_every_dimension_is_searched(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for dim, n in ((16, 200), (5, 30), (1, 2)):
        x = rng.normal(size=(n, dim)).astype(np.float32)
        for v in x:
            rows.append((f"k{k:04d}", v.tolist(), "x"))
            k += 1
    rows += [("z1", (np.array(rows[0][1]) * 1.001 + 1e-4).tolist(), "x"), ("z2", (np.array(rows[201][1]) + 1e-4).tolist(), "x"), ("z3", [7.0], "x"), ("a0", [3.0], "x")]
    got = {(r.vec_id, r.kept_vec_id) for r in ed.near_copies(spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string")).collect()}
    assert {("z1", "k0000"), ("z2", "k0201")} <= got and ("z3", "a0") in got


@pytest.mark.parametrize("noise,share", [(0.02, 0.9), (0.1, 0.6), (0.3, 1.0)])
def test_stars_connect_what_all_pairs_connect(noise, share):
    from pagewright.llm.simhash import min_labels

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 12))
    x = np.where(rng.random(900)[:, None] < share, centres[rng.integers(0, 3, 900)], rng.normal(size=(900, 12)))
    x = x + rng.normal(size=x.shape) * noise * rng.random(900)[:, None]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)

    def label(large):
        pairs = list(ed.cell_pairs(x, 900, 0.95, large))
        return min_labels(np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]), 900)

    assert (label(10) == label(900)).all()


def test_full_cells_are_cut(spark):
    x = vectors(6, 600, 16, 200)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    cut = {tuple(r) for r in ed.near_copies(table, ed.MultiIndexParams(bucket_records=30)).collect()}
    assert cut == {tuple(r) for r in ed.near_copies(table).collect()} and len(cut) > 150


def test_sql_gives_the_same(spark, tmp_path):
    """On vectors whose copies lie well within the threshold, where the index misses nothing."""
    import duckdb

    x = vectors(7, 300, 24, 80, cosine=0.985)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, x[3].tolist()), (1001, x[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    c = duckdb.connect()
    c.register("embeddings", table.toArrow())
    want = c.sql(ed.ORACLE_SQL)
    assert sorted(map(tuple, ed.near_copies(table).select(*want.columns).collect())) == sorted(want.fetchall())


def test_a_large_sample_needs_no_large_matrix():
    x = np.random.default_rng(1).normal(size=(20_000, 4)).astype(np.float32)
    c = ed.kmeans(x, 64, 2)
    assert c.shape == (64, 4) and (ed.nearest(x, c) == np.argmin(ed.distances(x, c), axis=1)).all()

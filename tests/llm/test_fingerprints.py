import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import fingerprints as fp

from .conftest import sentence

P = fp.ChunkParams()


def slow_cuts(data: bytes, p: fp.ChunkParams) -> list[bytes]:
    """A byte-by-byte rolling gear hash."""
    out, at, h, mask = [], 0, 0, (1 << 32) - 1
    hashes = []
    for b in data:
        h = ((h << 1) + int(fp.GEAR[b])) & mask
        hashes.append(h)
    while at < len(data):
        end = min(len(data), at + p.most)
        for k in range(at + p.least, end):
            bits = p.hard_bits if k <= at + p.normal else p.easy_bits
            if hashes[k - 1] >> (32 - bits) == 0:
                end = k
                break
        out.append(data[at:end])
        at = end
    return out


def test_chunks_match_a_rolling_hash():
    rng = random.Random(2)
    texts = [sentence(rng, n).encode() for n in (1, 5, 40, 300, 2000)] + [b"a" * 5000, b"", b"z" * 64, b"q" * 65]
    together = fp.chunk_many(texts, P)
    for t, c in zip(texts, together):
        assert b"".join(c) == t
        assert c == slow_cuts(t, P)
        assert all(len(x) <= P.most for x in c) and all(len(x) >= P.least for x in c[:-1])


def test_shift_resistance():
    rng = random.Random(3)
    text = sentence(rng, 3000)
    a, b = (fp.fingerprint(c) for c in fp.chunk_many([text.encode(), ("new start " + text).encode()], P))
    assert weight(set(a) & set(b)) / weight(a) > 0.9


def weight(digests):
    return sum(d & 2047 for d in digests)


def brute(rows, p):
    """Multisets of chunks, every class against every other."""
    classes = {}
    for d, t in set(rows):
        if d is not None and t:
            classes.setdefault(tuple(sorted(fp.chunk_many([t.encode()], p)[0])), set()).add(d)
    out = set()
    for a, ids in classes.items():
        total, links = sum(map(len, a)), []
        for b, other in classes.items():
            shared = sum(len(c) * n for c, n in (Counter(a) & Counter(b)).items())
            if a != b and shared >= p.containment * total:
                links.append((-shared, min(other), len(other)))
        best = min(links, default=(None, None, 0))
        for d in ids:
            out.add((d, min(ids), len(ids), total, sum(n for _, _, n in links), best[1], best[0] and -best[0]))
    return out


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    base = [sentence(rng, 400) for _ in range(6)]
    passage = sentence(rng, 150)
    rows = []
    for k in range(90):
        t = rng.choice(base)
        words = t.split()
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(999)
        if k % 4 == 0:
            words = words[: rng.randrange(50, 400)]
        if k % 5 == 0:
            words = sentence(rng, 60).split() + passage.split() + sentence(rng, 10).split()
        rows.append((k, " ".join(words)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (0, rows[0][1])]
    rows += [(300 + k, ("%d " % k) * 90 + passage) for k in range(40)]  # copies with an edit each
    rows += [(400 + k, "same words again " * 300 + str(k)) for k in range(3)]  # a chunk that repeats
    got = {(r.doc_id, r.class_id, r.class_size, r.weight, r.n_links, r.container_id, r.shared_bytes) for r in fp.containment(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows, P)
    assert got == want
    assert len(got) > 120 and sum(r[4] for r in want) > 1000 and any(r[4] == 0 for r in want)


def test_registered_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.class_id, r.class_size, r.weight, r.n_links, r.container_id, r.shared_bytes) for r in fp.containment(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], P)


def test_ids_of_other_types(spark):
    t = sentence(random.Random(9), 200)
    rows = fp.containment(spark.createDataFrame([("b", t), ("a", t), (None, t), ("c", t + " more")], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows} >= {("a", "a", 1), ("b", "a", 1)}


def test_edges(spark, edge_docs, empty_docs, edge_rows):
    rows = fp.containment(edge_docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in {(d, t) for d, t, _ in edge_rows if d is not None and t})
    assert {(r.doc_id, r.class_id, r.class_size) for r in rows if r.class_size > 1} == {(4, 4, 2), (5, 4, 2)}
    assert all(r.n_links == 0 and r.container_id is None and r.containment is None for r in rows)
    assert fp.containment(empty_docs).count() == 0
    with pytest.raises(ValueError):
        fp.containment(empty_docs, fp.ChunkParams(most=4096))


def test_gear_window():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(500)), dtype=np.uint8)
    assert fp.gear_hashes(data)[100] == fp.gear_hashes(data[69:101])[31]

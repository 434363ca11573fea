import random
import struct

import pytest
import zstandard as zstd

from pagewright.llm import warc

from .conftest import sentence

P = warc.WarcParams(frame_bytes=4000, bundle_bytes=20_000)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_every_record_can_be_read_alone(spark):
    rng = random.Random(1)
    rows = [(k, f"http://x.example/{k}", "<html>" + sentence(rng, rng.choice([0, 10, 200, 3000]))) for k in range(120)]
    bundled = warc.bundles(pages(spark, rows).repartition(3), P)
    data = {b.bundle_id: bytes(b.data) for b in bundled.collect()}
    assert len(data) > 3
    seen = {}
    for r in warc.index(bundled).collect():
        raw = warc.read_record(data[r.bundle_id], r.frame, r.offset, r.length)
        head, _, block = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in head
        assert b"Content-Length: %d" % (len(block) - 4) in head
        seen[r.page_id] = block[:-4].decode()
    assert seen == {k: h for k, _, h in rows}


def test_bundle_is_a_plain_zstandard_stream_with_a_footer(spark):
    rows = [(k, None, "a" * 3000) for k in range(9)]
    bundle = warc.bundles(pages(spark, rows).coalesce(1), warc.WarcParams(frame_bytes=4000)).first()
    data = bytes(bundle.data)
    frames = warc.read_seek_table(data)
    assert len(frames) == bundle.n_frames and sum(d for _, _, d in frames) == bundle.plain_bytes
    magic, size = struct.unpack("<II", data[frames[-1][0] + frames[-1][1] :][:8])
    assert magic == warc.SKIPPABLE and size == 8 * len(frames) + 9
    whole = b"".join(zstd.ZstdDecompressor().decompress(data[a : a + c], max_output_size=d) for a, c, d in frames)
    streamed = zstd.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert streamed == whole and whole.count(b"WARC-Type: resource\r\n") == 9 and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_lookup_over_a_table_of_bundles(spark):
    rng = random.Random(2)
    rows = [(f"k{k}", f"http://x.example/{k}", sentence(rng, rng.choice([1, 300]))) for k in range(60)] + [("k1", "http://x.example/1", None)] * 2
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    bundled = warc.bundles(df, P)
    ids = [warc.record_id(*rows[k]) for k in (0, 7, 33, 60)]
    wanted = spark.createDataFrame([(i,) for i in [*ids, ids[0], "urn:uuid:none", None]], "record_id string")
    got = warc.lookup(bundled, wanted).collect()
    assert sorted(r.page_id for r in got) == ["k0", "k1", "k1", "k33", "k7"]
    for r in got:
        assert r.record_id.encode() in bytes(r.record) and b"WARC-Block-Digest: sha1:" in bytes(r.record)
        html = next(h for p, u, h in rows if warc.record_id(p, u, h) == r.record_id)
        assert bytes(r.record).endswith(b"\r\n\r\n" + (html or "").encode() + b"\r\n\r\n")


def test_dates(spark):
    df = spark.createDataFrame([(1, "u", "h", "2020-02-03T04:05:06Z"), (2, "u", "h", None)], "page_id long, url string, html string, seen string")
    data = b"".join(r.record for r in warc.lookup(warc.bundles(df, P, date="seen"), warc.index(warc.bundles(df, P))).collect())
    assert data.count(b"WARC-Date: 2020-02-03T04:05:06Z") == 1 and data.count(b"WARC-Date: " + P.date.encode()) == 1


def test_edges(spark):
    rows = [(None, None, None), (1, "u", None), (1, "u", None), (2, None, ""), (3, "u\nv w", "é" * 300_000), (4, "x", "y")]
    extra = spark.createDataFrame([(*r, "d", 7) for r in rows], "page_id long, url string, html string, data string, frame long").coalesce(1)
    bundled = warc.bundles(extra, P)
    index = warc.index(bundled).collect()
    assert len(index) == 6
    assert len({r.record_id for r in index if r.page_id == 1}) == 1
    assert warc.bundles(pages(spark, []), P).count() == 0
    with pytest.raises(ValueError):
        warc.read_seek_table(b"no table here")


def test_a_task_that_runs_again_gives_the_same(spark):
    rows = [(k, "u", "h" * k) for k in range(200)]
    df = pages(spark, rows).coalesce(2)
    a, b = (sorted((r.bundle_id, bytes(r.data)) for r in warc.bundles(df, P).collect()) for _ in range(2))
    assert a == b

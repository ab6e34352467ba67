from __future__ import annotations

import hashlib
import io
import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import media  # noqa: E402


@pytest.mark.parametrize("form,channels", [("pgm", 1), ("ppm", 3), ("bmp", 1), ("bmp", 3)])
def test_exact_round_trip(form, channels):
    draw = np.random.default_rng(1)
    for height, width in ((1, 1), (3, 5), (24, 24), (7, 10)):
        image = draw.integers(0, 256, (height, width, channels), np.uint8)
        assert (media.decode(media.encode(image, form)) == image).all()


def test_other_netpbm_forms_and_damage():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n9\n3 9\n")[:, :, 0].tolist() == [[3, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3")[0, 0].tolist() == [1, 2, 3]
    assert media.decode(b"P5 1 1 1000\n\x01\x02").dtype == np.uint16
    for bad in (None, b"", b"P5", b"P5 2 2 255\n\x00", b"P5 0 1 255\n", b"BM", b"BM" + b"\x00" * 60, b"GIF89a", b"P6 x y"):
        assert media.decode(bad) is None


def test_resize_is_the_area_mean():
    draw = np.random.default_rng(4)
    image = draw.integers(0, 256, (12, 18, 1)).astype(float)
    assert np.allclose(media.resize(image, 4, 6)[:, :, 0], image.reshape(4, 3, 6, 3).mean((1, 3)))
    got = media.resize(image, 5, 7)[:, :, 0]  # fractional cells, against supersampling
    fine = np.kron(image[:, :, 0], np.ones((5, 7))).reshape(5, 12, 7, 18).mean((1, 3))
    assert np.allclose(got, fine)
    assert np.allclose(media.resize(image[:1, :1], 3, 3), image[0, 0])


@pytest.mark.parametrize("samples", [1, 18, 40, 1 << 20])
def test_strips_of_any_size_give_the_same(monkeypatch, samples):
    image = np.random.default_rng(5).integers(0, 65536, (37, 18, 3), np.uint16)
    want = np.kron(image.astype(float), np.ones((8, 9, 1))).reshape(8, 37, 9, 18, 3).mean((1, 3))
    monkeypatch.setattr(media, "STRIP_SAMPLES", samples)
    assert np.allclose(media.resize(image, 8, 9), want)


def test_headers_that_promise_too_much_are_damage(spark):
    bad = [b"P5 99999999999 99999999999 255\n\x00", b"P4 4294967296 4294967296\n", b"P2 1 1 255\n99999999999999999999999", b"P2 1 1 255\n300", b"P1 999999 999999\n1", b"BM" + b"\x7f" * 60, b"P5 " + b"9" * 5000, b"P2 1 1 255\n-1"]
    assert [media.decode(x) for x in bad] == [None] * len(bad)
    rows = [(k, len(x), bytearray(x)) for k, x in enumerate(bad)] + [(98, None, None), (99, 0, bytearray(b""))]
    got = {r.doc_id: r for r in media.media_digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(r.feature is None and r.payload_sha256 is None and r.tile is None for r in got.values())
    assert got[0].media_sha256 == hashlib.sha256(bad[0]).hexdigest() and got[98].media_bytes is None and got[99].media_bytes == 0


def bmp(bits, width, height, rows, palette=b""):
    head = b"BM" + (54 + len(palette) + len(rows)).to_bytes(4, "little") + bytes(4) + (54 + len(palette)).to_bytes(4, "little")
    fields = ((40, 4), (width, 4), (height, 4), (1, 2), (bits, 2), (0, 4), (len(rows), 4), (0, 4), (0, 4), (len(palette) // 4, 4), (0, 4))
    return head + b"".join(n.to_bytes(size, "little") for n, size in fields) + palette + rows


def test_bmp_of_few_and_of_sixteen_bits():
    grey = b"".join(bytes([v, v, v, 0]) for v in (0, 255))
    assert media.decode(bmp(1, 3, 2, b"\xa0\0\0\0\x40\0\0\0", grey))[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    four = b"".join(bytes([v * 16] * 3 + [0]) for v in range(16))
    assert media.decode(bmp(4, 3, 1, b"\x1f\x20\0\0", four))[:, :, 0].tolist() == [[16, 240, 32]]
    assert media.decode(bmp(16, 2, 1, (31 << 10).to_bytes(2, "little") + (31).to_bytes(2, "little")))[0].tolist() == [[255, 0, 0], [0, 0, 255]]


def test_a_long_text_takes_little_beside_itself():
    import tracemalloc

    image = np.zeros((900_000, 24, 1), np.uint8)
    tracemalloc.start()
    media.difference_hash(image)
    media.npy_tile(image)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # the image has 21.6 MB; a whole integral image would be 172 MB and more
    tracemalloc.stop()


def test_difference_hash_and_tile():
    ramp = np.tile(np.arange(0, 180, 10, dtype=np.uint8), (16, 1))[:, :, None]
    assert media.difference_hash(ramp) == (1 << 64) - 1 and media.difference_hash(ramp[:, ::-1]) == 0
    tile = np.load(io.BytesIO(media.npy_tile(ramp, 8)))
    assert tile.shape == (8, 8, 1) and tile.dtype == np.uint8


def test_payload_padding():
    for n in (0, 1, 575, 576, 577):
        p = media.text_to_payload(b"x" * n)
        assert len(p) % 576 == 0 and len(p) >= max(n, 576) and len(p) - n <= 576 and p == b"x" * n + b"\xff" * (len(p) - n)


def test_documents_and_edge_cases(spark):
    docs = edge.table(spark)
    got = media.media_digests(media.text_images(docs)).collect()
    assert len(got) == len(edge.rows())
    text = {i: (t or "").encode() for i, t, *_ in edge.rows() if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        payload = media.text_to_payload(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode(np.frombuffer(payload, np.uint8).reshape(-1, 24, 1))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r.feature for r in got if r.doc_id in (0, 4)}) == 1
    assert media.media_digests(media.text_images(edge.empty(spark))).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert [tuple(r)[1:] for r in media.features(bad).collect()] == [(None,) * 5] * 2
    assert media.features(media.text_images(docs)).where("tile IS NOT NULL").count() == len(edge.rows())

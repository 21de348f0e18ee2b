import hashlib
import io
import zlib

import numpy as np
import pytest

from docloom.llm import media

TEXTS = [None, "", "a", "x" * 192, "é" * 97, "long " * 30_000, "a"]


def test_round_trip_through_stored_media(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.media_digests(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b" " * (192 - len(data) if not data else -len(data) % 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(media.bytes_to_ppm(payload)).hexdigest()
    assert rows[2].feature == rows[6].feature
    assert media.media_digests(docs.limit(0)).count() == 0


def brute_resize(image, h, w):
    big = np.kron(image, np.ones((h, w)))  # every source pixel h x w times: equal parts then
    H, W = image.shape
    return big.reshape(h, H, w, W).mean((1, 3))


@pytest.mark.parametrize("shape", [(8, 8), (5, 7), (33, 2), (1, 1)])
def test_area_resize_matches_brute_force(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    for h, w in ((3, 4), (8, 9), (32, 32)):
        assert np.allclose(media.area_resize(image, h, w), brute_resize(image, h, w))


def test_formats():
    pixels = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode(b"P2 # note\n2 2\n255\n1 2 3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n2 2\n10\n01").tolist() == [[0, 1], [1, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]


def test_tiles_keep_broken_rows(spark):
    rows = [(1, media.bytes_to_ppm(b"z" * 192)), (2, b"junk"), (3, None), (4, b"P6\n9 9\n255\nxx")]
    got = {r.k: r for r in media.tiles(spark.createDataFrame(rows, "k long, media binary"), "k").collect()}
    assert len(got) == 4 and got[1].error is None and np.load(io.BytesIO(got[1].tile)).shape == (32, 32)
    assert all(got[k].tile is None and got[k].error for k in (2, 3, 4))


def test_strips_sum_to_the_whole_image(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for shape, size in (((1, 64, 3), (32, 32)), ((7, 64, 3), (8, 9)), ((50, 5), (3, 4)), ((33, 64, 3), (32, 32))):
        image = rng.integers(0, 256, shape, np.uint8)
        whole = media.area_resize(image, *size, media.grey)
        monkeypatch.setattr(media, "STRIP", 6)
        assert np.allclose(media.area_resize(image, *size, media.grey), whole)
        monkeypatch.setattr(media, "STRIP", 4096)
        light = media.grey(image).astype(float)
        fine = np.kron(light, np.ones(size))  # each pixel as size pixels, whose blocks of the shape are the areas
        assert np.allclose(whole, fine.reshape(size[0], shape[0], size[1], shape[1]).mean((1, 3)))


def test_a_very_long_text_is_whole(spark):
    text = "long é text " * 200_000
    r = media.media_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    data = media.padded(text.encode())
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(data), hashlib.sha256(data).hexdigest())
    assert media.media_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0

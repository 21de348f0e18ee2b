"""Media columns: Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays, area-resized by integral images, written as NPY tiles and named by
difference hashes. Bytes can be kept losslessly as the samples of a binary PPM.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.stored import stored

#: A PPM of this width has rows of UNIT / ROWS bytes; UNIT bytes are ROWS whole rows.
WIDTH, UNIT = 8, 192

_HEADER = re.compile(rb"P([1-6])(?:\s+|\s*#[^\n]*\n)+")
_NUMBER = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array of (height, width) or (height, width, 3); 8- or 16-bit samples. ValueError for anything else."""
    if not (m := re.match(rb"P([1-6])\s", data)):
        raise ValueError("not a Netpbm image")
    kind, at = int(m[1]), 2
    values = []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (n := _NUMBER.match(data, at)):
            raise ValueError("a Netpbm header is cut short")
        values.append(int(n[1]))
        at = n.end()
    (w, h), top = values[:2], values[2] if len(values) > 2 else 1
    planes = 3 if kind in (3, 6) else 1
    count = w * h * planes
    if kind <= 3:
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]", text) if kind == 1 else text.split()
        samples = np.array([int(x) for x in found[:count]], np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        samples = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if samples.size != count:
        raise ValueError("a Netpbm image is cut short")
    if kind in (1, 4):
        samples = (1 - samples).astype(np.uint8)  # 1 is black
    return samples.reshape((h, w, 3) if planes == 3 else (h, w))


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as P6."""
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-, 24- or 32-bit BMP to (height, width, 3) RGB. ValueError for anything else."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("a BMP of an unsupported kind")
    up, h = h > 0, abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)
        pixels = palette[rows][:, :, 2::-1]
    else:
        pixels = rows.reshape(h, w, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if up else pixels


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) RGB array of bytes as a 24-bit BMP."""
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


#: Rows of an image whose sums are taken at once.
STRIP = 4096


def _integral_rows(image: np.ndarray, wanted: np.ndarray, convert: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The ``wanted`` (ascending) rows of the integral image, which has a row and a column of zeros before the sums.

    Strips of the image are summed one after the other, each on top of the last row of the one before, so no more than a strip is held as numbers wider than its bytes.
    """
    out, carry = [], None
    for start in range(0, image.shape[0], STRIP):
        sums = convert(image[start : start + STRIP]).cumsum(0, dtype=np.float64).cumsum(1)
        sums = np.concatenate((np.zeros_like(sums[:, :1]), sums), 1)
        if carry is None:
            out.append(np.zeros((int((wanted == 0).sum()), *sums.shape[1:])))
        else:
            sums += carry
        own = wanted[(wanted > start) & (wanted <= start + len(sums))]
        out.append(sums[own - start - 1])
        carry = sums[-1]
    return np.concatenate(out)


def _covered(n: int, m: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums along axis 0 over m equal parts of n rows; ``sums`` gives rows of the n + 1 running sums by their places."""
    edges = np.arange(m + 1) * (n / m)
    low = np.minimum(edges.astype(int), n)
    high = np.minimum(low + 1, n)
    places = np.unique(np.concatenate((low, high)))
    rows = sums(places)
    below, above = (rows[np.searchsorted(places, x)] for x in (low, high))
    at = below + (edges - low).reshape(-1, *[1] * (rows.ndim - 1)) * (above - below)
    return at[1:] - at[:-1]


def area_resize(image: np.ndarray, height: int, width: int, convert: Callable[[np.ndarray], np.ndarray] = lambda strip: strip) -> np.ndarray:
    """Mean of the source area under each target pixel, by integral images of strips that ``convert`` is applied to; parts of pixels count by their share."""
    h, w = image.shape[:2]
    rows = _covered(h, height, lambda places: _integral_rows(image, places, convert)).swapaxes(0, 1)
    both = _covered(w, width, lambda places: rows[places]).swapaxes(0, 1)
    return both / ((h / height) * (w / width))


def difference_hash(image: np.ndarray, size: int = 8, convert: Callable[[np.ndarray], np.ndarray] = lambda strip: strip) -> str:
    """Bits of whether a pixel is brighter than its right neighbour, after resizing to (size, size + 1); as hex."""
    small = area_resize(image, size, size + 1, convert)
    bits = small[:, :-1] > small[:, 1:] + 1e-9
    return np.packbits(bits.ravel()).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def padded(data: bytes) -> bytes:
    """``data`` and blanks up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def bytes_to_ppm(payload: bytes) -> bytes:
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(t.as_py() or "").encode() for t in b.column(1)]
        media = pa.array([bytes_to_ppm(padded(t)) for t in texts], pa.binary())
        yield pa.record_batch([b.column(0), pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes as a PPM in column ``media``; null is the empty text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _tile(edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.columns[:-1]
            rows: list[tuple] = []
            for data in b.columns[-1]:
                try:
                    image = decode(data.as_py() or b"")
                    rows.append((*image.shape[:2], npy(np.rint(area_resize(image, edge, edge, grey)).astype(np.uint8)), difference_hash(image, convert=grey), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([*keys, *columns], names=[*b.schema.names[:-1], "height", "width", "tile", "dhash", "error"])

    return run


def tiles(media: DataFrame, key: str, column: str = "media", edge: int = 32) -> DataFrame:
    """Grey NPY tiles of ``edge`` x ``edge`` pixels, their sizes and difference hashes.

    Null, empty or broken images give null values and a message in ``error``; no row is dropped.
    """
    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(_tile(edge), f"{key} {kind}, height int, width int, tile binary, dhash string, error string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data in b.column(2):
            stored_form = data.as_py()
            image = decode(stored_form)
            payload = image.tobytes()
            tile = npy(np.rint(area_resize(image, 32, 32, grey)).astype(np.uint8))
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored_form),
                hashlib.sha256(stored_form).hexdigest(), f"{difference_hash(image, convert=grey)}:{zlib.crc32(tile):08x}", tile,
            ))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.record_batch([b.column(0), b.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media in the shared folder, read it back and describe what was read.

    One row for each row of ``docs``, repeated rows too. Null is the empty text, stored as UNIT blanks. Texts of
    any length are whole. ``tile`` is the 32 x 32 NPY tile, ``feature`` the difference hash and the tile's CRC-32. An empty
    table gives an empty result; other columns are not read.
    """
    kept = stored(store_texts(docs, doc_id, text), "media")
    return kept.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")

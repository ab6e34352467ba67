"""Media columns: Netpbm and BMP images as numpy arrays, resized tiles and difference hashes.

Images are binary columns.  They are decoded to arrays (height, width,
channels), resized by area with integral images (each output sample is the
exact mean of the possibly fractional area that it covers; the integral image
is made strip by strip, so memory doesn't grow with the image), and written as
NPY tiles.  The difference hash compares neighbours in each row of a 9 by 8 grey
tile.  Samples of more than 8 bits keep their width.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import slices
from reviewloom.staging import table

TILE = 16
STRIP_SAMPLES = 1 << 20
#: The registered query's images: grey samples, 24 to a row, in blocks of 24 rows.
WIDTH = 24
UNIT = WIDTH * WIDTH
PAD = b"\xff"


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header after its two magic bytes, and where the samples begin."""
    numbers, at = [], 2
    while len(numbers) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    (width, height, *most), at = _header(data, 2 if bitmap else 3)
    n, top = width * height * channels, 1 if bitmap else most[0]
    if width < 1 or height < 1 or not 0 < top < 65536 or n > 8 * len(data):
        raise ValueError("a Netpbm header without a size, or with more samples than bytes hold")
    if kind == 1:
        flat = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)[:n] - 48
    elif kind in (2, 3):
        flat = np.array(data[at - 1 :].split()[:n], np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() <= top:
            raise ValueError("a sample beyond the greatest")
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else np.dtype(">u2"), n, at)
    if bitmap:
        flat = (1 - flat) * 255  # one is black
    return flat.reshape(height, width, channels).astype(np.uint8 if top < 256 else np.uint16, copy=False)


def _bmp(data: bytes) -> np.ndarray:
    number = lambda at, size: int.from_bytes(data[at : at + size], "little", signed=size == 4)
    start, head, width, height, bits, packed = number(10, 4), number(14, 4), number(18, 4), number(22, 4), number(28, 2), number(30, 4)
    if packed or bits not in (1, 4, 8, 16, 24, 32) or width < 1 or not height:
        raise ValueError("only uncompressed BMP")
    used = (width * bits + 7) // 8
    pitch = (used + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, pitch * abs(height), start).reshape(abs(height), pitch)[:, :used]
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        colours = number(46, 4) or 1 << bits
        if not 0 < colours <= 256:
            raise ValueError("a palette that no 8 bits can name")
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        if bits < 8:
            rows = np.packbits(np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits), axis=2)[:, :width, 0] >> (8 - bits)
        image = palette[rows]
        return image[:, :, :1] if (image == image[:, :, :1]).all() else image
    if bits == 16:  # five bits to a colour
        pixels = np.ascontiguousarray(rows).view("<u2")
        return np.stack([(pixels >> shift & 31) * 255 // 31 for shift in (10, 5, 0)], 2).astype(np.uint8)
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """The samples of a Netpbm (P1 to P6) or BMP image; None for null, other or damaged bytes."""
    try:
        if data and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        return _bmp(data) if data and data[:2] == b"BM" else None
    except (ValueError, IndexError, OverflowError):
        return None


def encode(samples: np.ndarray, form: str = "pgm") -> bytes:
    """8-bit samples (height, width, channels) as "pgm", "ppm" or "bmp" bytes; decode() gives them back exactly."""
    height, width, channels = samples.shape
    if form in ("pgm", "ppm"):
        if channels != (1 if form == "pgm" else 3):
            raise ValueError(f"{form} can't hold {channels} channels")
        return b"".join([b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height), np.ascontiguousarray(samples).data])
    grey = channels == 1
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    pitch = (width * channels + 3) // 4 * 4
    rows = np.zeros((height, pitch), np.uint8)
    rows[:, : width * channels] = samples[::-1, :, ::-1].reshape(height, -1)
    start = 54 + palette.size
    numbers = ((start + rows.size, 4), (0, 4), (start, 4), (40, 4), (width, 4), (height, 4), (1, 2), (8 * channels, 2), (0, 4), (rows.size, 4), (2835, 4), (2835, 4), (256 * grey, 4), (0, 4))
    return b"BM" + b"".join(n.to_bytes(size, "little") for n, size in numbers) + palette.tobytes() + rows.tobytes()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell's area, from the integral image read at fractional corners."""

    def corners(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:  # n cells over size samples
        x = np.linspace(0, size, n + 1)
        low = np.minimum(x.astype(np.int64), size - 1)
        return low, x - low

    rows, columns, channels = image.shape
    (top, down), (left, right) = corners(height, rows), corners(width, columns)
    step = max(1, STRIP_SAMPLES // (columns * channels))
    sums, above = np.zeros((height + 1, columns, channels)), np.zeros((columns, channels))
    for start in range(0, rows, step):
        strip = np.concatenate([above[None], image[start : start + step]], dtype=np.float64)
        np.cumsum(strip, 0, out=strip)
        here = np.nonzero((top >= start) & (top < start + step))[0]
        part = down[here].reshape(-1, 1, 1)
        sums[here] = strip[top[here] - start] * (1 - part) + strip[top[here] - start + 1] * part
        above = strip[-1]
    whole = np.zeros((height + 1, columns + 1, channels))
    np.cumsum(sums, 1, out=whole[:, 1:])
    part = right.reshape(1, -1, 1)
    whole = whole[:, left] * (1 - part) + whole[:, left + 1] * part
    cells = whole[1:, 1:] - whole[:-1, 1:] - whole[1:, :-1] + whole[:-1, :-1]
    return cells / (rows / height * columns / width)


def difference_hash(image: np.ndarray) -> int:
    grey = resize(image, 8, 9).mean(2)
    return int.from_bytes(np.packbits(grey[:, 1:] > grey[:, :-1] + 1e-6).tobytes(), "big")


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to size by size, as the bytes of an NPY file of its own sample type."""
    tile = np.rint(resize(image, size, size)).astype(image.dtype)
    np.save(out := io.BytesIO(), tile, allow_pickle=False)
    return out.getvalue()


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile: int = TILE) -> DataFrame:
    """(id, height, width, channels, dhash, tile) of each image; nulls for null or damaged ones.

    tile is a binary column of NPY files; ``.write`` keeps them.  Repeated rows
    and null ids stay, an empty table gives none, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in slices(batches, "media"):
            rows = []
            for image in map(decode, images):
                rows.append([None] * 5 if image is None else [*image.shape, f"{difference_hash(image):016x}", npy_tile(image, tile)])
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["id", "height", "width", "channels", "dhash", "tile"])

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(run, f"id {kind}, height int, width int, channels int, dhash string, tile binary").withColumnRenamed("id", id_col)


def text_to_payload(text: bytes) -> bytes:
    """The text's bytes and bytes 255 up to a positive multiple of UNIT."""
    return text + PAD * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def text_images(docs: DataFrame, form: str = "pgm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text's padded bytes as the samples of an image, WIDTH to a row.  A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            media = [encode(np.frombuffer(text_to_payload(t), np.uint8).reshape(-1, WIDTH, 1), form) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_digests(media: DataFrame, id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """Digests of the samples read back from ``media`` (id, n_bytes, media), of the stored form, its feature and its tile.

    feature: the difference hash and the CRC-32 of the NPY tile, in hex; tile:
    the NPY file itself.  A null image has nulls, a damaged one has the size and
    digest of what is stored and else nulls.  An image of any size is read
    whole, in one task, beside strips of STRIP_SAMPLES.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def described(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * 7
        of_stored = len(stored), hashlib.sha256(stored).hexdigest()
        image = decode(stored)
        if image is None:
            return None, None, None, *of_stored, None, None
        payload = np.ascontiguousarray(image).reshape(-1).view(np.uint8)
        npy = npy_tile(image, tile)
        return payload.nbytes, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *of_stored, f"{difference_hash(image):016x}-{zlib.crc32(npy):08x}", npy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches, "media"):
            columns = zip(*[described(x.as_py()) for x in batch.column("media")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], names=["id", "n_bytes", *names])

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(text_images(table(spark, sf_dir, "documents")))

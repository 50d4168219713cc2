"""Media columns: pictures in binary columns, decoded to arrays, resized, tiled and fingerprinted.

Netpbm (P5, P6) and BMP (8-bit palette, 24-bit) pictures are decoded to numpy arrays. `area_resize` takes band
sums from integral images, so its cost doesn't depend on the target size; integrals of tall pictures are carried from block to block of
rows. Tiles are NPY files (version 1.0) in binary columns, each with a difference hash.

`payload_media` makes texts grey pictures 64 samples wide: UTF-8 bytes (null: none), then zeros up to
a positive multiple of 64. `store_tiles` decodes such a column and writes each picture's NPY tiles, TILE rows each, to a table in the
shared folder; `stored_features` puts together what it reads back. An empty text is one row of zeros. Null, empty, repeated and very long texts and empty
tables need no special care; ids may be null or repeated, each row gives one row.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm import arrow

WIDTH = 64
#: Rows of a stored tile.
TILE = 256


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for grey, P6 for three channels; 8 bits a sample."""
    height, width = image.shape[:2]
    kind = "P5" if image.ndim == 2 else "P6"
    return f"{kind}\n{width} {height}\n255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


_HEADER = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a binary P5 or P6 picture")
    width, height, top = (int(x) for x in head.groups()[1:])
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples are read")
    shape = (height, width) if head[1] == b"P5" else (height, width, 3)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), head.end()).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed BMP, rows bottom-up: grey with a 256-entry palette, or 24-bit colour."""
    height, width = image.shape[:2]
    bits, palette = (8, np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4)) if image.ndim == 2 else (24, np.zeros((0, 4), np.uint8))
    palette = palette.copy()
    palette[:, 3] = 0
    rows = (image if image.ndim == 2 else image[:, :, ::-1]).reshape(height, -1)[::-1]
    padded = np.zeros((height, (rows.shape[1] + 3) // 4 * 4), np.uint8)
    padded[:, : rows.shape[1]] = rows
    start = 54 + palette.size
    return b"BM" + struct.pack("<IHHI", start + padded.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, padded.size, 2835, 2835, len(palette), 0) + palette.tobytes() + padded.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    start = struct.unpack_from("<I", data, 10)[0]
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8-bit and 24-bit pictures are read")
    used = struct.unpack_from("<I", data, 46)[0]
    stride, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * bits // 8]
    body = body[::-1] if height > 0 else body
    if bits == 24:
        return body.reshape(rows, width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, (used or 256) * 4, 14 + head).reshape(-1, 4)
    colours = palette[body][:, :, 2::-1]
    return colours[:, :, 0] if (colours == colours[:, :, :1]).all() else colours


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _band_means(values: np.ndarray, parts: int, block: int) -> np.ndarray:
    """Means over `parts` equal bands of the first axis, from its integral; edges inside a sample count by share.

    The integral is only held for `block` samples at a time, with what lies before as a carry. Sums of whole numbers are exact.
    """
    edge = np.arange(parts + 1) * (len(values) / parts)
    low = np.minimum(edge.astype(np.int64), len(values) - 1)
    share = (edge - low).reshape(-1, *[1] * (values.ndim - 1))
    at, carry = np.empty((parts + 1, *values.shape[1:])), np.zeros((1, *values.shape[1:]))
    for begin in range(0, len(values), block):
        part = values[begin : begin + block]
        integral = np.concatenate([carry, carry + np.cumsum(part, axis=0, dtype=np.float64)])
        here = np.flatnonzero((low >= begin) & (low < begin + len(part)))
        at[here] = integral[low[here] - begin] + share[here] * part[low[here] - begin]
        carry = integral[-1:]
    return (at[1:] - at[:-1]) * (parts / len(values))


def area_resize(image: np.ndarray, height: int, width: int, block: int = 1 << 14) -> np.ndarray:
    """Each target sample is the mean of the source area below it."""
    out = _band_means(image, height, block)
    return np.swapaxes(_band_means(np.swapaxes(out, 0, 1), width, block), 0, 1)


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """size*size bits in hex: whether each sample of the resized grey picture is less than its right neighbour."""
    grey = image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    small = area_resize(grey, size, size + 1)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(image: np.ndarray, side: int = 32) -> Iterator[tuple[int, int, np.ndarray]]:
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y // side, x // side, image[y : y + side, x : x + side]


def tile_pictures(df: DataFrame, id_col: str, media_col: str, height: int = 64, width: int = 64, side: int = 32) -> DataFrame:
    """Decode pictures, resize each to height x width and give its tiles: id, row, col, npy, dhash.

    A null or unreadable picture gives one row with null row, col, npy and dhash.
    """
    arrow.prepare(df.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())])

    def run(batches):
        for batch in arrow.slices(batches, "media"):
            out: list[tuple] = []
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    image = np.rint(area_resize(decode(media or b""), height, width)).astype(np.uint8)
                except (ValueError, struct.error):
                    out.append((key, None, None, None, None))
                    continue
                out += [(key, r, c, to_npy(t), difference_hash(t)) for r, c, t in tiles(image, side)]
            yield arrow.table(schema, **{n: [x[i] for x in out] for i, n in enumerate(schema.names)})

    rows = df.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{media_col}` as binary) media")
    return rows.mapInArrow(run, "id long, row int, col int, npy binary, dhash string")


def payload_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as the samples of a P5 picture 64 wide."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in arrow.slices(batches):
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.binary())]
            media = []
            for data in raw:
                height = max(1, -(-len(data) // WIDTH))
                media.append(b"P5\n%d %d\n255\n" % (WIDTH, height) + data + bytes(height * WIDTH - len(data)))
            yield arrow.table(schema, doc_id=batch.column(0), n_bytes=[len(x) for x in raw], media=media)

    return arrow.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_tiles(media: DataFrame, stash: arrow.Stash, name: str = "tiles") -> DataFrame:
    """Decode a media column and write doc_id, n_bytes, npy (array of NPY files, from the top) and dhash (one for each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("npy", pa.list_(pa.binary())), ("dhash", pa.list_(pa.string()))])

    def run(batches):
        for batch in arrow.slices(batches, "media"):
            npy, hashes = [], []
            for scalar in batch.column(2):
                image = decode(scalar.as_buffer().to_pybytes())
                parts = [image[k : k + TILE] for k in range(0, len(image), TILE)]
                npy.append([to_npy(x) for x in parts])
                hashes.append([difference_hash(x) for x in parts])
            yield arrow.table(schema, doc_id=batch.column(0), n_bytes=batch.column(1), npy=npy, dhash=hashes)

    return stash.keep(media.mapInArrow(run, "doc_id long, n_bytes long, npy array<binary>, dhash array<string>"), name)


def stored_features(stored: DataFrame) -> DataFrame:
    """Digests of the samples and of the stored bytes of every row of tiles, a difference hash of the whole picture, and that of its first tile.

    Stored tiles whose own hash is another one than that stored with them are an error.
    """
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tiles", pa.int32())])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names[2:]}
            for npy, hashes in zip(batch.column(2), batch.column(3), strict=True):
                files = npy.as_py()
                parts = [from_npy(x) for x in files]
                image = parts[0] if len(parts) == 1 else np.concatenate(parts)
                whole = difference_hash(image)
                first = hashes.as_py()[0]
                if (whole if len(parts) == 1 else difference_hash(parts[0])) != first:
                    raise ValueError("a stored tile has another difference hash than the one beside it")
                payload, digest = image.tobytes(), hashlib.sha256()
                for x in files:
                    digest.update(x)
                for n, v in zip(schema.names[2:], (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), sum(map(len, files)), digest.hexdigest(), whole, len(files)), strict=True):
                    out[n].append(v)
            yield arrow.table(schema, doc_id=batch.column(0), n_bytes=batch.column(1), **out)

    return stored.mapInArrow(run, names)


def text_media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts to pictures, to stored NPY tiles and back: one row of digests and features per document."""
    return stored_features(store_tiles(payload_media(df, id_col, text_col), arrow.Stash(df.sparkSession, "media")))

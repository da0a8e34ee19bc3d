"""Pictures as arrays: decoding by content, EXIF tags from bytes, upright pixels, thumbnails and what a scan derives of them.

PNG and portable pixmaps are decoded here; any other format is a decoder that a caller registers by the first bytes of
its files, such as one of an imaging library, which this package doesn't need.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumika.operators.color import median_cut
from lumika.sources.hooks import perceptual_hash

#: The bytes of a file -> its pixels, (height, width, 3) of bytes.
Decode = Callable[[bytes], np.ndarray]

# The tags of a TIFF directory that are named, by their numbers.
IMAGE_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright"}
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal",
    0x920A: "FocalLength", 0x9291: "SubSecTimeOriginal", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength", 0xA405: "FocalLengthIn35mmFilm", 0xA433: "LensMake", 0xA434: "LensModel",
}
_EXIF_POINTER = 0x8769
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def decode_png(data: bytes) -> np.ndarray:
    """8-bit PNG without interlacing: grey, colour or palette, with or without alpha, which is dropped."""
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None:
        raise ValueError("no picture")
    width, height, depth, kind, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or interlace:
        raise ValueError("only 8 bits without interlacing")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        line = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int64), above, channels)
        out[y], above = line, line
    pixels = out.reshape(height, width, channels)
    if kind == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if kind in (0, 4) else pixels[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG line without its filter: differences to the pixel before, above, their mean, or the nearest of three."""
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
    out = line.copy()
    for x in range(len(out)):
        left, up = (out[x - step] if x >= step else 0), above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = above[x - step] if x >= step else 0
            guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
        out[x] = (out[x] + guess) & 255
    return out


def decode_pixmap(data: bytes) -> np.ndarray:
    """Binary portable pixmap (P6) or greymap (P5)."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, _ = fields
    channels = 3 if data[:2] == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels


#: Decoders by the first bytes of a file.
DECODERS: dict[bytes, Decode] = {b"\x89PNG\r\n\x1a\n": decode_png, b"P6": decode_pixmap, b"P5": decode_pixmap}


def decode(data: bytes, decoders: dict[bytes, Decode] = DECODERS) -> np.ndarray:
    """The pixels of a file by the decoder of the longest matching first bytes."""
    for start in sorted(decoders, key=len, reverse=True):
        if data.startswith(start):
            return np.asarray(decoders[start](data), np.uint8)
    raise ValueError("no decoder for this file")


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """Pixels as the camera was held: EXIF orientations 1 to 8, anything else as it is."""
    turned = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.transpose(1, 0, 2), 6: lambda p: np.rot90(p, -1), 7: lambda p: p[::-1, ::-1].transpose(1, 0, 2), 8: lambda p: np.rot90(p)}
    return np.ascontiguousarray(turned.get(orientation or 1, lambda p: p)(pixels))


def shrink(pixels: np.ndarray, largest: int) -> np.ndarray:
    """Mean of boxes, at most `largest` on the long side, in the same shape; smaller pictures stay."""
    height, width, _ = pixels.shape
    factor = min(1.0, largest / max(height, width))
    if factor == 1.0:
        return pixels
    size = [max(1, int(n * factor)) for n in (height, width)]
    edges = [np.linspace(0, n, m + 1).astype(int) for n, m in zip((height, width), size)]
    total = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), edges[0][:-1], axis=0), edges[1][:-1], axis=1)
    count = np.diff(edges[0])[:, None, None] * np.diff(edges[1])[None, :, None]
    return np.rint(total / count).astype(np.uint8)


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block with a file's EXIF tags, wherever the format keeps it."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data.startswith(b"\x89PNG"):
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    return None


def exif(data: bytes) -> dict[str, str]:
    """EXIF tags of a file as texts, `Image ...` and `EXIF ...`; empty where there are none or they are broken."""
    block = _tiff(data)
    if block is None or len(block) < 8:
        return {}
    order = "<" if block[:2] == b"II" else ">"
    out: dict[str, str] = {}

    def value(kind: int, count: int, at: int) -> str:
        raw = block[at : at + _SIZES.get(kind, 1) * count]
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            pairs = struct.iter_unpack(order + ("II" if kind == 5 else "ii"), raw)
            texts = [str(a) if b in (0, 1) else str(a // b) if a % b == 0 else f"{a}/{b}" for a, b in pairs]
        else:
            texts = [str(x) for (x,) in struct.iter_unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], raw)]
        return texts[0] if len(texts) == 1 else "[" + ", ".join(texts) + "]"

    def directory(at: int, prefix: str, names: dict[int, str], depth: int) -> None:
        for i in range(struct.unpack_from(order + "H", block, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if _SIZES.get(kind, 1) * count > 4:
                place = struct.unpack_from(order + "I", block, place)[0]
            if tag == _EXIF_POINTER and depth == 0:
                directory(struct.unpack_from(order + "I", block, place)[0], "EXIF", EXIF_TAGS, 1)
            elif tag in names and kind in _SIZES and place + _SIZES[kind] * count <= len(block):
                out[f"{prefix} {names[tag]}"] = value(kind, count, place)

    try:
        directory(struct.unpack_from(order + "I", block, 4)[0], "Image", IMAGE_TAGS, 0)
    except (struct.error, KeyError, RecursionError):
        pass
    return out


FEATURES = "path string, width int, height int, orientation int, exif_json string, phash string, dominant_colors string, thumb_small binary, thumb_large binary, error string"


def picture_features(files: DataFrame, decoders: dict[bytes, Decode] = DECODERS, small: int = 256, large: int = 1024, colors: int = 5) -> DataFrame:
    """Of `files(path, content)`, per file: size, orientation, EXIF, perceptual hash, palette and two thumbnails, from one decoding.

    Tags are read even of a file that can't be decoded; such a file has its reason in `error` and an empty palette, the
    sign that it need not be tried again. Hash, palette and thumbnails are of the upright picture.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                data = bytes(content) if content is not None else b""
                tags = exif(data)
                turned = int(tags["Image Orientation"]) if tags.get("Image Orientation", "").isdigit() else None
                row = {"path": path, "orientation": turned, "exif_json": json.dumps(tags) if tags else None, "dominant_colors": "[]"}
                try:
                    pixels = decode(data, decoders)
                    row |= {"height": pixels.shape[0], "width": pixels.shape[1]}
                    pixels = upright(pixels, turned)
                    gray = pixels @ np.array([0.299, 0.587, 0.114])
                    row |= {"phash": perceptual_hash(gray), "dominant_colors": json.dumps(median_cut(shrink(pixels, 128), colors))}
                    row |= {"thumb_small": encode_png(shrink(pixels, small)), "thumb_large": encode_png(shrink(pixels, large))}
                except Exception as error:  # noqa: BLE001 - one bad file must not end a scan
                    row["error"] = str(error) or type(error).__name__
                rows.append(row)
            kinds = {c.split()[0]: "Int32" if c.endswith(" int") else object for c in FEATURES.split(", ")}
            yield pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=kind) for c, kind in kinds.items()})

    return files.select("path", "content").mapInPandas(run, FEATURES)


def crop_pixels(pixels: np.ndarray, box: tuple[int, int, int, int], size: int = 256) -> np.ndarray:
    """The part of a thumbnail within a face's box, at most `size` on its long side."""
    x1, y1, x2, y2 = box
    return shrink(pixels[y1:y2, x1:x2], size)

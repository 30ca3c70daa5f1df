"""[A8] Format and size of images, read from their headers, and whether they are what their names say.

PNG: the first chunk; JPEG: segments up to the first frame header, or to the segment behind it that gives sizes over 65535 (JPEG-LS, ISO 14495-1 C.2.4.1.4); WebP:
lossy, lossless and extended forms. Only headers are read, so a file whose header is sound may still be broken behind it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Formats by extension, the markers of JPEG frames (not of tables, arithmetic conditions and reserved ones), and JPEG-LS' frame and parameters.
FORMATS = {"png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "webp": "WEBP"}
LOSSLESS, PARAMETERS, OVERSIZE = 0xF7, 0xF8, 4
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC} | {LOSSLESS}
ALONE = frozenset(range(0xD0, 0xD8)) | {0x01}


def _png(raw: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", raw[16:24]) if raw[12:16] == b"IHDR" and len(raw) >= 24 else None


def _jpeg(raw: bytes) -> tuple[int, int] | None:
    at, wide = 2, False
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:  # padding
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in FRAMES:
            size = (*struct.unpack(">HH", raw[at + 5 : at + 9])[::-1],) if at + 9 <= len(raw) else None
            if marker != LOSSLESS or size != (0, 0):
                return size
            at, wide = at + 2 + int.from_bytes(raw[at + 2 : at + 4], "big"), True
        elif wide and marker == PARAMETERS and raw[at + 4 : at + 5] == bytes([OVERSIZE]):
            n = raw[at + 5] if at + 5 < len(raw) else 0
            own = raw[at + 6 : at + 6 + 2 * n]
            return (int.from_bytes(own[n:], "big"), int.from_bytes(own[:n], "big")) if n in (2, 3, 4) and len(own) == 2 * n else None
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


def _webp(raw: bytes) -> tuple[int, int] | None:
    kind, body = raw[12:16], raw[20:]
    little = lambda a, b: int.from_bytes(body[a:b], "little")
    if kind == b"VP8X" and len(body) >= 10:
        return little(4, 7) + 1, little(7, 10) + 1
    if kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
        return (little(1, 5) & 0x3FFF) + 1, (little(1, 5) >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
        return little(6, 8) & 0x3FFF, little(8, 10) & 0x3FFF
    return None


def header(raw: bytes) -> tuple[str, int, int] | None:
    """Format, width and height of an image; None if its header isn't one."""
    if raw.startswith(b"\x89PNG\r\n\x1a\n"):
        kind, size = "PNG", _png(raw)
    elif raw.startswith(b"\xff\xd8"):
        kind, size = "JPEG", _jpeg(raw)
    elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        kind, size = "WEBP", _webp(raw)
    else:
        return None
    return (kind, *size) if size and min(size) > 0 else None


def inspected(files: DataFrame) -> DataFrame:
    """files(path, content) of images with format, width, height and error: extension (none of an image), header (no sound one) or format (another than the name says)."""
    schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, named = header(raw or b""), FORMATS.get((path or "").rpartition(".")[2].lower())
                kind, width, height = own or (None, None, None)
                error = "extension" if named is None else "header" if own is None else "format" if kind != named else None
                rows.append({"path": path, "format": kind, "width": width, "height": height, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, format string, width long, height long, error string")

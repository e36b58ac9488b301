"""Reading PDF and image files in Arrow batches.

The text layer needs an optional library; without it every PDF reads as empty,
and the caller's own reader (an OCR service, say) may be handed in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYER_CHARS = 180


def pdf_text(content: bytes) -> tuple[str, int | None]:
    """Text layer and number of pages; a locked or unreadable file has neither."""
    try:
        import io

        from pypdf import PdfReader

        reader = PdfReader(io.BytesIO(content))
        if reader.is_encrypted:
            return "", None
        return "\n".join(p.extract_text() or "" for p in reader.pages), len(reader.pages)
    except Exception:
        return "", None


def extract(files: DataFrame, reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """``(path, text, pages, ocr_performed, error)``: the text layer if it is long enough, else the reader's text if longer.

    An error of one file is a row, not a failure of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    text, pages = pdf_text(content) if content[:4] == b"%PDF" else ("", None)
                    again = reader(content) if reader and len(text.strip()) < LAYER_CHARS else ""
                    better = len(again) > len(text)
                    rows.append((path, again if better else text, pages, better, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, False, str(e)[:500]))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "text", "pages", "ocr_performed", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, pages int, ocr_performed boolean, error string")


def png_has_alpha(content: Column) -> Column:
    """Grey or colour with alpha, read from the header only."""
    return (F.hex(F.substring(content, 1, 4)) == "89504E47") & F.hex(F.substring(content, 26, 1)).isin("04", "06")


def _unfilter(raw: bytes, stride: int, rows: int, step: int) -> bytearray:
    out, before = bytearray(), bytearray(stride)
    for r in range(rows):
        kind, line = raw[r * (stride + 1)], bytearray(raw[r * (stride + 1) + 1 : (r + 1) * (stride + 1)])
        for i in range(stride if kind else 0):
            a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            if kind == 4:
                p = a + b - c
                guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            else:
                guess = (a, b, (a + b) // 2)[kind - 1]
            line[i] = (line[i] + guess) & 255
        out += line
        before = line
    return out


def flatten_png(content: bytes) -> bytes:
    """A PNG with alpha put on white; any other file, and one that is not understood, as it is."""
    try:
        if content[:8] != b"\x89PNG\r\n\x1a\n":
            return content
        at, chunks = 8, []
        while at < len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            chunks.append((kind, content[at + 8 : at + 8 + n]))
            at += 12 + n
        width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
        if colour not in (4, 6) or depth not in (8, 16) or interlace:
            return content
        import numpy as np

        channels, size = (2, 4)[colour == 6], depth // 8
        raw = zlib.decompress(b"".join(d for k, d in chunks if k == b"IDAT"))
        flat = _unfilter(raw, width * channels * size, height, channels * size)
        pixels = np.frombuffer(bytes(flat), dtype=">u1" if size == 1 else ">u2").reshape(height, width, channels).astype(np.uint64)
        top = (1 << depth) - 1
        alpha = pixels[..., -1:]
        mixed = ((pixels[..., :-1] * alpha + top * (top - alpha) + top // 2) // top).astype(">u1" if size == 1 else ">u2")
        lines = b"".join(b"\0" + mixed[y].tobytes() for y in range(height))

        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        head = struct.pack(">IIBBBBB", width, height, depth, colour - 4, 0, 0, 0)
        return content[:8] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    except Exception:
        return content


def flatten_images(files: DataFrame) -> DataFrame:
    """``content`` of images with alpha flattened; only those pass through Python."""

    @F.pandas_udf("binary")
    def flat(contents):
        return contents.map(flatten_png, na_action="ignore")

    alpha = png_has_alpha(F.col("content"))
    return files.withColumn("content", F.when(alpha, flat(F.when(alpha, F.col("content")))).otherwise(F.col("content")))

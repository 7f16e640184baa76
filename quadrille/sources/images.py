"""Decoding of small raster and picture files where no imaging library is at hand.

`tiff` reads uncompressed or deflated strip TIFFs of one sample a pixel with their scale and tie point; `png` reads
8-bit, non-interlaced pictures. Other decoders with the same signature can be passed to `decoded`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RASTER = "struct<height:int,width:int,left:double,bottom:double,right:double,top:double,data:array<float>>"
# Fixed values of the formats: TIFF field types (code to struct code and size), sample formats, PNG channels.
FIELDS = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def tiff(content: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    (at,) = struct.unpack_from(order + "I", content, 4)
    tags = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind in FIELDS:
            code, size = FIELDS[kind]
            place = at + 10 + 12 * i if n * size <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", content, place)
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    packing, kind = tags.get(259, (1,))[0], KINDS[tags.get(339, (1,))[0]]
    if packing not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
        raise ValueError("only plain or deflated rasters of one sample are read")
    strips = [content[a : a + n] for a, n in zip(tags[273], tags[279])]
    flat = b"".join(s if packing == 1 else zlib.decompress(s) for s in strips)
    data = np.frombuffer(flat, np.dtype(f"{order}{kind}{bits // 8}"), width * height).reshape(height, width)
    if tags.get(317, (1,))[0] == 2:
        data = np.cumsum(data, 1, dtype=data.dtype)
    scale, tie = tags.get(33550, (1.0, 1.0)), tags.get(33922, (0, 0, 0, 0.0, 0.0, 0))
    left, top = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
    return {"height": height, "width": width, "left": left, "bottom": top - height * scale[1], "right": left + width * scale[0], "top": top, "data": data.astype(np.float32).ravel().tolist()}


def png(content: bytes) -> np.ndarray:
    """Pixels as height x width x channels."""
    at, packed, head = 8, b"", None
    while at < len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        if name == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", content, at + 8)
        elif name == b"IDAT":
            packed += content[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, bits, colour, _, _, interlaced = head
    if bits != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("only 8-bit pictures without interlacing are read")
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n).astype(int)
    out = np.zeros((height + 1, width * n + n), int)  # a row above and a pixel left of zeros
    for y in range(height):
        kind, raw, up, row = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if kind == 2:
            row[n:] = raw + up[n:] & 255
            continue
        for x in range(width * n):
            a, b, c = row[x], up[x + n], up[x]
            near = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(a + b - c - v)))[kind]
            row[x + n] = raw[x] + near & 255
    return out[1:, n:].reshape(height, width, n).astype(np.uint8)


def decoded(content: Column, decoder: Callable[[bytes], dict] = tiff) -> Column:
    """Binary column to a raster struct."""

    @F.pandas_udf(RASTER)
    def run(v: pd.Series) -> pd.DataFrame:
        names = ["height", "width", "left", "bottom", "right", "top", "data"]
        return pd.DataFrame([decoder(bytes(x)) if x is not None else dict.fromkeys(names) for x in v], columns=names)

    return F.when(content.isNotNull(), run(content))


PICTURE = "struct<height:int,width:int,channels:int,data:array<int>>"


def picture(content: Column, decoder: Callable[[bytes], np.ndarray] = png) -> Column:
    """Binary column of pictures to a struct with all samples, row by row, pixel by pixel; null stays null."""

    @F.pandas_udf(PICTURE)
    def run(v: pd.Series) -> pd.DataFrame:
        found = [None if x is None else decoder(bytes(x)) for x in v]
        rows = [(None,) * 4 if p is None else (*p.shape, p.astype(int).ravel().tolist()) for p in found]
        return pd.DataFrame(rows, columns=["height", "width", "channels", "data"])

    return F.when(content.isNotNull(), run(content))


def write_tiff(data: np.ndarray, left: float = 0.0, top: float = 0.0, pixel: float = 1.0) -> bytes:
    """An uncompressed one-strip raster with its position; float32, int16 or uint16."""
    kind = {"f": 3, "i": 2, "u": 1}[data.dtype.kind]
    body = np.ascontiguousarray(data.astype(data.dtype.newbyteorder("<"))).tobytes()
    tags = [(256, 4, (data.shape[1],)), (257, 4, (data.shape[0],)), (258, 3, (8 * data.itemsize,)), (259, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (279, 4, (len(body),)), (339, 3, (kind,)), (33550, 12, (pixel, pixel, 0.0)), (33922, 12, (0.0, 0.0, 0.0, left, top, 0.0))]
    at = 8 + len(body)
    tail_at, tail, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, field, values in tags:
        code, size = FIELDS[field]
        packed = struct.pack(f"<{len(values)}{code}", *values)
        if len(packed) > 4:
            place, tail = struct.pack("<I", tail_at + len(tail)), tail + packed
        else:
            place = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, field, len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + tail


def write_png(pixels: np.ndarray) -> bytes:
    """An 8-bit picture without line filters, from height x width x channels."""
    height, width, n = pixels.shape
    colour = {channels: code for code, channels in CHANNELS.items()}[n]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.zeros((height, 1 + width * n), np.uint8)
    lines[:, 1:] = pixels.reshape(height, width * n)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")

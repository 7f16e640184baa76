"""Geometries in well-known binary, as GeoParquet stores them: `shape` and `binary` for all, `geometry` for points and outer rings."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

GEOMETRY = "struct<kind:string,points:array<struct<x:double,y:double>>>"
KINDS = {1: "Point", 3: "Polygon"}  # fixed values of the format


def _read(content: bytes) -> dict:
    order = "<" if content[0] else ">"
    (code,) = struct.unpack_from(order + "I", content, 1)
    if code not in KINDS:
        raise ValueError(f"geometries of kind {code} are not read")
    at, n = (5, 1) if code == 1 else (13, struct.unpack_from(order + "I", content, 9)[0])
    points = np.frombuffer(content, order + "f8", 2 * n, at).reshape(-1, 2)
    return {"kind": KINDS[code], "points": [{"x": float(x), "y": float(y)} for x, y in points]}


def geometry(content: Column) -> Column:
    """Binary to struct<kind, points>: the point, or the polygon's outer ring; null stays null."""

    @F.pandas_udf(GEOMETRY)
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(bytes(x)) if x is not None else {"kind": None, "points": None} for x in v], columns=["kind", "points"])

    return F.when(content.isNotNull(), run(content))


def point(x: Column, y: Column) -> Column:
    """A point as binary."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, p, q) for p, q in zip(a, b)], dtype=object)

    return run(x, y)


SHAPE = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
ALL_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}  # fixed values of the format
CODES = {name: code for code, name in ALL_KINDS.items()}


def _body(content: bytes, at: int) -> tuple[int, list, int]:
    """Code, parts and end of the geometry at a place."""
    order = "<" if content[at] else ">"
    (code,) = struct.unpack_from(order + "I", content, at + 1)
    flags, code, at = code >> 28, code & 0x0FFFFFFF, at + 5
    more, kind = code // 1000 % 4, code % 1000  # 1000: with z, 2000: with m, 3000: both; flags say the same
    size = 2 + ((more & 1) | (flags >> 3 & 1)) + ((more >> 1) | (flags >> 2 & 1))
    at += 4 * (flags >> 1 & 1)  # a reference system

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", content, at - 4)[0]

    def line(n: int) -> list[tuple[float, float]]:
        nonlocal at
        numbers = np.frombuffer(content, order + "f8", size * n, at).reshape(-1, size)
        at += 8 * size * n
        return [(x, y) for x, y in numbers[:, :2].tolist()]

    if kind == 1:
        return kind, [[line(1)]], at
    if kind == 2:
        return kind, [[line(count())]], at
    if kind == 3:
        return kind, [[line(count()) for _ in range(count())]], at
    if kind not in ALL_KINDS:
        raise ValueError(f"geometries of kind {kind} are not read")
    parts = []
    for _ in range(count()):
        _, own, at = _body(content, at)
        parts += own
    return kind, parts, at


def parsed(content: bytes) -> tuple[str, list]:
    """Kind and parts of a geometry: each part is a list of rings, each ring a list of (x, y).

    A point is a part with a ring of one point, a line a part with one ring; the rings of a polygon after the first are
    holes. Heights and measures are left out.
    """
    kind, parts, _ = _body(bytes(content), 0)
    return ALL_KINDS[kind], parts


def packed(kind: str, parts: list) -> bytes:
    """The inverse of `parsed`, little-endian."""
    code = CODES[kind]
    head = struct.pack("<BI", 1, code)
    line = lambda ring: b"".join(struct.pack("<dd", x, y) for x, y in ring)
    if code > 3:
        return head + struct.pack("<I", len(parts)) + b"".join(packed(ALL_KINDS[code - 3], [p]) for p in parts)
    if code == 1:
        return head + line(parts[0][0])
    if code == 2:
        return head + struct.pack("<I", len(parts[0][0])) + line(parts[0][0])
    return head + struct.pack("<I", len(parts[0])) + b"".join(struct.pack("<I", len(r)) + line(r) for r in parts[0])


def shape(content: Column) -> Column:
    """Binary to struct<kind, parts> (see `parsed`): points, lines and polygons with holes, single or multiple; null stays null."""
    kind = to_arrow_type(StructType.fromDDL(f"s {SHAPE}")[0].dataType)

    @F.arrow_udf(SHAPE)
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for x in v.to_pylist():
            name, parts = (None, None) if x is None else parsed(x)
            rows.append(name and {"kind": name, "parts": [[[{"x": a, "y": b} for a, b in ring] for ring in rings] for rings in parts]})
        return pa.array(rows, kind)

    return run(content)


def binary(geometry: Column) -> Column:
    """struct<kind, parts> to binary; null stays null."""

    @F.arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        points = lambda ring: [(p["x"], p["y"]) for p in ring]
        return pa.array([None if s is None else packed(s["kind"], [[points(r) for r in rings] for rings in s["parts"]]) for s in v.to_pylist()], pa.binary())

    return run(geometry)


def polygon(*rings: Column) -> Column:
    """A polygon (struct<kind, parts>) from its outer ring and holes, arrays of struct<x, y>."""
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(*rings)).alias("parts"))

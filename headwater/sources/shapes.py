"""ESRI shapefiles: geometries (.shp) and attributes (.dbf) as rows, joined by file and record number.

Spark's ``binaryFile`` reads the files, so any store will do; each file is parsed by one task, in slices of records (the format itself
ends at two gigabytes). Attributes are VARIANT objects of text, numbers and booleans. Heights and measures are left out.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types without heights; with heights they are ten more, with measures twenty more.
KINDS = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}
MAGIC, VERSION = 9994, 1000
SHAPE = "stem string, number long, kind string, parts array<array<struct<x: double, y: double>>>"
#: Records of one batch that goes back to Spark.
SLICE = 2048

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.list_(_POINT))


class BadShapefile(ValueError):
    """A file that breaks the format."""


def _parts(kind: int, body: bytes) -> list[np.ndarray]:
    """The (n, 2) points of each part of a record's content after its type."""
    if kind == 0:
        return []
    if kind == 1:
        return [np.frombuffer(body, "<f8", 2).reshape(1, 2)]
    if kind == 8:
        (n,) = struct.unpack_from("<i", body, 32)
        return [np.frombuffer(body, "<f8", 2 * n, 36).reshape(-1, 2)]
    n_parts, n = struct.unpack_from("<ii", body, 32)
    first = np.frombuffer(body, "<i4", n_parts, 40)
    points = np.frombuffer(body, "<f8", 2 * n, 40 + 4 * n_parts).reshape(-1, 2)
    return np.split(points, first[1:])


def records(content: bytes) -> Iterator[tuple[int, str, list[np.ndarray]]]:
    """(number from 1, kind, parts) of a .shp file, in order."""
    if len(content) < 100 or struct.unpack_from(">i", content)[0] != MAGIC or struct.unpack_from("<i", content, 28)[0] != VERSION:
        raise BadShapefile("no shapefile header")
    at, end = 100, min(len(content), 2 * struct.unpack_from(">i", content, 24)[0])
    while at + 8 <= end:
        number, words = struct.unpack_from(">ii", content, at)
        if words < 2 or at + 8 + 2 * words > len(content):
            raise BadShapefile(f"record {number} goes beyond the file")
        (kind,) = struct.unpack_from("<i", content, at + 8)
        plain = kind if kind in KINDS else kind % 10 if kind in (11, 13, 15, 18, 21, 23, 25, 28) else None
        if plain is None:
            raise BadShapefile(f"record {number} has the unknown type {kind}")
        try:
            yield number, KINDS[plain], _parts(plain, content[at + 12 : at + 8 + 2 * words])
        except (ValueError, struct.error) as e:
            raise BadShapefile(f"record {number} is too short") from e
        at += 8 + 2 * words


def _value(kind: str, text: str) -> str | float | int | bool | None:
    text = text.strip().strip("\0")
    if not text or set(text) == {"*"}:
        return None
    if kind in "NF":
        return int(text) if text.lstrip("+-").isdigit() else float(text)
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return dt.datetime.strptime(text, "%Y%m%d").date().isoformat() if kind == "D" else text


def attributes(content: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, dict]]:
    """(number from 1, {field: value}) of a .dbf file; deleted rows keep their number and have no fields."""
    if len(content) < 32:
        raise BadShapefile("no attribute header")
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while at + 32 <= head and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding), chr(content[at + 11]), content[at + 16]))
        at += 32
    if size != 1 + sum(f[2] for f in fields) or len(content) < head + n * size:
        raise BadShapefile("the attribute rows do not fit their header")
    for i in range(n):
        row, place, out = content[head + i * size : head + (i + 1) * size], 1, {}
        if row[:1] != b"*":
            for name, kind, width in fields:
                out[name] = _value(kind, row[place : place + width].decode(encoding))
                place += width
        yield i + 1, out


def _sliced(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE:
            yield held
            held = []
    if held:
        yield held


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stem, content in zip(batch.column("stem"), batch.column("content"), strict=True):
            for part in _sliced(records(content.as_py())):
                parts = [[[{"x": x, "y": y} for x, y in p.tolist()] for p in each] for _, _, each in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stem.as_py()] * len(part)), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part]), pa.array(parts, _PARTS)], ["stem", "number", "kind", "parts"]
                )


def _properties(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, content in zip(batch.column("stem"), batch.column("content"), strict=True):
                for part in _sliced(attributes(content.as_py(), encoding)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stem.as_py()] * len(part)), pa.array([r[0] for r in part], pa.int64()), pa.array([json.dumps(r[1]) for r in part])], ["stem", "number", "json"]
                    )

    return run


def parse(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(stem, number, kind, parts, properties) of files (path, content): a row for each shape, with null properties where there is no attribute file."""
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    stem = F.regexp_replace("path", r"\.[^.]*$", "").alias("stem")
    shapes = files.where(ending == "shp").select(stem, "content").mapInArrow(_shapes, SHAPE)
    held = files.where(ending == "dbf").select(stem, "content").mapInArrow(_properties(encoding), "stem string, number long, json string")
    return shapes.join(held, ["stem", "number"], "left").select("stem", "number", "kind", "parts", F.parse_json("json").alias("properties"))


def read_shapes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """As ``parse``, of the files of a folder or glob, each in a row of its own until it is parsed."""
    files = spark.read.format("binaryFile").load(path)
    return parse(files.where(F.lower("path").rlike(r"\.(?:shp|dbf)$")).select("path", "content"), encoding)


# The same format written: one file from the rows of one group, for results that other tools read.


def pack_shapes(kind: str, shapes: list[list[list[tuple[float, float]]]]) -> bytes:
    """A .shp file of shapes of one kind; a shape without points is Null."""
    code = {v: k for k, v in KINDS.items()}[kind]
    body, low, high = [], np.full(2, np.inf), np.full(2, -np.inf)
    for number, parts in enumerate(shapes, 1):
        flat = np.array([p for part in parts for p in part], "<f8").reshape(-1, 2)
        if not len(flat):
            content = struct.pack("<i", 0)
        else:
            low, high = np.minimum(low, flat.min(0)), np.maximum(high, flat.max(0))
            box = struct.pack("<4d", *flat.min(0), *flat.max(0))
            if code == 1:
                content = struct.pack("<i", 1) + flat[0].tobytes()
            elif code == 8:
                content = struct.pack("<i", 8) + box + struct.pack("<i", len(flat)) + flat.tobytes()
            else:
                starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
                content = struct.pack("<i", code) + box + struct.pack("<ii", len(parts), len(flat)) + starts.tobytes() + flat.tobytes()
        body.append(struct.pack(">ii", number, len(content) // 2) + content)
    whole = b"".join(body)
    bounds = [*low, *high] if np.isfinite(low).all() else [0.0] * 4
    return struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, 50 + len(whole) // 2) + struct.pack("<ii", VERSION, code) + struct.pack("<8d", *bounds, 0, 0, 0, 0) + whole


def pack_attributes(fields: list[tuple[str, str, int]], rows: list[tuple], encoding: str = "utf-8") -> bytes:
    """A .dbf file of fields (name of at most ten letters, kind C, N, F, L or D, width) and their rows; null is blank, and text that is too wide an error."""
    out = [struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(w for _, _, w in fields))]
    out += [struct.pack("<11sc4xBB14x", name.encode(encoding), kind.encode(), width, 0) for name, kind, width in fields]
    out.append(b"\r")
    for row in rows:
        out.append(b" ")
        for (name, kind, width), v in zip(fields, row, strict=True):
            text = "" if v is None else ("T" if v else "F") if kind == "L" else v.replace("-", "") if kind == "D" else str(v)
            raw = text.encode(encoding)
            if len(raw) > width:
                raise BadShapefile(f"{text!r} is wider than the field {name}")
            out.append(raw.rjust(width) if kind in "NF" else raw.ljust(width))
    return b"".join(out) + b"\x1a"

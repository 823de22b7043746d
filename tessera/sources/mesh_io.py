"""Mesh files: OBJ and STL parsing and writing, annotation JSON, and a Spark data source.

Parsers return errors as values: a bad file gives a row with an ``error`` and no geometry.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .meshes import Mesh

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_INDEX = re.compile(r"[+-]?\d+")
MESH = "mesh_id string, format string, error string, vertices array<struct<x: double, y: double, z: double>>, faces array<struct<v0: bigint, v1: bigint, v2: bigint>>"
LABELS = "jaw string, labels array<int>"
LANDMARKS = "version string, key string, objects array<struct<key: string, class: string, coord: array<double>>>"


def parse_double(token: str) -> float | None:
    """A finite number that takes up the whole token, else None."""
    if not _NUMBER.fullmatch(token):
        return None
    value = float(token)
    return value if np.isfinite(value) else None


class ParseError(ValueError):
    pass


def parse_obj(text: str) -> Mesh:
    """Vertices and fan-triangulated faces; raises ParseError with the line of the first error."""
    points: list[list[float]] = []
    faces: list[tuple[int, int, int]] = []
    for number, line in enumerate(text.split("\n"), 1):
        token = line.split("#", 1)[0].split()
        if not token:
            continue
        if token[0] == "v":
            xyz = [parse_double(t) for t in token[1:4]]
            if len(xyz) < 3 or None in xyz:
                raise ParseError(f"line {number}: bad vertex")
            points.append(xyz)
        elif token[0] == "f":
            if len(token) < 4:
                raise ParseError(f"line {number}: face has fewer than 3 corners")
            ring = [_corner(t, len(points), number) for t in token[1:]]
            faces += [(ring[0], ring[i], ring[i + 1]) for i in range(1, len(ring) - 1)]
    return Mesh(np.array(points).reshape(-1, 3), faces)


def _corner(token: str, count: int, line: int) -> int:
    head = token.split("/", 1)[0]
    if not _INDEX.fullmatch(head):
        raise ParseError(f"line {line}: bad face index")
    i = int(head)
    if i == 0:
        raise ParseError(f"line {line}: face index 0")
    at = i - 1 if i > 0 else count + i
    if not 0 <= at < count:
        raise ParseError(f"line {line}: face index out of range")
    return at


def is_binary_stl(data: bytes) -> bool:
    """By size alone: 84 bytes and 50 per triangle; never by a leading word."""
    return len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]


_TRIANGLE = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])


def parse_stl(data: bytes) -> Mesh:
    """A triangle soup: triangle i owns vertices 3i to 3i+2."""
    if not is_binary_stl(data):
        return _parse_ascii_stl(data.decode("utf-8", "replace"))
    p = np.frombuffer(data, _TRIANGLE, offset=84)["p"].astype(np.float64)
    bad = np.flatnonzero(~np.isfinite(p).all(axis=(1, 2)))
    if len(bad):
        raise ParseError(f"triangle {bad[0]}: non-finite coordinate")
    return Mesh(p.reshape(-1, 3), np.arange(3 * len(p)).reshape(-1, 3))


def _parse_ascii_stl(text: str) -> Mesh:
    lines = text.split("\n")
    tokens = [(t, n) for n, line in enumerate(lines[1:], 2) for t in line.split()]
    if not lines[0].split()[:1] == ["solid"]:
        raise ParseError("line 1: expected 'solid'")
    at, points = 0, []

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens):
            raise ParseError(f"line {len(lines)}: unexpected end of file")
        t, n = tokens[at]
        at += 1
        if expected is not None and t != expected:
            raise ParseError(f"line {n}: expected '{expected}'")
        return t

    def numbers() -> list[float]:
        nonlocal at
        out = []
        for _ in range(3):
            value = parse_double(take())
            if value is None:
                raise ParseError(f"line {tokens[at - 1][1]}: bad number")
            out.append(value)
        return out

    while take() != "endsolid":
        at -= 1
        take("facet")
        take("normal")
        numbers()
        take("outer")
        take("loop")
        for _ in range(3):
            take("vertex")
            points.append(numbers())
        take("endloop")
        take("endfacet")
    return Mesh(np.array(points).reshape(-1, 3), np.arange(len(points)).reshape(-1, 3))


def write_obj(m: Mesh) -> str:
    rows = [f"v {x!r} {y!r} {z!r}" for x, y, z in m.x.tolist()] + [f"f {a + 1} {b + 1} {c + 1}" for a, b, c in m.f.tolist()]
    return "\n".join(rows) + "\n"


def write_stl(m: Mesh) -> bytes:
    out = np.zeros(len(m.f), _TRIANGLE)
    out["p"] = m.x[m.f]
    return bytes(80) + struct.pack("<I", len(m.f)) + out.tobytes()


def parse(data: bytes, format_: str) -> Mesh:
    if format_ == "obj":
        return parse_obj(data.decode("utf-8", "replace"))
    if format_ == "stl":
        return parse_stl(data)
    raise ParseError(f"unknown format: {format_}")


def _row(mesh_id: str, format_: str, data: bytes) -> tuple:
    try:
        m = parse(data, format_)
    except ParseError as e:
        return mesh_id, format_, str(e), None, None
    return mesh_id, format_, None, [dict(zip("xyz", p, strict=True)) for p in m.x.tolist()], [dict(zip(("v0", "v1", "v2"), f, strict=True)) for f in m.f.tolist()]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per OBJ or STL file under a path, keyed by its name without suffix (:data:`MESH`)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"], strict=True):
                stem, _, suffix = p.rsplit("/", 1)[-1].rpartition(".")
                rows.append(_row(stem, suffix.lower(), bytes(content)))
            yield pd.DataFrame(rows, columns=["mesh_id", "format", "error", "vertices", "faces"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{obj,stl,OBJ,STL}").load(path)
    return files.select("path", "content").mapInPandas(run, MESH)


def exploded(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) tables of parsed files without an error."""
    ok = meshes.where("error IS NULL")
    v = ok.select("mesh_id", F.posexplode("vertices").alias("v", "p")).select("mesh_id", F.col("v").cast("bigint").alias("v"), "p.x", "p.y", "p.z")
    f = ok.select("mesh_id", F.posexplode("faces").alias("f", "t")).select("mesh_id", F.col("f").cast("bigint").alias("f"), "t.v0", "t.v1", "t.v2")
    return v, f


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The lines of each mesh's OBJ file in order (mesh_id, line_no, line), composed relationally.

    Numbers are cast to strings, which is the shortest form that reads back exactly.
    """
    v = vertices.select("mesh_id", F.lit(0).alias("part"), F.col("v").alias("i"), F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in "xyz")).alias("line"))
    f = faces.select("mesh_id", F.lit(1), F.col("f"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in ("v0", "v1", "v2"))))
    return v.union(f)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """mesh_id, v, fdi from label files {jaw, labels}."""
    j = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("mesh_id"), F.from_json("value", LABELS).alias("j"))
    return j.select("mesh_id", F.posexplode("j.labels").alias("v", "fdi")).select("mesh_id", F.col("v").cast("bigint").alias("v"), "fdi")


def landmarks(json: DataFrame, cls: str) -> DataFrame:
    """mesh_id, x, y, z of the objects of a class with three coordinates; ``json``: mesh_id, value."""
    o = json.select("mesh_id", F.explode(F.from_json("value", LANDMARKS)["objects"]).alias("o")).where((F.col("o.class") == cls) & (F.size("o.coord") == 3))
    return o.select("mesh_id", *(F.col("o.coord")[k].alias(c) for k, c in enumerate("xyz")))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _MeshReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if spark is None:
            import glob

            return [_File(p) for p in sorted(glob.glob(f"{self.path}/*.obj") + glob.glob(f"{self.path}/*.stl"))]
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return [_File(s.getPath().toUri().getPath()) for s in fs.listStatus(p) if re.search(r"\.(obj|stl)$", s.getPath().getName(), re.I)]

    def read(self, part: _File):
        with open(part.path, "rb") as f:
            data = f.read()
        stem, _, suffix = part.path.rsplit("/", 1)[-1].rpartition(".")
        mesh_id, format_, error, vertices, faces = _row(stem, suffix.lower(), data)
        yield mesh_id, format_, error, [tuple(v.values()) for v in vertices or []], [tuple(v.values()) for v in faces or []]


class MeshSource(DataSource):
    """``spark.read.format("mesh").load(folder)``: for folders that every executor can open.

    Stores that only Spark reads go through :func:`read_files`.
    """

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> str:
        return MESH

    def reader(self, schema) -> DataSourceReader:
        return _MeshReader(self.options["path"])

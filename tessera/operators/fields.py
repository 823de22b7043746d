"""Fields on regular grids of all meshes at once: isosurfaces, trilinear samples, surfaces splatted onto nodes.

A grid is a row (mesh_id, ox, oy, oz, h); node (i, j, k) lies at origin + h (i, j, k). Node tables
are (mesh_id, i, j, k, value), corners of a cell are numbered by their steps: bit 0 is i, bit 1 j, bit 2 k.

Defined cases: nodes with a null or not finite value are absent, and cells that lack a corner have no
surface; a node that comes twice has its greatest value; points and triangles with such a coordinate
take no part; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import cut
from .model import face_positions

#: Nodes a side; three sides, a triangle's number and an edge's direction fit an id of 63 bits.
SIDE = 1 << 19
#: Cells a side of the blocks in which nodes travel: 729 nodes for 512 cells.
BLOCK = 8
_INF = float("inf")


def _case_rows() -> list[tuple]:
    """(signs, t, corners): the triangles of every pattern of signs, bit c being set where corner c is below 0.

    A cell is six tetrahedra around its diagonal, one per order of the axes. Each crossed edge is
    (its corner with fewer steps, the other, the one that is not below 0); triangles face that one's side.
    """
    place = np.array([[c >> a & 1 for a in range(3)] for c in range(8)], float)
    out = []
    for signs in range(1, 255):
        n = 0
        for axes in permutations(range(3)):
            tet = [0, 1 << axes[0], 1 << axes[0] | 1 << axes[1], 7]
            low = [c for c in tet if signs >> c & 1]
            high = [c for c in tet if not signs >> c & 1]
            if not low or not high:
                continue
            # around the cut, neighbouring crossings share a face of the tetrahedron
            rim = [(a, b) for a in low for b in high]
            if len(rim) == 4:
                rim[2], rim[3] = rim[3], rim[2]
            up = place[high].mean(0) - place[low].mean(0)
            for k in range(1, len(rim) - 1):
                t = [rim[0], rim[k], rim[k + 1]]
                p = [(place[a] + place[b]) / 2 for a, b in t]
                if np.cross(p[1] - p[0], p[2] - p[0]) @ up < 0:
                    t[1], t[2] = t[2], t[1]
                out.append((signs, n, *(x for a, b in t for x in (a & b, a | b, b))))
                n += 1
    return out


def _node_id(i: Column, j: Column, k: Column) -> Column:
    return (k * SIDE + j) * SIDE + i


def isosurface(nodes: DataFrame, grids: DataFrame, iso: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) where the field is ``iso``, by marching tetrahedra; faces look towards higher values.

    Values within 1e-10 h of ``iso`` count as on it, and their node is the vertex. Ids follow from grid
    places (a vertex's from its edge, a face's from its cell), so vertices are shared and numbered
    without search or rank; they have gaps. Triangles whose corners coincide are left out. Nodes
    outside 0 <= i, j, k < 2**19 raise an error. One shuffle of nodes, of which those between blocks go
    to each of theirs, and one of the vertices of triangles.
    """
    spark = nodes.sparkSession
    inside = F.lit(True)
    for c in "ijk":
        inside = inside & F.col(c).between(0, SIDE - 1)
    checked = F.when(inside, F.col("value")).otherwise(F.raise_error(F.lit("a node lies outside 0 <= i, j, k < 2**19")).cast("double"))
    g = grids.select("mesh_id", F.col("h").alias("_h"))
    at = nodes.select("mesh_id", *(F.col(c).cast("bigint").alias(c) for c in "ijk"), checked.alias("s")).where(F.abs("s") < _INF)
    at = at.join(g, "mesh_id").withColumn("s", F.col("s") - iso)
    at = at.select("mesh_id", *"ijk", F.when(F.abs("s") < 1e-10 * F.col("_h"), 0.0).otherwise(F.col("s")).alias("s"))
    # a node on the lower side of a block is also the upper side of the block before
    for c in "ijk":
        b = F.floor(F.col(c) / BLOCK)
        blocks = F.when((F.col(c) % BLOCK == 0) & (b > 0), F.array(b - 1, b)).otherwise(F.array(b))
        at = at.withColumn("b" + c, F.explode(blocks))
    block = ["mesh_id", "bi", "bj", "bk"]
    corner = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), *((F.col(x) - (c >> a & 1)).alias(x) for a, x in enumerate("ijk"))) for c in range(8))))
    # partitioned by block, cells are grouped where they are
    cell = at.repartition(*block).select(*block, "s", corner.alias("n")).select(*block, "s", "n.*")
    for c in "ijk":
        cell = cell.where(F.col(c).between(F.col("b" + c) * BLOCK, F.col("b" + c) * BLOCK + BLOCK - 1))
    cell = cell.groupBy(*block, *"ijk").agg(*(F.max(F.when(F.col("c") == c, F.col("s"))).alias(f"s{c}") for c in range(8)))
    signs = sum((F.when(F.col(f"s{c}") < 0, 1 << c).otherwise(0) for c in range(1, 8)), F.when(F.col("s0") < 0, 1).otherwise(0))
    full = F.lit(True)
    for c in range(8):
        full = full & F.col(f"s{c}").isNotNull()
    cell = cell.where(full).select("mesh_id", *"ijk", F.array(*(f"s{c}" for c in range(8))).alias("s"), signs.alias("signs")).where("signs BETWEEN 1 AND 254")
    cases = spark.createDataFrame(_case_rows(), "signs int, t int, " + ", ".join(f"a{m} int, b{m} int, e{m} int" for m in range(3)))
    # a table of fixed size, whatever the input
    tri = cell.join(F.broadcast(cases), "signs")

    def value(c: Column) -> Column:
        return F.get("s", c)

    def vertex(m: int) -> Column:
        a, b, e = (F.col(f"{x}{m}") for x in "abe")
        on = value(e) == 0
        start = F.when(on, e).otherwise(a)
        steps = [F.shiftright(start, x).bitwiseAND(F.lit(1)) for x in range(3)]
        node = [F.col(c) + s for c, s in zip("ijk", steps, strict=True)]
        way = F.when(on, F.lit(0)).otherwise(a.bitwiseXOR(b))
        t = F.when(on, 0.0).otherwise(value(a) / (value(a) - value(b)))
        where = [n + t * F.shiftright(way, x).bitwiseAND(F.lit(1)) for x, n in enumerate(node)]
        return F.struct((_node_id(*node) * 8 + way).alias("v"), *(w.alias(c) for w, c in zip(where, "xyz", strict=True)))

    tri = tri.select("mesh_id", (_node_id(*(F.col(c) for c in "ijk")) * 16 + F.col("t")).alias("f"), *(vertex(m).alias(f"p{m}") for m in range(3)))
    # both results read the triangles, which are few beside the nodes
    tri = cut(tri.where("p0.v <> p1.v AND p1.v <> p2.v AND p2.v <> p0.v"))
    faces = tri.select("mesh_id", "f", *(F.col(f"p{m}.v").alias(f"v{m}") for m in range(3)))
    points = tri.select("mesh_id", F.explode(F.array("p0", "p1", "p2")).alias("p")).groupBy("mesh_id", F.col("p.v").alias("v")).agg(F.min("p").alias("p"))
    place = points.join(grids.select("mesh_id", "ox", "oy", "oz", "h"), "mesh_id")
    return place.select("mesh_id", "v", *((F.col("o" + c) + F.col("h") * F.col("p." + c)).alias(c) for c in "xyz")), faces


def _cornered(df: DataFrame, keep: list[str]) -> DataFrame:
    """Each row by the eight nodes about its place (gi, gj, gk, in cells, of base ci, cj, ck): keep..., i, j, k, w."""
    def one(c: int) -> Column:
        w = F.lit(1.0)
        for a, x in enumerate("ijk"):
            part = F.col("g" + x) - F.col("c" + x)
            w = w * (part if c >> a & 1 else 1 - part)
        return F.struct(*((F.col("c" + x) + (c >> a & 1)).alias(x) for a, x in enumerate("ijk")), w.alias("w"))

    return df.select(*keep, F.explode(F.array(*(one(c) for c in range(8)))).alias("n")).select(*keep, "n.*")


def trilinear(nodes: DataFrame, grids: DataFrame, points: DataFrame) -> DataFrame:
    """Field values at points (mesh_id, p, x, y, z), clamped to the grid: mesh_id, p, value.

    ``grids`` also has nx, ny, nz, nodes a side, at least 2. A point is null where a node that counts for it is absent.
    ``p`` is unique in its mesh.
    """
    g = points.where(_finite("xyz")).join(grids.select("mesh_id", "ox", "oy", "oz", "h", "nx", "ny", "nz"), "mesh_id")
    for a, c in zip("ijk", "xyz", strict=True):
        place = F.greatest(F.lit(0.0), F.least((F.col(c) - F.col("o" + c)) / F.col("h"), F.col("n" + c) - F.lit(1.0)))
        g = g.withColumn("g" + a, place)
        g = g.withColumn("c" + a, F.least(F.floor("g" + a), (F.col("n" + c) - 2).cast("bigint")))
    part = _cornered(g, ["mesh_id", "p"]).where("w > 0")
    # a node that comes twice has its greatest value
    at = nodes.where(F.abs("value") < _INF).groupBy("mesh_id", *(F.col(c).cast("bigint").alias(c) for c in "ijk")).agg(F.max("value").alias("value"))
    got = part.join(at, ["mesh_id", *"ijk"], "left").groupBy("mesh_id", "p").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count_if(F.col("value").isNull()).alias("_lost"))
    return got.select("mesh_id", "p", F.when(F.col("_lost") == 0, F.col("value")).alias("value"))


def _finite(columns: str, prefix: str = "") -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.abs(prefix + c) < _INF, F.lit(False))
    return ok


def normal_splat(vertices: DataFrame, faces: DataFrame, grids: DataFrame) -> DataFrame:
    """Area vectors of the faces as a density on nodes: mesh_id, i, j, k, x, y, z.

    A triangle is cut into m squared like ones with sides of at most h / 2; each gives its share of the area
    vector to the eight nodes around its centre, by trilinear weights, over h cubed. So the densities times
    h cubed add up to the surface's area vector. Triangles without area give nothing. Sums are combined
    before they are shuffled, and a large triangle is cut by rows, not as one array.
    """
    t = face_positions(faces, vertices).where(_finite("xyz", "a") & _finite("xyz", "b") & _finite("xyz", "c"))
    t = t.join(grids.select("mesh_id", "ox", "oy", "oz", "h"), "mesh_id")
    u, v = ([F.col(p + c) - F.col("a" + c) for c in "xyz"] for p in "bc")
    n = [(u[(a + 1) % 3] * v[(a + 2) % 3] - u[(a + 2) % 3] * v[(a + 1) % 3]) / 2 for a in range(3)]
    side = [sum((F.col(p + c) - F.col(q + c)) ** 2 for c in "xyz") for p, q in ("ab", "bc", "ca")]
    m = F.greatest(F.lit(1), F.ceil(F.sqrt(F.greatest(*side)) / (F.col("h") / 2))).cast("bigint")
    t = t.withColumns({f"n{c}": x for c, x in zip("xyz", n, strict=True)}).withColumn("m", m).where("nx <> 0 OR ny <> 0 OR nz <> 0")
    t = t.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    # of the m x m places those past the diagonal are the triangles that stand on their head
    turned = F.col("p") + F.col("q") >= F.col("m")
    b, c = (F.when(turned, F.col("m") - 1 - F.col(x) + 2 / 3).otherwise(F.col(x) + 1 / 3) / F.col("m") for x in "pq")
    t = t.withColumns({"_b": b, "_c": c})
    for a, x in zip("ijk", "xyz", strict=True):
        at = F.col("a" + x) + F.col("_b") * (F.col("b" + x) - F.col("a" + x)) + F.col("_c") * (F.col("c" + x) - F.col("a" + x))
        t = t.withColumn("g" + a, (at - F.col("o" + x)) / F.col("h"))
    t = t.withColumns({"c" + a: F.floor("g" + a) for a in "ijk"} | {f"n{c}": F.col("n" + c) / (F.col("m") * F.col("m") * F.pow("h", F.lit(3))) for c in "xyz"})
    part = _cornered(t, ["mesh_id", "nx", "ny", "nz"])
    return part.groupBy("mesh_id", *"ijk").agg(*(F.sum(F.col("w") * F.col("n" + c)).alias(c) for c in "xyz"))

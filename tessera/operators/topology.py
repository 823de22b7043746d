"""Edges, components, orientability, genus: topology of all meshes of a corpus at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import components, cut
from .model import halfedges


def valid_faces(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Faces with three distinct ids, all of which the mesh has."""
    ok = faces.where("v0 >= 0 AND v1 >= 0 AND v2 >= 0 AND v0 <> v1 AND v1 <> v2 AND v2 <> v0")
    if vertices is None:
        return ok
    corner = ok.select("mesh_id", "f", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    lost = corner.join(vertices.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti").select("mesh_id", "f").distinct()
    return ok.join(lost, ["mesh_id", "f"], "left_anti")


def duplicate_faces(faces: DataFrame) -> DataFrame:
    """Faces whose vertex set an earlier valid face has: mesh_id, f."""
    key = F.array_sort(F.array("v0", "v1", "v2"))
    w = Window.partitionBy("mesh_id", "_k").orderBy("f")
    return faces.withColumn("_k", key).withColumn("_r", F.row_number().over(w)).where("_r > 1").select("mesh_id", "f")


def edges(faces: DataFrame) -> DataFrame:
    """mesh_id, u < v, h_min (first half-edge), n_faces, kind; one aggregation over half-edges."""
    he = halfedges(faces).withColumns({"u": F.least("origin", "dest"), "v": F.greatest("origin", "dest"), "s": F.when(F.col("origin") < F.col("dest"), 1).otherwise(-1)})
    e = he.groupBy("mesh_id", "u", "v").agg(F.min("h").alias("h_min"), F.count("*").alias("n_faces"), F.sum("s").alias("_s"))
    kind = F.when(F.col("n_faces") == 1, "boundary").when(F.col("n_faces") > 2, "nonmanifold").when(F.col("_s") == 0, "manifold").otherwise("misoriented")
    return e.withColumn("kind", kind).drop("_s")


def twins(faces: DataFrame) -> DataFrame:
    """Half-edges with their twin, null on boundaries."""
    he = halfedges(faces)
    t = he.select("mesh_id", F.col("origin").alias("dest"), F.col("dest").alias("origin"), F.col("h").alias("twin"))
    return he.join(t, ["mesh_id", "origin", "dest"], "left")


def isolated_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    return vertices.select("mesh_id", "v").join(used, ["mesh_id", "v"], "left_anti")


def vertex_components(faces: DataFrame) -> DataFrame:
    """mesh_id, v, label (least vertex), component (numbered by least vertex)."""
    e = edges(faces)
    nodes = e.select("mesh_id", "u").union(e.select("mesh_id", "v")).distinct()
    got = components(nodes, e, ["mesh_id"], node="u", a="u", b="v").withColumnRenamed("u", "v")
    return got.withColumn("component", F.dense_rank().over(Window.partitionBy("mesh_id").orderBy("label")) - 1)


def nonmanifold_vertices(faces: DataFrame) -> DataFrame:
    """Vertices whose faces make more than one fan, faces sharing a spoke being joined: mesh_id, v."""
    he = halfedges(faces)
    corner = he.select("mesh_id", F.col("origin").alias("v"), "f", F.explode(F.array("dest", "apex")).alias("w"))
    first = corner.groupBy("mesh_id", "v", "w").agg(F.min("f").alias("g"))
    links = corner.join(first, ["mesh_id", "v", "w"]).where("f <> g").select("mesh_id", "v", F.col("f").alias("a"), F.col("g").alias("b"))
    nodes = he.select("mesh_id", F.col("origin").alias("v"), F.col("f").alias("a")).distinct()
    fans = components(nodes, links, ["mesh_id", "v"], node="a", a="a", b="b")
    return fans.groupBy("mesh_id", "v").agg(F.count_distinct("label").alias("fans")).where("fans > 1").select("mesh_id", "v")


def boundary_components(faces: DataFrame) -> DataFrame:
    """mesh_id, v, label over boundary edges alone; its labels are the boundary loops."""
    e = edges(faces).where("kind = 'boundary'").select("mesh_id", "u", "v")
    nodes = e.select("mesh_id", F.col("u").alias("n")).union(e.select("mesh_id", F.col("v").alias("n"))).distinct()
    return components(nodes, e, ["mesh_id"], node="n", a="u", b="v").withColumnRenamed("n", "v")


def orientable(faces: DataFrame) -> DataFrame:
    """mesh_id, label (least face of a face component), orientable.

    Double cover: nodes 2f and 2f+1 are the two sides of a face; an edge with two faces links equal
    sides if they agree in direction and unequal ones if not. A component of faces is orientable
    unless some face's sides are connected.
    """
    he = halfedges(faces).withColumns({"u": F.least("origin", "dest"), "v": F.greatest("origin", "dest"), "s": F.col("origin") < F.col("dest")})
    two = edges(faces).where("n_faces = 2").select("mesh_id", "u", "v")
    sides = he.join(two, ["mesh_id", "u", "v"]).groupBy("mesh_id", "u", "v").agg(F.min_by(F.struct("f", "s"), "h").alias("p"), F.max_by(F.struct("f", "s"), "h").alias("q"))
    flip = (F.col("p.s") == F.col("q.s")).cast("int")
    link = F.explode(F.array(*(F.struct((F.col("p.f") * 2 + k).alias("a"), (F.col("q.f") * 2 + F.abs(F.lit(k) - flip)).alias("b")) for k in (0, 1))))
    links = sides.select("mesh_id", link.alias("l")).select("mesh_id", "l.a", "l.b")
    nodes = faces.select("mesh_id", F.explode(F.array(F.col("f") * 2, F.col("f") * 2 + 1)).alias("n"))
    side = components(nodes, links, ["mesh_id"], node="n", a="a", b="b")
    f = side.groupBy("mesh_id", F.shiftright("n", 1).alias("f")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    # both sides of a component's faces carry the least side of either cover sheet
    return f.groupBy("mesh_id", F.shiftright("lo", 1).alias("label")).agg(F.bool_and(F.col("lo") != F.col("hi")).alias("orientable"))


def component_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per component: counts, chi, boundary loops, manifold, orientable, genus, betti."""
    good = cut(valid_faces(faces, vertices).join(duplicate_faces(valid_faces(faces, vertices)), ["mesh_id", "f"], "left_anti"))
    comp = cut(vertex_components(good))
    c = comp.select("mesh_id", "v", "component")
    by = ["mesh_id", "component"]
    nv = c.groupBy(*by).agg(F.count("*").alias("n_vertices"))
    e = edges(good).join(c.withColumnRenamed("v", "u"), ["mesh_id", "u"])
    ne = e.groupBy(*by).agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind") == "boundary").alias("boundary_edges"), F.count_if(F.col("kind").isin("nonmanifold")).alias("bad_edges"))
    fc = good.join(c.withColumnRenamed("v", "v0"), ["mesh_id", "v0"]).select("mesh_id", "f", "component")
    nf = fc.groupBy(*by).agg(F.count("*").alias("n_faces"))
    loops = boundary_components(good).join(c, ["mesh_id", "v"]).groupBy(*by).agg(F.count_distinct("label").alias("loops"))
    bad = nonmanifold_vertices(good).join(c, ["mesh_id", "v"]).groupBy(*by).agg(F.count("*").alias("bad_vertices"))
    ori = orientable(good).join(fc.withColumnRenamed("f", "label"), ["mesh_id", "label"]).groupBy(*by).agg(F.bool_and("orientable").alias("orientable"))
    r = nv.join(ne, by).join(nf, by).join(loops, by, "left").join(bad, by, "left").join(ori, by, "left").fillna(0, ["loops", "bad_vertices"])
    r = r.withColumn("manifold", (F.col("bad_edges") == 0) & (F.col("bad_vertices") == 0))
    r = r.withColumns({"orientable": F.col("orientable") & F.col("manifold"), "chi": F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")})
    twice = F.lit(2) - F.col("chi") - F.col("loops")
    genus = F.when(F.col("orientable") & (twice >= 0) & (twice % 2 == 0), (twice / 2).cast("int"))
    r = r.withColumn("genus", genus)
    b2 = F.when(F.col("loops") == 0, 1).otherwise(0)
    betti = F.when(F.col("genus").isNotNull(), F.array(F.lit(1).cast("bigint"), (F.lit(1) + b2 - F.col("chi")).cast("bigint"), b2.cast("bigint")))
    return r.select("mesh_id", "component", "n_vertices", "n_edges", "n_faces", "boundary_edges", "loops", "chi", "manifold", "orientable", "genus", betti.alias("betti"))


def mesh_report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per mesh: lists of defects, ascending, and counts of edges by kind."""
    ok = cut(valid_faces(faces, vertices))
    dup = duplicate_faces(ok)
    good = cut(ok.join(dup, ["mesh_id", "f"], "left_anti"))

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy("mesh_id").agg(F.array_sort(F.collect_list(column)).alias(name))

    e = edges(good)
    kinds = e.groupBy("mesh_id").agg(*(F.count_if(F.col("kind") == k).alias(k + "_edges") for k in ("boundary", "manifold", "misoriented", "nonmanifold")))
    out = faces.select("mesh_id").union(vertices.select("mesh_id")).distinct()
    for part in (
        listed(faces.join(ok, ["mesh_id", "f"], "left_anti"), "f", "invalid_faces"),
        listed(dup, "f", "duplicate_faces"),
        listed(isolated_vertices(vertices, good), "v", "isolated_vertices"),
        listed(nonmanifold_vertices(good), "v", "nonmanifold_vertices"),
        kinds,
    ):
        out = out.join(part, "mesh_id", "left")
    return out


def without_excluded(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    ok = valid_faces(faces, vertices)
    return ok.join(duplicate_faces(ok), ["mesh_id", "f"], "left_anti")


def manifold_part(vertices: DataFrame, faces: DataFrame, max_passes: int = 4) -> tuple[DataFrame, DataFrame]:
    """Faces left once invalid, duplicate and non-manifold places are gone; passes that dropped any.

    Each pass drops faces with an edge that is nonmanifold or misoriented and faces with a corner of
    several fans. Meshes that are clean stay as they are while others go on.
    """
    now = cut(without_excluded(vertices, faces))
    counted = faces.groupBy("mesh_id").agg(F.count("*").alias("n0"))
    dropped = counted.join(now.groupBy("mesh_id").agg(F.count("*").alias("n1")), "mesh_id", "left").select("mesh_id", F.when(F.coalesce("n1", F.lit(0)) < F.col("n0"), 1).otherwise(0).alias("passes"))
    passes = cut(dropped)
    for k in range(max_passes):
        e = edges(now).where("kind IN ('nonmanifold', 'misoriented')").select("mesh_id", "u", "v")
        he = halfedges(now).select("mesh_id", "f", F.least("origin", "dest").alias("u"), F.greatest("origin", "dest").alias("v"))
        by_edge = he.join(e, ["mesh_id", "u", "v"], "left_semi").select("mesh_id", "f")
        by_vertex = halfedges(now).select("mesh_id", "f", F.col("origin").alias("v")).join(nonmanifold_vertices(now), ["mesh_id", "v"], "left_semi").select("mesh_id", "f")
        gone = cut(by_edge.union(by_vertex).distinct())
        if gone.isEmpty():
            break
        hit = gone.select("mesh_id").distinct().withColumn("hit", F.lit(1))
        # the first pass drops bad faces along with invalid ones
        passes = cut(passes.join(hit, "mesh_id", "left").select("mesh_id", F.when(F.col("hit") == 1, F.greatest(F.col("passes"), F.lit(k + 1))).otherwise(F.col("passes")).alias("passes")))
        now = cut(now.join(gone, ["mesh_id", "f"], "left_anti"))
    return now, passes


def halfedge_errors(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """First error of building half-edges, by mesh; meshes without an error have no row.

    Order: per face, an index that the mesh lacks and then a repeated index; then the least directed edge
    used twice; then the least vertex with several fans.
    """
    corner = faces.select("mesh_id", "f", F.explode(F.array("v0", "v1", "v2")).alias("v"))
    lost = corner.join(vertices.select("mesh_id", "v"), ["mesh_id", "v"], "left_anti").select("mesh_id", "f").distinct()
    far = lost.select("mesh_id", F.lit(0).alias("stage"), "f", F.lit(0).alias("sub"), F.concat(F.lit("face "), F.col("f"), F.lit(": vertex index out of range")).alias("error"))
    flat = faces.where("v0 = v1 OR v1 = v2 OR v2 = v0").select("mesh_id", F.lit(0).alias("stage"), "f", F.lit(1).alias("sub"), F.concat(F.lit("face "), F.col("f"), F.lit(": degenerate (repeated vertex)")).alias("error"))
    ok = valid_faces(faces, vertices)
    he = halfedges(ok)
    w = Window.partitionBy("mesh_id", "origin", "dest").orderBy("h")
    dup = he.withColumn("r", F.row_number().over(w)).where("r > 1").select("mesh_id", F.lit(1).alias("stage"), F.col("h").alias("f"), F.lit(0).alias("sub"), F.concat(F.lit("edge ("), F.col("origin"), F.lit(", "), F.col("dest"), F.lit(") is used twice in the same direction")).alias("error"))
    fans = nonmanifold_vertices(ok).select("mesh_id", F.lit(2).alias("stage"), F.col("v").alias("f"), F.lit(0).alias("sub"), F.concat(F.lit("vertex "), F.col("v"), F.lit(" has more than one fan of faces")).alias("error"))
    return far.union(flat).union(dup).union(fans).groupBy("mesh_id").agg(F.min(F.struct("stage", "f", "sub", "error")).alias("e")).select("mesh_id", F.col("e.error").alias("error"))

"""Generators, files, welding and topology."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.picks import first_appearance
from tessera.operators import topology
from tessera.operators.fixpoint import components, cut, cycle_positions
from tessera.operators.kernels.rewrite import handle_loops
from tessera.operators.model import halfedges, per_mesh, tables
from tessera.operators.weld import weld_eps, weld_exact
from tessera.sources import corpora, mesh_io
from tessera.sources import meshes as M

from .registry import query, table

#: One torus per supplier, as a DuckDB relation f of faces; its parameters are those of torus_params.
TORUS_SQL = """
p AS (SELECT 's' || s_suppkey AS mesh_id, 6 + s_suppkey % 11 AS nu, 4 + s_suppkey % 7 AS nv, 1 + (s_suppkey % 5) * 0.1::DOUBLE AS big FROM supplier),
c AS (SELECT mesh_id, nu, nv, id, id % nu AS i, id // nu AS j FROM p, range(0, 200) r(id) WHERE id < nu * nv),
q AS (SELECT mesh_id, id, j * nu + i AS a, j * nu + (i + 1) % nu AS b, ((j + 1) % nv) * nu + (i + 1) % nu AS cc, ((j + 1) % nv) * nu + i AS d FROM c),
f AS (SELECT mesh_id, 2 * id AS f, a AS v0, b AS v1, cc AS v2 FROM q UNION ALL SELECT mesh_id, 2 * id + 1, a, cc, d FROM q),
x AS (SELECT c.mesh_id, id AS v, (big + 0.3::DOUBLE * cos(j * 2 * pi() / p.nv)) * cos(i * 2 * pi() / p.nu) AS x,
  (big + 0.3::DOUBLE * cos(j * 2 * pi() / p.nv)) * sin(i * 2 * pi() / p.nu) AS y, 0.3::DOUBLE * sin(j * 2 * pi() / p.nv) AS z FROM c JOIN p USING (mesh_id)),
he AS (SELECT mesh_id, 3 * f AS h, v0 AS o, v1 AS d, v2 AS e FROM f UNION ALL SELECT mesh_id, 3 * f + 1, v1, v2, v0 FROM f UNION ALL SELECT mesh_id, 3 * f + 2, v2, v0, v1 FROM f)
"""


def torus_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("mesh_id"), (6 + k % 11).alias("nu"), (4 + k % 7).alias("nv"), (1 + (k % 5) * 0.1).alias("big"), F.lit(0.3).alias("small"))


def torus_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corpora.tori(torus_params(spark, sf_dir))


@query("""
WITH p AS (SELECT 's' || s_suppkey AS mesh_id, (6 + s_suppkey % 11) * (4 + s_suppkey % 7) AS n FROM supplier)
SELECT mesh_id, n::BIGINT AS n_vertices, (3 * n)::BIGINT AS n_edges, (2 * n)::BIGINT AS n_faces, 0::BIGINT AS chi, 0::BIGINT AS boundary_edges, 1 AS genus FROM p
""")
def torus_corpus_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V, E, F, chi, boundary edges and genus of each supplier's torus, from its faces alone."""
    v, f = torus_corpus(spark, sf_dir)
    e = topology.edges(f).groupBy("mesh_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind") == "boundary").alias("boundary_edges"))
    r = v.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")).join(e, "mesh_id").join(f.groupBy("mesh_id").agg(F.count("*").alias("n_faces")), "mesh_id")
    chi = F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")
    return r.select("mesh_id", "n_vertices", "n_edges", "n_faces", chi.alias("chi"), "boundary_edges", ((2 - chi) / 2).cast("int").alias("genus"))


def hole_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    nx, ny = k % 5 + 5, k % 3 + 5
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k).alias("mesh_id"), nx.alias("nx"), ny.alias("ny"), F.array(nx + 1, (ny - 2) * nx + nx - 2).alias("holes"))


HOLES_SQL = """
p AS (SELECT 'n' || n_nationkey AS mesh_id, n_nationkey % 5 + 5 AS nx, n_nationkey % 3 + 5 AS ny FROM nation),
c AS (SELECT mesh_id, nx, ny, id, id % nx AS i, id // nx AS j FROM p, range(0, 100) r(id) WHERE id < nx * ny AND id <> nx + 1 AND id <> (ny - 2) * nx + nx - 2),
q AS (SELECT mesh_id, id, j * (nx + 1) + i AS a, j * (nx + 1) + i + 1 AS b, (j + 1) * (nx + 1) + i + 1 AS cc, (j + 1) * (nx + 1) + i AS d FROM c),
f AS (SELECT mesh_id, 2 * id AS f, a AS v0, b AS v1, cc AS v2 FROM q UNION ALL SELECT mesh_id, 2 * id + 1, a, cc, d FROM q),
he AS (SELECT mesh_id, v0 AS o, v1 AS d FROM f UNION ALL SELECT mesh_id, v1, v2 FROM f UNION ALL SELECT mesh_id, v2, v0 FROM f)
"""


@query(f"""
WITH {HOLES_SQL}, e AS (SELECT mesh_id, least(o, d) AS u, greatest(o, d) AS v, count(*) AS n FROM he GROUP BY ALL)
SELECT mesh_id, CASE n WHEN 1 THEN 'boundary' ELSE 'manifold' END AS kind, count(*) AS n FROM e GROUP BY ALL
""")
def grid_holes_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind of a grid with two holes per nation."""
    _, f = corpora.grids(hole_params(spark, sf_dir))
    return topology.edges(f).groupBy("mesh_id", "kind").agg(F.count("*").alias("n"))


@query("""SELECT '[35]' AS invalid_faces, '[34]' AS duplicate_faces, '[28]' AS isolated_vertices, '[24]' AS nonmanifold_vertices, 1::BIGINT AS nonmanifold_edges,
  4::BIGINT AS misoriented_edges, 45::BIGINT AS boundary_edges, 59::BIGINT AS manifold_edges""")
def defect_showcase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = topology.mesh_report(*tables(spark, {"defects": M.defect_showcase()}))
    lists = ["invalid_faces", "duplicate_faces", "isolated_vertices", "nonmanifold_vertices"]
    return r.select(*(F.to_json(c).alias(c) for c in lists), "nonmanifold_edges", "misoriented_edges", "boundary_edges", "manifold_edges")


_OBJ = {
    "quad": "# comment\nv 0 0 0\nv 1 0 0\r\nv 1 1 0\nv 0 1 0\nf 1 2/5 3//7 4/1/1\n",
    "negative": "v 0 0 0\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\nvn 0 0 1\n",
    "zero": "v 0 0 0\nv 1 0 0\nv 0 1 0\nf 0 1 2\n",
    "range": "v 0 0 0\nf 1 2 3\n",
    "short": "v 0 0 0\nv 1 0 0\nf 1 2\n",
    "number": "v 0 nan 0\n",
}


def _parsed(spark: SparkSession, files: list[tuple[str, str, bytes]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([mesh_io._row(n, k, bytes(c)) for n, k, c in zip(f["name"], f["format"], f["content"], strict=True)], columns=["mesh_id", "format", "error", "vertices", "faces"])

    return spark.createDataFrame(files, "name string, format string, content binary").mapInPandas(run, mesh_io.MESH)


@query("""SELECT * FROM (VALUES ('quad', 4, 2, NULL), ('negative', 3, 1, NULL), ('zero', NULL, NULL, 'line 4: face index 0'), ('range', NULL, NULL, 'line 2: face index out of range'),
  ('short', NULL, NULL, 'line 3: face has fewer than 3 corners'), ('number', NULL, NULL, 'line 1: bad vertex')) t(mesh_id, n_vertices, n_faces, error)""")
def obj_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts or the first error, with its line, of small OBJ files."""
    p = _parsed(spark, [(n, "obj", t.encode()) for n, t in _OBJ.items()])
    size = lambda c: F.when(F.col("error").isNull(), F.size(c))
    return p.select("mesh_id", size("vertices").alias("n_vertices"), size("faces").alias("n_faces"), "error")


@query("""SELECT * FROM (VALUES ('binary', 4, NULL), ('solid', 4, NULL), ('ascii', 1, NULL), ('cut', NULL, 'line 1: expected ''solid'''), ('broken', NULL, 'line 4: bad number')) t(mesh_id, n_faces, error)""")
def stl_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary STL is told by its size, whatever word it begins with."""
    tetra = M.Mesh([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])
    data = mesh_io.write_stl(tetra)
    text = "solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid a\n"
    files = [("binary", data), ("solid", b"solid" + data[5:]), ("ascii", text.encode()), ("cut", b"\0" + data[1:-1]), ("broken", text.replace("vertex 0 0 0", "vertex 0 x 0").encode())]
    p = _parsed(spark, [(n, "stl", c) for n, c in files])
    return p.select("mesh_id", F.when(F.col("error").isNull(), F.size("faces")).alias("n_faces"), "error")


@query("SELECT 'torus' AS mesh_id, 72::BIGINT AS equal_vertices, 144::BIGINT AS equal_faces")
def obj_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and faces that come back bit for bit from the composed OBJ text."""
    v, f = tables(spark, {"torus": M.torus(12, 6)})
    lines = mesh_io.obj_lines(v, f).groupBy("mesh_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "i", "line"))), lambda s: s["line"]), "\n").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield pd.DataFrame([mesh_io._row(n, "obj", t.encode()) for n, t in zip(p["mesh_id"], p["text"], strict=True)], columns=["mesh_id", "format", "error", "vertices", "faces"])

    v2, f2 = mesh_io.exploded(lines.mapInPandas(run, mesh_io.MESH))
    a = v.join(v2, ["mesh_id", "v", "x", "y", "z"], "left_semi").groupBy("mesh_id").agg(F.count("*").alias("equal_vertices"))
    return a.join(f.join(f2, ["mesh_id", "f", "v0", "v1", "v2"], "left_semi").groupBy("mesh_id").agg(F.count("*").alias("equal_faces")), "mesh_id")


@query("""
WITH e AS (SELECT vec_id, round(embedding[1] * 2) AS x, round(embedding[2] * 2) AS y, round(embedding[3] * 2) AS z FROM embeddings WHERE vec_id < (SELECT count(*) // 3 * 3 FROM embeddings)),
k AS (SELECT x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z, min(vec_id) AS first FROM e GROUP BY ALL)
SELECT row_number() OVER (ORDER BY first) - 1 AS v, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM k
""")
def weld_exact_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on a coarse lattice as a triangle soup, welded; ids in order of first use."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count() // 3 * 3
    v = e.where(F.col("vec_id") < n).select(F.lit("e").alias("mesh_id"), F.col("vec_id").alias("v"), *(F.round(F.col("embedding")[k].cast("double") * 2).alias(c) for k, c in enumerate("xyz")))
    f = spark.range(n // 3).select(F.lit("e").alias("mesh_id"), F.col("id").alias("f"), *((F.col("id") * 3 + k).alias(f"v{k}") for k in range(3)))
    return weld_exact(v, f)[0].select("v", "x", "y", "z")


@query("SELECT * FROM (VALUES (0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 3, 1), (3, 2, 1, 3)) t(f, v0, v1, v2)")
def weld_soup_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of a tetrahedron's soup after welding."""
    x = {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1)}
    order = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (2, 1, 3)]
    soup = M.Mesh([x[i] for t in order for i in t], [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(4)])
    return weld_exact(*tables(spark, {"t": soup}))[1].select(*(F.col(c).cast("int").alias(c) for c in ("f", "v0", "v1", "v2")))


@query()
def weld_epsilon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points (hour, user, value), one soup per event type, welded greedily within 0.5."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("mesh_id"), "event_id", (F.hour("ts") / 1.0).alias("x"), (F.col("user_id") % 7 / 1.0).alias("y"), F.coalesce("value", F.lit(0.0)).alias("z"))
    v = cut(first_appearance(e, ["event_id", "x", "y", "z"], "event_id", ["mesh_id"], "v"))
    f = v.select("mesh_id", F.floor(F.col("v") / 3).alias("f")).groupBy("mesh_id", "f").count().where("count = 3").select("mesh_id", "f", *((F.col("f") * 3 + k).alias(f"v{k}") for k in range(3)))
    return weld_eps(v.select("mesh_id", "v", "x", "y", "z"), f, 0.5)


@query(f"WITH {TORUS_SQL} SELECT a.mesh_id, a.h, b.h AS twin FROM he a LEFT JOIN he b ON a.mesh_id = b.mesh_id AND a.o = b.d AND a.d = b.o")
def halfedge_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.twins(torus_corpus(spark, sf_dir)[1]).select("mesh_id", "h", "twin")


@query(f"WITH {TORUS_SQL} SELECT mesh_id, o AS v, count(DISTINCT d) AS degree FROM (SELECT mesh_id, o, d FROM he UNION ALL SELECT mesh_id, d, o FROM he) GROUP BY ALL")
def one_ring_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = topology.edges(torus_corpus(spark, sf_dir)[1])
    both = e.select("mesh_id", F.col("u").alias("v")).union(e.select("mesh_id", "v"))
    return both.groupBy("mesh_id", "v").agg(F.count("*").alias("degree"))


@query("""
WITH RECURSIVE e0 AS (SELECT DISTINCT l_partkey AS u, l_suppkey + 1000000000 AS v FROM lineitem),
e AS (SELECT u AS a, v AS b FROM e0 UNION ALL SELECT v, u FROM e0),
cc(v, l) USING KEY (v) AS (
  SELECT a AS v, a AS l FROM (SELECT DISTINCT a FROM e)
  UNION
  (SELECT e.b AS v, min(cc.l) AS l FROM cc JOIN e ON e.a = cc.v JOIN recurring.cc AS r ON r.v = e.b WHERE cc.l < r.l GROUP BY e.b))
SELECT v, l AS label FROM cc
""")
def components_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of parts and suppliers that share an order line."""
    e = table(spark, sf_dir, "lineitem").select(F.lit("g").alias("g"), F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 1000000000).alias("v"))
    nodes = e.select("g", F.col("u").alias("n")).union(e.select("g", F.col("v").alias("n")))
    return components(nodes, e, ["g"], node="n", a="u", b="v").select(F.col("n").alias("v"), "label")


def mixed_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    two = M.append(M.torus(12, 6), M.icosphere(1))
    return tables(spark, {"sphere": M.icosphere(1), "torus": M.torus(12, 6), "plate": M.plate_with_handle(), "holes": M.grid_with_holes(6, 6, [(1, 1), (4, 3)]), "mobius": M.mobius(8), "cylinder": M.cylinder(10, 3), "two": two})


@query("""SELECT * FROM (VALUES ('sphere', 0, 42, 120, 80, 2, 0, true, 0, '[1,0,1]'), ('torus', 0, 72, 216, 144, 0, 0, true, 1, '[1,2,1]'), ('plate', 0, 229, 642, 412, -1, 1, true, 1, '[1,2,0]'),
 ('holes', 0, 49, 118, 68, -1, 3, true, 0, '[1,2,0]'), ('mobius', 0, 16, 32, 16, 0, 1, false, NULL, NULL), ('cylinder', 0, 40, 100, 60, 0, 2, true, 0, '[1,1,0]'),
 ('two', 0, 72, 216, 144, 0, 0, true, 1, '[1,2,1]'), ('two', 1, 42, 120, 80, 2, 0, true, 0, '[1,0,1]')) t(mesh_id, component, n_vertices, n_edges, n_faces, chi, loops, orientable, genus, betti)""")
def genus_betti_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with Euler characteristic, loops, orientability (double cover), genus, Betti numbers."""
    r = topology.component_report(*mixed_corpus(spark))
    ints = [F.col(c).cast("int").alias(c) for c in ("component", "n_vertices", "n_edges", "n_faces", "chi", "loops")]
    return r.select("mesh_id", *ints, "orientable", "genus", F.to_json("betti").alias("betti"))


@query("SELECT 'n' || n_nationkey AS mesh_id, 3::BIGINT AS loops FROM nation")
def boundary_loop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = corpora.grids(hole_params(spark, sf_dir))
    return topology.boundary_components(f).groupBy("mesh_id").agg(F.count_distinct("label").alias("loops"))


@query("SELECT 'n' || n_nationkey AS mesh_id, (2 * (n_nationkey % 5 + 5 + n_nationkey % 3 + 5))::BIGINT AS longest, 4::BIGINT AS shortest FROM nation")
def boundary_loop_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered boundary cycles by pointer doubling: the lengths of the outer and the least loop."""
    _, f = corpora.grids(hole_params(spark, sf_dir))
    rim = topology.twins(f).where("twin IS NULL").select("mesh_id", F.col("dest").alias("v"), F.col("origin").alias("next"))
    c = cycle_positions(rim, ["mesh_id"])
    per = c.groupBy("mesh_id", "loop").agg(F.max("position").alias("last"), F.first("length").alias("n")).where("last = n - 1")
    return per.groupBy("mesh_id").agg(F.max("n").alias("longest"), F.min("n").alias("shortest"))


@query("SELECT * FROM (VALUES ('corner', 26, 1), ('mobius', 12, 2), ('torus', 144, 0)) t(mesh_id, n_faces, passes)")
def manifold_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces left and passes used by the cleaning loop."""
    v, f = tables(spark, {"torus": M.torus(12, 6), "mobius": M.mobius(8), "corner": M.grid_with_holes(4, 4, [(1, 1), (2, 2)])})
    kept, passes = topology.manifold_part(v, f)
    return kept.groupBy("mesh_id").agg(F.count("*").cast("int").alias("n_faces")).join(passes, "mesh_id")


@query("SELECT * FROM (VALUES ('corner', 'vertex 12 has more than one fan of faces'), ('defects', 'face 35: degenerate (repeated vertex)'), ('mobius', 'edge (1, 0) is used twice in the same direction')) t(mesh_id, error)")
def halfedge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = tables(spark, {"torus": M.torus(12, 6), "mobius": M.mobius(8), "corner": M.grid_with_holes(4, 4, [(1, 1), (2, 2)]), "defects": M.defect_showcase()})
    return topology.halfedge_errors(v, f)


@query("SELECT * FROM (VALUES ('sphere', 0), ('torus', 2), ('plate', 2), ('holes', 0), ('cylinder', 0), ('two', 2)) t(mesh_id, loops)")
def handle_loop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators of the handles by tree and cotree: 2 genus per component."""
    v, f = mixed_corpus(spark)
    keep = F.col("mesh_id") != "mobius"
    return per_mesh(v.where(keep), f.where(keep), lambda n, m: pd.DataFrame({"mesh_id": [n], "loops": [len(handle_loops(m))]}), "mesh_id string, loops int")


@query(f"WITH {TORUS_SQL} SELECT mesh_id, count(*) AS n, sum(CASE WHEN o < d THEN 1 ELSE 0 END)::BIGINT AS forward FROM he GROUP BY mesh_id")
def halfedge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halfedges(torus_corpus(spark, sf_dir)[1]).groupBy("mesh_id").agg(F.count("*").alias("n"), F.count_if(F.col("origin") < F.col("dest")).alias("forward"))


@query("SELECT * FROM (VALUES ('icosphere', 2562, 5120), ('torus', 1728, 3456), ('cylinder', 768, 1440), ('grid', 289, 512), ('holes', 169, 284), ('mobius', 96, 96), ('defects', 53, 60), ('brick', 961, 1800), ('tooth', 19881, 39200)) t(mesh_id, n_vertices, n_faces)")
def preset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n in M.PRESETS if n != "plate"]
    v, f = tables(spark, {n: M.preset(n) for n in names})
    return v.groupBy("mesh_id").agg(F.count("*").cast("int").alias("n_vertices")).join(f.groupBy("mesh_id").agg(F.count("*").cast("int").alias("n_faces")), "mesh_id")

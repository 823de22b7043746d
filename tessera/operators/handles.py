"""Loops that generate the handles of all meshes at once: tree, cotree and the edges that neither takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import cut, shortest_paths
from .model import halfedges
from .topology import boundary_components, edges, vertex_components


def spanning_forest(links: DataFrame, by: list[str], max_rounds: int = 64) -> DataFrame:
    """Ids of the edges in the greatest spanning forest: by..., id.

    ``links``: by, id (unique, any type with an order), a, b (nodes), w. Borůvka's rounds: each part takes
    its greatest edge to another part, ties going to the greater id, and parts joined so become one.
    Of parallel edges between two parts only the greatest goes on, so that a part with very many
    edges (a long boundary's) sends one row a neighbour. Edges from a node to itself take no part.
    """
    left, taken = links.select(*by, "a", "b", F.struct("w", "id").alias("e")), []
    for _ in range(max_rounds):
        left = left.where("a <> b").groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("e").alias("e"))
        left = cut(left)
        if left.isEmpty():
            break
        end = F.explode(F.array(*(F.struct(F.col(p).alias("c"), F.col(q).alias("to")) for p, q in ("ab", "ba"))))
        best = left.select(*by, "e", end.alias("n")).groupBy(*by, F.col("n.c").alias("c")).agg(F.max(F.struct("e", "n.to")).alias("m"))
        best = cut(best.select(*by, "c", F.col("m.to").alias("to"), F.col("m.e.id").alias("id")))
        taken.append(best.select(*by, "id"))
        # choices run into pairs that chose each other; the lesser of a pair is the root
        back = best.select(*by, F.col("c").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        up = cut(best.join(back, [*by, "to"]).select(*by, "c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("r")))
        while True:
            far = up.select(*by, F.col("c").alias("r"), F.col("r").alias("far"))
            step = cut(up.join(far, [*by, "r"]).select(*by, "c", F.col("far").alias("r"), (F.col("far") != F.col("r")).alias("moved")))
            up = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        for n in "ab":
            left = left.join(up.select(*by, F.col("c").alias(n), F.col("r").alias("_" + n)), [*by, n])
        left = left.select(*by, F.col("_a").alias("a"), F.col("_b").alias("b"), "e")
    else:
        raise RuntimeError("spanning forest did not settle")
    out = links.select(*by, "id").limit(0)
    for t in taken:
        out = out.union(t)
    return out.distinct()


def ways_up(parents: DataFrame, starts: DataFrame, by: list[str], max_rounds: int = 64) -> DataFrame:
    """All places between starts and the roots of their trees: by..., key, v, step (0 at the start).

    ``parents``: by, v, parent (null at roots). ``starts``: by, key, v. Round k goes 2^k parents up from all places
    found so far, so a tree of depth n takes log n rounds.
    """
    up = cut(parents.where("parent IS NOT NULL").select(*by, "v", F.col("parent").alias("to")))
    way = new = cut(starts.select(*by, "key", "v", F.lit(0).cast("bigint").alias("step")))
    for k in range(max_rounds):
        new = cut(way.join(up, [*by, "v"]).select(*by, "key", F.col("to").alias("v"), (F.col("step") + (1 << k)).alias("step")))
        if new.isEmpty():
            return way
        way = way.union(new)
        far = up.select(*by, F.col("v").alias("to"), F.col("to").alias("far"))
        up = cut(up.join(far, [*by, "to"]).select(*by, "v", F.col("far").alias("to")))
    raise RuntimeError("a parent leads into a cycle")


def _length() -> Column:
    return F.sqrt(sum((F.col("p" + c) - F.col("q" + c)) ** 2 for c in "xyz"))


def handle_loops(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closed ways along edges that generate the handles, and the places of each.

    (loops: mesh_id, loop (from 0, shortest first), u, v (the edge that closes it), length, size;
    places: mesh_id, loop, position, v, from u to v). ``faces`` must be clean: manifold and agreeing
    in direction (topology.manifold_part). A component of genus g has 2g loops; one without handles,
    or a mesh without faces, has none.

    Per component a tree of shortest paths from the least vertex; in the dual graph, where each
    boundary loop is a node, the greatest spanning forest of the edges off the tree by d(u) + length + d(v);
    each edge in neither closes one loop over the nearest place that both its ends' ways share. Ties of
    length are broken by ids.
    """
    by = ["mesh_id"]
    e = edges(faces).select("mesh_id", "u", "v", "n_faces")
    for key, p in (("u", "p"), ("v", "q")):
        e = e.join(vertices.select("mesh_id", F.col("v").alias(key), *(F.col(c).alias(p + c) for c in "xyz")), ["mesh_id", key])
    e = cut(e.select("mesh_id", "u", "v", "n_faces", _length().alias("len")))
    roots = vertex_components(faces).groupBy("mesh_id", "component").agg(F.min("v").alias("v"))
    tree = cut(shortest_paths(e, roots.select("mesh_id", "v"), by).select("mesh_id", "v", "d", "parent"))
    inner = tree.where("parent IS NOT NULL").select("mesh_id", F.least("v", "parent").alias("u"), F.greatest("v", "parent").alias("v"))
    off = e.join(inner, ["mesh_id", "u", "v"], "left_anti")
    for key, d in (("u", "du"), ("v", "dv")):
        off = off.join(tree.select("mesh_id", F.col("v").alias(key), F.col("d").alias(d)), ["mesh_id", key])
    off = cut(off)
    sides = halfedges(faces).groupBy("mesh_id", F.least("origin", "dest").alias("u"), F.greatest("origin", "dest").alias("v")).agg(F.min("f").alias("a"), F.max("f").alias("b"))
    rim = boundary_components(faces).select("mesh_id", F.col("v").alias("u"), (-1 - F.col("label")).alias("rim"))
    dual = off.join(sides, ["mesh_id", "u", "v"]).join(rim, ["mesh_id", "u"], "left")
    other = F.when(F.col("n_faces") == 1, F.col("rim")).otherwise(F.col("b"))
    links = dual.select("mesh_id", F.struct("u", "v").alias("id"), "a", other.alias("b"), (F.col("du") + F.col("len") + F.col("dv")).alias("w"))
    cotree = spanning_forest(links, by).select("mesh_id", "id.u", "id.v")
    closing = cut(off.join(cotree, ["mesh_id", "u", "v"], "left_anti"))

    end = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("at")) for s, c in enumerate("uv"))))
    starts = closing.select("mesh_id", "u", F.col("v").alias("w"), end.alias("s")).select("mesh_id", F.struct("u", "w", "s.side").alias("key"), F.col("s.at").alias("v"))
    way = ways_up(tree, starts, by).select("mesh_id", "key.u", "key.w", "key.side", "v", "step")
    loop = ["mesh_id", "u", "w"]
    met = way.groupBy(*loop, "v").agg(F.min_by("step", "side").alias("s0"), F.max_by("step", "side").alias("s1"), F.count("*").alias("n")).where("n = 2")
    meet = cut(met.groupBy(*loop).agg(F.min(F.struct("s0", "s1", "v")).alias("m")).select(*loop, "m.*").withColumnRenamed("v", "top"))
    top = tree.select("mesh_id", F.col("v").alias("top"), F.col("d").alias("dt"))
    total = meet.join(top, ["mesh_id", "top"]).join(closing.withColumnRenamed("v", "w"), loop)
    loops = total.select(*loop, (F.col("du") + F.col("dv") - 2 * F.col("dt") + F.col("len")).alias("length"), "s0", "s1")
    # loops of one mesh: twice its genus, the only rows that a window holds together
    loops = loops.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("length", "u", "w", "s0", "s1"))).alias("all"))
    loops = cut(loops.select("mesh_id", F.posexplode("all").alias("loop", "l")).select("mesh_id", "loop", "l.*"))
    # the u side climbs to the shared place, the v side comes down from it
    on = way.join(loops, loop)
    position = F.when(F.col("side") == 0, F.col("step")).otherwise(F.col("s0") + F.col("s1") - F.col("step"))
    places = on.where("(side = 0 AND step <= s0) OR (side = 1 AND step < s1)").select("mesh_id", "loop", position.alias("position"), "v")
    return loops.select("mesh_id", "loop", "u", F.col("w").alias("v"), "length", (F.col("s0") + F.col("s1") + 1).alias("size")), places

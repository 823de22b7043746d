"""Generated corpora are dealt over tasks, and tables that only look small aren't broadcast."""

from tessera.operators import fixpoint, geometry, topology
from tessera.sources import corpora


def _params(spark, n=40):
    return spark.range(n).selectExpr("concat('m', id) AS mesh_id", "id % 5 + 6 AS nu", "id % 3 + 4 AS nv", "1.0D AS big", "0.3D AS small").coalesce(1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_corpora_are_dealt_and_not_broadcast(spark, monkeypatch):
    v0, f0 = corpora.tori(_params(spark))
    small = {tuple(r) for r in topology.twins(f0).collect()}
    areas = geometry.face_frames(f0, v0).groupBy().sum("area").first()[0]
    monkeypatch.setattr(corpora, "CELLS_PER_TASK", 100)
    v, f = corpora.tori(_params(spark))
    assert v.rdd.getNumPartitions() > 1
    assert "Broadcast" not in _plan(geometry.face_frames(f, v)) and "Broadcast" not in _plan(topology.twins(f))
    assert {tuple(r) for r in topology.twins(f).collect()} == small
    assert abs(geometry.face_frames(f, v).groupBy().sum("area").first()[0] - areas) < 1e-9
    grid = _params(spark).selectExpr("mesh_id", "nu AS nx", "nv AS ny")
    v, f = corpora.grids(grid)
    assert v.rdd.getNumPartitions() > 1 and "Broadcast" not in _plan(geometry.face_frames(f, v))


def test_checkpointed_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    rows = spark.range(10).selectExpr("id AS k", "explode(sequence(1, 50)) AS x")
    monkeypatch.setattr(fixpoint, "BROADCAST_ROWS", 400)
    large = fixpoint.cut(rows)
    assert "Broadcast" not in _plan(large.join(large.selectExpr("k", "x AS y"), "k"))
    few = fixpoint.cut(rows.where("x = 1"))
    assert few.count() == 10 and "Broadcast" in _plan(few.join(few.selectExpr("k", "x AS y"), "k"))
    assert fixpoint.cut(rows.where("x > 50")).isEmpty()


def _digits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_keep_size_estimates_small(spark):
    edges = spark.range(200).selectExpr("'g' AS g", "id AS u", "id + 1 AS v")
    nodes = spark.range(201).selectExpr("'g' AS g", "id AS n")
    labels = fixpoint.components(nodes, edges, ["g"], node="n")
    assert {r["label"] for r in labels.collect()} == {0} and labels.count() == 201
    assert _digits(labels) < 64


def test_hot_labels_are_handed_on_by_broadcast(spark, monkeypatch):
    graph = spark.range(300).selectExpr("cast(id % 3 AS string) AS g", "id AS u", "(id * 7 + 3) div 5 * 3 + id % 3 AS v").where("v < 300")
    nodes = spark.range(300).selectExpr("cast(id % 3 AS string) AS g", "id AS n")
    plain = {tuple(r) for r in fixpoint.components(nodes, graph, ["g"], node="n").collect()}
    monkeypatch.setattr(fixpoint, "HOT", 4)
    hot = fixpoint._jumped(nodes.selectExpr("g", "n AS _v", "n % 3 AS _l"), ["g"], 300)
    assert "BroadcastHashJoin" in _plan(hot) and {(r["_v"], r["_l"]) for r in hot.collect()} == {(v, v % 3) for v in range(300)}
    assert len(plain) == 300 and {tuple(r) for r in fixpoint.components(nodes, graph, ["g"], node="n").collect()} == plain


def test_edges_are_told_apart_in_tasks_of_bounded_rows(spark, monkeypatch):
    edges = spark.range(1000).selectExpr("'g' AS g", "id % 50 AS u", "id % 50 + 50 AS v")
    nodes, dealt = edges.selectExpr("g", "u AS n").distinct(), []
    made = fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: dealt.append(df.rdd.getNumPartitions()) or made(df))
    monkeypatch.setattr(fixpoint, "TASK_ROWS", 100)
    assert {(r["n"], r["label"]) for r in fixpoint.components(nodes.union(edges.selectExpr("g", "v")).distinct(), edges, ["g"], node="n").collect()} == {(k, k % 50) for k in range(100)}
    assert dealt[0] == 21


def test_the_laplacian_reads_its_weights_and_not_the_faces_again(spark):
    v, f = corpora.tori(_params(spark, 6))
    plan = _plan(geometry.laplacian(v, f))
    assert "Join" not in plan and "Generate" not in plan

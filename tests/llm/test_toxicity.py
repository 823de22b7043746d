import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.boosting import Boosted, Isotonic, fit_table

from .data import awkward, frame, prose


def corpus(n=240):
    rude = ["blorf", "snarkle", "Grimzot", "vileword"]
    rows, labels = [], []
    for i in range(n):
        w = prose(1000 + i, 60).split()
        bad = i % 3 == 0
        if bad:
            for k in range(4):
                w.insert(7 * k + i % 5, rude[(i + k) % 4])
        rows.append((i, " ".join(w), "en", "a", None))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_the_planted_words(spark):
    rows, labels = corpus()
    train = spark.createDataFrame([x for x in labels if x[0] < 160], "id long, y int")
    model = toxicity.fit(frame(spark, rows), train)
    got = {r["id"]: r["score"] for r in toxicity.scores(frame(spark, rows), model).collect()}
    held = [(got[i], y) for i, y in labels if i >= 160]
    assert sum(s >= 0.7 for s, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(s >= 0.7 for s, y in held if not y) <= 0.05 * len(held)
    kept = toxicity.without_toxic(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_awkward_rows_and_missing_classes(spark):
    rows, labels = corpus(90)
    labelled = spark.createDataFrame([*labels, (None, 1), (3, None)], "id long, y int")
    model = toxicity.fit(frame(spark, rows), labelled)
    got = toxicity.scores(frame(spark), model).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scores(frame(spark, []), model).count() == 0
    one = toxicity.fit(frame(spark, rows), labelled.where("y = 0"))
    assert one.trees is None and len({r["score"] for r in toxicity.scores(frame(spark), one).collect()}) == 1
    assert toxicity.fit(frame(spark, rows), labelled.limit(0)).rate == 0.5


def test_held_out_remainder(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(trees=60).fit(x[:1000], y[:1000]).margin(x[1000:])
    assert ((m > 0) == (y[1000:] > 0)).mean() > 0.95
    c = Isotonic().fit(np.arange(100.0), (rng.random(100) < np.arange(100) / 100).astype(float))
    assert (np.diff(c(np.linspace(-5, 120, 300))) >= 0).all()


def test_a_capped_sample_keeps_the_labels_balance(spark):
    rows = [(i, prose(1000 + i, 60), "en", "a", None) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "id long, y int")
    model = toxicity.fit(frame(spark, rows), labels, max_per_class=40)  # texts tell nothing of their labels
    got = [r["score"] for r in toxicity.scores(frame(spark, rows), model).collect()]
    assert 0.08 < np.mean(got) < 0.3


def test_trees_of_a_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (900, 4)).astype(float)
    y, fold = ((x[:, 0] > 20) ^ (x[:, 1] > 30)).astype(int), np.arange(900) % 3
    rows = spark.createDataFrame([(int(k), int(v), r.tolist()) for k, v, r in zip(fold, y, x, strict=True)], "fold int, y int, x array<double>")
    trees, margins = fit_table(rows.repartition(3), 4, 3, (1.0, 1.0), Boosted(trees=12))
    assert np.allclose(trees.margin(x), Boosted(trees=12).fit(x, y.astype(float)).margin(x))
    assert margins.count() == 900 and ((trees.margin(x) > 0) == (y == 1)).mean() > 0.95
    own = Boosted(trees=12).fit(x[fold != 1], y[fold != 1].astype(float)).margin(x[fold == 1])
    assert np.allclose(sorted(r["margin"] for r in margins.where("fold = 1").collect()), sorted(own), atol=0.05)


def test_every_labelled_row_counts(spark, monkeypatch):
    """No row is left out of a fit on the executors, which tells the classes apart."""
    rows, labels = corpus(120)
    monkeypatch.setattr(toxicity, "fit_table", lambda rows, d, folds, w: (seen.append(rows.count()), fit_table(rows, d, folds, w, Boosted(trees=6)))[1])
    seen = []
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "id long, y int"), driver_rows=10)
    assert seen == [120]
    got = {r["id"]: r["score"] for r in toxicity.scores(frame(spark, rows), model).collect()}
    assert min(got[i] for i, y in labels if y) > max(got[i] for i, y in labels if not y)

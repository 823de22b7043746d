"""Toxicity: boosted trees over dense features, with isotonic calibration.

Training uses every labelled row. ``max_per_class`` may bound it to those with the smallest hash of
their id; trees and calibration then weight a row by its label's count over its used count, so that
scores keep to the labels' own balance.

The lexicon is learned: words, and word beginnings of 4 to 6 bytes, that occur in far more toxic
than other documents. Two halves are made by hash; a half's features use the lexicon of the other
half, so that the trees don't learn from words their own labels chose. Scoring uses the lexicon of
both. Toxic documents are counted first; in the others only entries count that are frequent enough
among the toxic ones to enter a lexicon. The driver gets at most ``max_lexicon`` entries a lexicon.
Up to ``driver_rows`` rows of features are fitted on the driver; more are fitted where they are, by
sums of gradients (:func:`boosting.fit_table`), and calibrated from counts by margin.

Features (:data:`FEATURES`): lexicon densities, best window, distinct entries, closeness to
second-person words, capitals, punctuation, and obfuscation (digits or signs inside words, and
words that enter the lexicon only once such signs are read as letters).

Defined cases: null text is empty and gets the score of a text without any feature; rows that
repeat are scored alike; with no labelled row of one class the score is the smoothed base rate for
all; extra columns are kept by :func:`score`, which reserves names starting with ``_tx_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic, fit_table
from .common import materialise, scope
from .textnum import LOWER, Prefix, byte_values, bytes_of, mix, slices, words

FEATURES = [
    "lexicon_density", "prefix_density", "weight_density", "log_hits", "distinct_hits", "best_window", "near_person", "person_density",
    "capitals", "shouted_words", "exclamations", "questions", "punctuation", "digits", "mixed_words", "unmasked_hits", "repeats", "log_words",
]
#: Words that address the reader.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tuyo".split()
#: Signs read as letters.
MASKS = dict(zip("0134578@$!", "oieastbasi", strict=True))
WINDOW = 64
NEAR = 5
DRIVER_ROWS = 16_000  # labelled rows whose features the driver takes
BROADCAST_LABELS = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not (_LETTER[i] or _DIGIT[i])]] = True
_UNMASK = LOWER.copy()
for _a, _b in MASKS.items():
    _UNMASK[ord(_a)] = ord(_b)
_KIND = mix(np.arange(1, 8, dtype=np.uint64))


class Text:
    """A slice's words, trimmed of outer punctuation, with their hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        s, e, self.rows = words(raw, offsets)
        for _ in range(3):
            s = s + ((s < e - 1) & _PUNCT[raw[np.minimum(s, len(raw) - 1)]]) if len(s) else s
            e = e - ((s < e - 1) & _PUNCT[raw[e - 1]]) if len(s) else e
        self.s, self.e = s, e
        p = Prefix(byte_values(LOWER[raw]))
        self.word = p.span(s, e)
        self.prefix = [np.where(e - s > n, p.span(s, np.minimum(s + n, e)) ^ _KIND[n], np.uint64(0)) for n in (4, 5, 6)]
        self.count = np.diff(self.rows)

    def total(self, per_word: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(per_word, dtype=np.float64)])
        return c[self.rows[1:]] - c[self.rows[:-1]]

    def bytes_total(self, mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]


def _word_hash(words_: list[str]) -> np.ndarray:
    column = pa.array(words_)
    return np.sort(Text(*bytes_of(column)).word)


def _weights(keys: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    k, w = lexicon
    if not len(k):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[at] == keys, w[at], 0.0)


def features(t: Text, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of :data:`FEATURES` for each row of the slice."""
    n = np.maximum(t.count, 1)
    size = np.maximum(np.diff(t.offsets), 1)
    whole = _weights(t.word, lexicon)
    begun = np.max([_weights(p, lexicon) for p in t.prefix], axis=0) if len(t.word) else whole
    weight = np.maximum(whole, begun)
    hit = weight > 0
    person = np.isin(t.word, _PERSON)
    reach = np.convolve(person, np.ones(2 * NEAR + 1), "same")[: len(person)] > 0 if len(person) else person
    row_of = np.repeat(np.arange(len(t.count)), t.count)
    hits = t.total(hit)
    at = np.flatnonzero(hit)
    best = np.zeros(len(t.count))
    if len(at):
        ends = np.searchsorted(at, np.minimum(at + WINDOW, t.rows[1:][row_of[at]]))
        np.maximum.at(best, row_of[at], ends - np.arange(len(at)))
    pairs = np.unique(np.stack([row_of[at].astype(np.uint64), np.where(whole[at] > 0, t.word[at], np.max([p[at] for p in t.prefix], axis=0))], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(t.count))
    upper = (t.raw >= 65) & (t.raw <= 90)
    letters = np.maximum(t.bytes_total(_LETTER[t.raw]), 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[t.e] - c[t.s]

    caps = per_word(upper)
    signs = per_word(_PUNCT[t.raw] | _DIGIT[t.raw])
    mixed = (signs > 0) & (per_word(_LETTER[t.raw]) > 0)
    unmasked = np.zeros(len(t.word), bool)
    if mixed.any():
        m = np.flatnonzero(mixed)
        read = Prefix(byte_values(_UNMASK[t.raw])).span(t.s[m], t.e[m])
        unmasked[m] = (_weights(read, lexicon) > 0) & ~hit[m]
    triple = np.zeros(len(t.raw), bool)
    triple[2:] = (t.raw[2:] == t.raw[1:-1]) & (t.raw[1:-1] == t.raw[:-2])
    columns = [
        t.total(whole > 0) / n, t.total(begun > 0) / n, t.total(weight) / n, np.log1p(hits), distinct, best,
        t.total(hit & reach) / np.maximum(hits, 1), t.total(person) / n,
        t.bytes_total(upper) / letters, t.total((caps > 1) & (caps == t.e - t.s)) / n,
        t.bytes_total(t.raw == 33) / size, t.bytes_total(t.raw == 63) / size, t.bytes_total(_PUNCT[t.raw]) / size, t.bytes_total(_DIGIT[t.raw]) / size,
        t.total(mixed) / n, t.total(unmasked), t.bytes_total(triple) / size, np.log1p(t.count),
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


_PERSON = _word_hash(SECOND_PERSON)


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id").alias("_tx_id"), F.col("y").cast("int").alias("_tx_y")).where("_tx_y in (0, 1) and _tx_id is not null").distinct()


def _used(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_per_class: int | None, folds: int) -> DataFrame:
    """The labelled rows, or at most ``max_per_class`` of either class: id, t, y, half, fold."""
    h = F.xxhash64(F.col("_tx_id").cast("string"), F.lit(11))
    rows = _labelled(labels)
    if max_per_class is not None:
        few = [rows.where(F.col("_tx_y") == y).orderBy(h, "_tx_id").limit(max_per_class) for y in (0, 1)]
        rows = few[0].union(few[1])
    rows = materialise(rows, "labels")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_LABELS else rows.hint("merge")
    parts = (F.pmod(F.shiftright(h, at), F.lit(n)).cast("int").alias(name) for at, n, name in ((7, 2, "half"), (8, folds, "fold")))
    return df.join(rows, F.col(f"`{id_col}`") == F.col("_tx_id")).select(F.col("_tx_id").alias("id"), F.col(f"`{text_col}`").alias("t"), F.col("_tx_y").alias("y"), *parts)


def _entry_counts(sample: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """Document frequencies of words and word beginnings, or of those in a sorted array: entry, half, y, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                t = Text(*bytes_of(b.column(1)))
                group = np.array(b.column(2)) * 2 + np.array(b.column(3))
                row_of = np.repeat(np.arange(len(t.count)), t.count)
                keys, rows = np.concatenate([t.word, *t.prefix]), np.tile(row_of, 4)
                if only is not None:
                    known = _known(keys, only)
                    keys, rows = keys[known], rows[known]
                order = np.lexsort((rows, keys))
                keys, rows = keys[order], rows[order]
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                keys, g = keys[first & (keys != 0)], group[rows[first & (keys != 0)]]
                for code in range(4):
                    entry, n = np.unique(keys[g == code], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(np.full(len(entry), code // 2, np.int32)), pa.array(np.full(len(entry), code % 2, np.int32)), pa.array(n.astype(np.int64))], names=["entry", "y", "half", "n"])

    return sample.select("id", "t", "y", "half").mapInArrow(run, "entry bigint, y int, half int, n bigint").groupBy("entry", "half", "y").agg(F.sum("n").alias("n"))


def _known(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys if len(among) else np.zeros(len(keys), bool)


def _least(toxic: int) -> int:
    """Toxic documents that an entry of a lexicon occurs in at least."""
    return max(2, round(0.004 * toxic))


def _counts(sample: DataFrame, totals: dict) -> DataFrame:
    """Counts of all entries that may enter a lexicon. They are few: a document has so many, and each is in 1 of 250 toxic documents."""
    toxic = materialise(_entry_counts(sample.where("y = 1")), "toxic entries")
    enough = toxic.groupBy("entry").agg(*(F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"a{h}") for h in (0, 1)))
    t = [totals.get((1, h), 0) for h in (0, 1)]
    enough = enough.where((F.col("a0") >= _least(t[0])) | (F.col("a1") >= _least(t[1])) | (F.col("a0") + F.col("a1") >= _least(sum(t)))).select("entry")
    only = np.sort(enough.toPandas()["entry"].to_numpy(dtype=np.int64).view(np.uint64))
    return materialise(toxic.join(F.broadcast(enough), "entry").select(toxic.columns).union(_entry_counts(sample.where("y = 0"), only)), "entries")


def _lexica(counts: DataFrame, totals: dict, max_lexicon: int, least_odds: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lexicon of half 0, of half 1, and of both: sorted entries and their log odds."""

    def n(y: int, half: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("half") == half), F.col("n"))), F.lit(0))

    per = counts.groupBy("entry").agg(n(1, 0).alias("a0"), n(1, 1).alias("a1"), n(0, 0).alias("b0"), n(0, 1).alias("b1"))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        a, b = sum(F.col(f"a{h}") for h in halves), sum(F.col(f"b{h}") for h in halves)
        na, nb = (sum(totals.get((y, h), 0) for h in halves) for y in (1, 0))
        odds = F.log((a + 0.5) / (na + 1.0)) - F.log((b + 0.5) / (nb + 1.0))
        top = per.select("entry", odds.alias("w"), a.alias("a")).where((F.col("a") >= _least(na)) & (F.col("w") >= least_odds))
        got = top.orderBy(F.desc(F.col("w") * F.sqrt("a")), "entry").limit(max_lexicon).select("entry", "w").toPandas()
        k = got["entry"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(k)
        out.append((k[order], got["w"].to_numpy(dtype=np.float64)[order]))
    return out


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: Boosted | None
    calibration: Isotonic | None
    rate: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        m = self.trees.margin(x)
        return np.clip(0.999 * self.calibration(m) + 0.001 / (1 + np.exp(-m)), 0.0, 1.0)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_per_class: int | None = None, max_lexicon: int = 4096, least_odds: float = 2.0, folds: int = 3, driver_rows: int = DRIVER_ROWS) -> Model:
    """``labels``: columns id and y (0 or 1); others and nulls are left out."""
    with scope():
        sample = materialise(_used(df, labels, id_col, text_col, max_per_class, folds), "labelled")
        totals = {(r["y"], r["half"]): r["n"] for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
        n1, n0 = (sum(n for (y, _), n in totals.items() if y == k) for k in (1, 0))
        w1 = w0 = 1.0
        if max_per_class is not None:
            share = {r["_tx_y"]: max(1.0, r["n"] / max_per_class) for r in _labelled(labels).groupBy("_tx_y").agg(F.count("*").alias("n")).collect()}
            w1, w0 = share.get(1, 1.0), share.get(0, 1.0)
        rate = (w1 * n1 + 1) / (w1 * n1 + w0 * n0 + 2)
        empty = (np.zeros(0, np.uint64), np.zeros(0))
        if not n1 or not n0:
            return Model(empty, None, None, rate)
        lexica = _lexica(_counts(sample, totals), totals, max_lexicon, least_odds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "t"):
                    t, half = Text(*bytes_of(b.column(1))), np.array(b.column(3))
                    x = np.where(half[:, None] == 0, features(t, lexica[1]), features(t, lexica[0]))
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), b.column(4), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "fold", "x"])

        rows = sample.mapInArrow(run, "id string, y int, fold int, x array<double>")
        if n1 + n0 > driver_rows:
            trees, margins = fit_table(materialise(rows.drop("id"), "features"), len(FEATURES), folds, (w0, w1))
            return Model(lexica[2], trees, calibrated(margins, (w0, w1)), rate)
        rows = rows.toPandas().sort_values("id", kind="stable")
        x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(dtype=np.float64)
        weight = np.where(y == 1, w1, w0)
        weight /= weight.mean()
        fold = rows["fold"].to_numpy()
        margin = np.zeros(len(y))
        for k in range(folds):
            margin[fold == k] = Boosted().fit(x[fold != k], y[fold != k], weight[fold != k]).margin(x[fold == k])
        return Model(lexica[2], Boosted().fit(x, y, weight), Isotonic().fit(margin, y, weight), rate)


def calibrated(margins: DataFrame, class_weight: tuple[float, float], step: float = 2.0**-10) -> Isotonic:
    """Isotonic calibration of all rows (y, margin), which are added up by steps of the margin first."""
    w = F.when(F.col("y") == 1, class_weight[1]).otherwise(class_weight[0])
    got = margins.groupBy(F.floor(F.col("margin") / step).alias("at")).agg(F.avg("margin").alias("m"), F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("p"), F.count("*").alias("n")).orderBy("at").toPandas()
    return Isotonic().fit(got["m"].to_numpy(), (got["p"] / got["w"]).to_numpy(), (got["w"] * got["n"].sum() / got["w"].sum()).to_numpy())


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(features(Text(*bytes_of(b.column(1))), model.lexicon)))], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"id {kind}, score double")


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows scored below the threshold, with all their columns; nothing shuffles."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col):
                s = model(features(Text(*bytes_of(b.column(at))), model.lexicon))
                yield b.filter(pa.array(s < threshold))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def training_labels(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, training_labels(spark, sf_dir))
    return scores(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

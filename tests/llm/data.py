"""Awkward rows that every operator must take: (doc_id, text, lang, source, n_chars)."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words))


def awkward():
    base = prose(1)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", "a", 3),
        (4, base, "en", "a", None),
        (5, base, "en", "b", 1),
        (6, base.replace(" ", "  ", 3), "de", None, 1),
        (7, base, "en", "a", None),
        (7, base, "en", "a", None),
        (8, prose(2), "fr", "a", 2),
        (9, prose(3, 60_000), "en", "a", 3),
        (10, "one", "en", "a", 3),
        (11, "Überaus ñandú 日本語 <|endoftext|> emoji 😀", "es", "c", 4),
        (12, "aaaa " * 400, "en", "a", 5),
    ]
    return rows


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        df = df.withColumns({"id": F.lit("x"), "t": F.lit(1), "v": F.lit(2.0), "kept": F.lit(True), "score": F.lit(0), "keep_id": F.lit(5), "group_size": F.lit(6), "_k": F.lit(7), "_p": F.lit(8), "component_id": F.lit(9), "fp": F.lit("f"), "bad": F.lit(1), "n": F.lit(0)})
    return df

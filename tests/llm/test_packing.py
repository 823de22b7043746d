import random
import zlib

import numpy as np

from tessera.llm import packing

from .data import awkward, frame


def test_pieces_and_places(spark):
    rows = packing.pack_documents(frame(spark), **packing.production()).toPandas()
    ids = packing.load_ids(**packing.production())
    want = []
    for i, t, *_ in awkward():
        x = np.append(ids.own(t or ""), 2).astype("<u4")
        if len(x) <= 1024:
            want.append((i, 0, 0, len(x), zlib.crc32(x.tobytes())))
        else:
            first = len(x) % 1024 or 1024
            at = [0, *range(first, len(x), 1024), len(x)]
            want += [(i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:]))]
    got = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(map(tuple, got)) == sorted(want)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 1024
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]


def test_best_fit_is_the_fullest_bin_that_fits():
    r = random.Random(3)
    fit, filled = packing.BestFit(100, 5), {}
    for _ in range(3000):
        n = r.randint(1, 100)
        free = {b: k for k, stack in enumerate(fit.by_free) for b in stack}
        assert len(free) <= 5 and all(filled[b] == 100 - k for b, k in free.items())
        b, at = fit.place(n)
        fitting = [k for k in free.values() if k >= n]
        if fitting:
            assert free[b] == min(fitting) and at == 100 - free[b]
        else:
            assert at == 0 and b not in filled
            left = {x for stack in fit.by_free for x in stack}
            if len(free) == 5:  # the fullest has closed
                assert min(free.values()) in [free[x] for x in free if x not in left]
        filled[b] = filled.get(b, 0) + n
    assert sum(filled.values()) / len(filled) > 80


def test_both_libraries_agree_below_the_limit():
    ids = packing.load_ids(**packing.production())
    r = random.Random(1)
    pool = [chr(i) for i in range(0x280)]
    for k in range(3000):
        t = "".join(r.choices(pool if k % 2 else list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0ab'sreA1.,é"), k=r.randint(1, 30)))
        assert ids(t, np.frombuffer(t.encode(), np.uint8)).tolist() == ids.own(t).tolist()


def test_empty(spark):
    assert packing.pack_documents(frame(spark, []), **packing.production()).count() == 0

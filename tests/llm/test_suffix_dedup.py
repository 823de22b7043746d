import collections
import hashlib
import random

import numpy as np

from tessera.llm import suffix_dedup as S

from . import windows
from .data import awkward, frame, prose


def brute(texts, n=400):
    places = collections.Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if places[t[p : p + n]] > 1:
                gone[p : p + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.cleaned(df, keep_bytes=False, **limits).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute([(t or "").encode() for _, t in rows])
    assert sorted(map(tuple, got)) == sorted((i, *w) for (i, _), w in zip(rows, want))


def planted():
    r = random.Random(7)
    shared = [prose(100 + k, 90) for k in range(4)]
    rows = []
    for i in range(60):
        t = prose(i, 150)
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 150)
            s = s[a : a + r.randint(380, 500)]
            at = r.randint(0, len(t))
            t = t[:at] + s + t[at:]
        rows.append((i, t))
    rows += [(60, rows[3][1][:-1] + "x"), (61, rows[4][1]), (62, "ab" * 700), (63, "z" * 900), (64, prose(500, 100) * 2), (65, "ü" * 399), (66, "ü" * 450)]
    return rows


def test_against_brute_force(spark):
    check(spark, planted())


def test_many_ranges_and_a_tiny_filter(spark):
    check(spark, planted(), max_filter_bytes=1, per_range=5, sample_rows=50)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in awkward() if i != 9]
    check(spark, rows)
    assert S.cleaned(frame(spark)).count() == len(awkward())


def test_empty(spark):
    assert S.cleaned(frame(spark, [])).count() == 0


def test_prefix_loser_tree_merges_and_knows_prefixes():
    r = random.Random(2)
    runs = [sorted("".join(r.choice("ab") for _ in range(12)).encode() for _ in range(r.randint(0, 40))) for _ in range(7)]
    coded = [S.front_decode(*S.front_code(x)) for x in runs]
    out, last = [], b""
    for lcp, w, i in S.PrefixLoserTree(coded):
        key = coded[w][i][1]
        assert not out or lcp == S.common(last, key, 0)
        out.append(key)
        last = key
    assert out == sorted(k for x in runs for k in x)


def test_window_hashes_find_what_strings_find():
    rng = random.Random(5)
    passage = bytes(rng.choices(b"abcd ", k=450))
    texts = [b"", b"short", passage, passage[:399], b"x" * 900, bytes(rng.choices(b"abcd ", k=300)) + passage[20:] + b"tail", passage[100:] + passage[:100]]
    assert list(windows.expected(list(range(len(texts))), texts).values()) == brute(texts)

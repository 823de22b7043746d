import random

import numpy as np

from tessera.llm import decontaminate as D
from tessera.llm.textnum import bytes_of

from .data import awkward, frame, prose


def planted():
    r = random.Random(9)
    items = [(k, prose(300 + k, r.randint(15, 60)) + ". " + prose(900 + k, 6) + ".") for k in range(40)]
    rows, leaks = [], set()
    for i in range(150):
        w = prose(i, 200).split()
        if i % 3 == 0:
            k = r.randrange(40)
            item = items[k][1].split()
            if i % 2:  # a paraphrase: a tenth of the words replaced
                for j in r.sample(range(len(item)), len(item) // 10):
                    item[j] = "zz" + item[j][::-1]
            at = r.randrange(len(w))
            w[at:at] = item
            leaks.add((i, k))
        rows.append((i, " ".join(w), "en", "a", None))
    return items, rows, leaks


def docs_of(df):
    return df.selectExpr("doc_id AS id", "text AS t")


def test_finds_leaks_and_paraphrases_and_nothing_else(spark):
    items, rows, leaks = planted()
    df = frame(spark, rows, extra=False)
    finder = D.fit(docs_of(df), items, rank=64)
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(df, finder).collect()}
    assert len(found & leaks) >= 0.95 * len(leaks) and not found - leaks
    kept = {r["doc_id"] for r in D.without_leaks(df, finder).collect()}
    assert kept == {i for i, *_ in rows} - {i for i, _ in found}


def test_candidate_recall_against_brute_force(spark):
    items, rows, leaks = planted()
    finder = D.fit(docs_of(frame(spark, rows, extra=False)), items, rank=64)
    import pyarrow as pa

    keys, first = D.word_keys(*bytes_of(pa.array([r[1] for r in rows])))
    # brute force: an item's subsequence in any window of a text
    true = set()
    for row in range(len(rows)):
        text = keys[first[row] : first[row + 1]].tolist()
        for k, it in enumerate(finder.items):
            if len(it.words.intersection(text)) >= 0.6 * len(it.words) and D.lcs(it.masks, it.size, text) >= 0.8 * it.size:
                true.add((row, k))
    got = {(r, i) for r, i, _ in finder.candidates(keys, first)}
    assert true and len(got & true) >= 0.9 * len(true)


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, None), (2, ""), (3, prose(1, 40)), (4, "...")]
    df = frame(spark)
    finder = D.fit(docs_of(df), items, rank=8, fit_passages=50)
    found = {r["doc_id"] for r in D.leaks(df, finder).collect()}
    assert found == {4, 5, 6, 7}
    assert D.without_leaks(df, finder).columns == df.columns
    none = D.fit(docs_of(frame(spark, [])), [], rank=8, fit_passages=50)
    assert D.leaks(df, none).count() == 0 and D.without_leaks(df, none).count() == len(awkward())
    assert D.leaks(frame(spark, []), finder).count() == 0


def test_longest_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = [r.randint(0, 5) for _ in range(r.randint(1, 12))], [r.randint(0, 5) for _ in range(r.randint(0, 12))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert D.lcs(D._masks(a), len(a), b) == t[-1, -1]


def test_the_fit_counts_every_passage(spark):
    import pyarrow as pa

    items, rows, _ = planted()
    bits, rank, half = 10, 8, 24
    finder = D.fit(docs_of(frame(spark, rows, extra=False)), items, bits=bits, rank=rank, rounds=12)
    terms_of = D.Terms(bits)
    keys, first = D.word_keys(*bytes_of(pa.array([r[1] for r in rows])))
    df = np.zeros(1 << bits)
    for a, z in zip(first[:-1], first[1:], strict=True):
        df[np.unique(terms_of(keys[a:z]))] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 1e-3

    def passages(terms):
        for a in range(0, len(terms), half):
            x = np.bincount(terms[a : a + 2 * half], minlength=1 << bits) * idf
            yield x / np.sqrt((idf[terms[a : a + 2 * half]] ** 2).sum())

    texts = np.array([p for a, z in zip(first[:-1], first[1:], strict=True) for p in passages(terms_of(keys[a:z]))])
    own = np.array([p for it in finder.items for p in passages(terms_of(np.array(it.keys, np.uint64)))])
    m = texts.T @ texts + own.T @ own * max(1.0, len(texts) / len(own))
    v, _ = np.linalg.qr(finder.projection / idf[:, None])
    assert np.trace(v.T @ m @ v) > 0.98 * np.linalg.eigvalsh(m)[-rank:].sum()


def test_rows_are_scattered_to_their_terms():
    r = np.random.default_rng(3)
    for n, terms in ((0, 5), (1, 5), (3000, 4), (3000, 900)):
        t, row, y = r.integers(0, terms, n), r.integers(0, 50, n), r.standard_normal((50, 6)).astype(np.float32)
        got, want = np.zeros((terms, 6), np.float32), np.zeros((terms, 6))
        D._scatter(got, t, row, y)
        np.add.at(want, t, y[row])
        assert np.allclose(got, want, atol=1e-3)

import random

import numpy as np
from words import alnum

from tardy.llm.decontaminate import contamination, decontaminate
from tardy.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 3), (50, 3), (400, 5), (300, 70)):
        text = rng.integers(0, sigma, n)
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        index = FMIndex(text, sigma, sample=5)
        for m in (1, 2, 4):
            pats = rng.integers(0, sigma, (40, m))
            lo, hi = index.search(pats)
            for p, a, b in zip(pats.tolist(), lo, hi):
                want = [i for i in range(n - m + 1) if text[i:i + m].tolist() == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_matrix():
    seq = np.array([3, 0, 3, 1, 2, 3, 3])
    w = WaveletMatrix(seq, 4)
    s, r = w.access_rank(np.arange(7))
    assert s.tolist() == seq.tolist() and r.tolist() == [0, 0, 1, 0, 0, 2, 3]
    assert w.rank(np.array([3, 3, 1]), np.array([0, 7, 4])).tolist() == [0, 4, 1]


def brute(text, items, window=10):
    w, hit, found = alnum(text), set(), set()
    for name, t in items:
        q = alnum(t)
        n = min(window, len(q))
        for j in range(len(q) - n + 1 if q else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == q[j:j + n]:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(x for x in found if x is not None)


def fixture():
    rng = random.Random(7)

    def words(n):
        return [rng.choice("the of a cat dog sat on mat é über run far".split()) for _ in range(n)]
    items = [(f"i{i}", " ".join(words(rng.choice((0, 3, 9, 10, 11, 25))))) for i in range(20)] + [(None, "null item words here"), ("i1", "same id again"), ("e", None)]
    docs = []
    for d in range(60):
        w = words(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((d, ", ".join(w)))
    return docs + [(60, None), (61, ""), (62, "null-item!words\nHERE"), (62, "null-item!words\nHERE"), (None, items[5][1])], items


def test_contamination_against_brute_force(spark, monkeypatch):
    docs, items = fixture()
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    for chars in (1 << 20, 100):                      # one block of phrases, and many
        monkeypatch.setattr("tardy.llm.decontaminate.BLOCK_CHARS", chars)
        got = contamination(df, bench).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
        assert all(r["n_hit"] == sum(s["last"] - s["first"] + 1 for s in r["spans"]) for r in got)
    assert contamination(df.limit(0), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in contamination(df, bench.limit(0)).collect())


def test_decontaminate_leaves_no_occurrence(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, _text string")
    out = decontaminate(df, spark.createDataFrame(items, "item_id string, text string"))
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(docs) and all(brute(r["text"], items)[1] == 0 for r in rows)
    clean = {i: t for i, t in docs if i is not None and not brute(t, items)[1]}
    assert clean and all(r["text"] == clean[r["doc_id"]] for r in rows if r["doc_id"] in clean)
    cut = decontaminate(spark.createDataFrame([("Keep (one) two three four, five six seven eight nine ten! rest",)], "text string"),
                        spark.createDataFrame([("a", "one two three four five six seven eight nine ten")], "item_id string, text string")).first()[0]
    assert cut == "Keep (! rest"

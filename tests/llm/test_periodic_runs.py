import hashlib
import random
import zlib

import numpy as np
import pytest

from tardy.llm import periodic_runs as pr
from tardy.llm.queries import op13_periodic_runs, repeat_tails
from tardy.llm.suffix_tree import SuffixTree


def brute(w, min_length=24, repeats=3):
    """Maximal stretches with period q whose words q apart agree, q the least period."""
    out, n = [], len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(min_length, repeats * q) and not any(w[i:i + size - p] == w[i + p:i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        unit = [f"t{rng.randrange(rng.choice([1, 2, 3, 9]))}" for _ in range(rng.randrange(1, 12))]
        w += unit * rng.randrange(1, 8) + unit[:rng.randrange(len(unit) + 1)]
    return w


def test_suffix_tree_against_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        s = np.append(rng.integers(0, int(rng.integers(1, 4)), n), 9)
        tree = SuffixTree(s)
        x = s.tolist()
        order = sorted(range(n + 1), key=lambda i: x[i:])
        assert [int(np.flatnonzero(tree.rank == k)[0]) for k in range(n + 1)] == order
        i, j = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        for a, b, got in zip(i, j, tree.lce(i, j)):
            k = 0
            while max(a, b) + k <= n and x[a + k] == x[b + k]:
                k += 1
            assert got == k


@pytest.mark.parametrize("min_length", [3, 7, 24])
def test_runs_against_brute_force(min_length):
    rng = random.Random(min_length)
    for _ in range(400):
        w = repeated(rng)
        names = sorted(set(w))
        got = pr.runs(np.array([names.index(x) for x in w], np.int64), min_length)
        assert sorted(map(tuple, got.tolist()), key=lambda r: (r[0], r[2])) == brute(w, min_length)
    # documents of one batch are cut into parts that share a tree
    texts = [repeated(rng) for _ in range(60)]
    count, found = pr.document_runs([" ".join(t) for t in texts], min_length)
    assert count.tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == brute(t, min_length)


def test_query_and_edge_cases(spark):
    rng = random.Random(9)
    rows = [(i, " \n".join(repeated(rng)) if i % 3 else " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 300)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t "), (503, rows[1][1]), (503, rows[1][1]), (None, rows[1][1]), (504, "a " * 50_000), (505, "Same same " * 20),
             (506, "x y " * 30), (507, " ".join(f"u{k % 4000}" for k in range(13_000)))]
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, runs int").repartition(3)
    assert pr.periodic_runs(df.limit(0)).count() == 0
    made = pr.periodic_runs(df)
    assert made.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t in rows:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        found = brute(w) if len(w) < 5000 else ([(0, 50_000, 1)] if i == 504 else [(0, 13_000, 4000)])
        gone = {p for s, n, q in found for p in range(s + q, s + n)}
        want.append((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in made.collect()), key=str) == sorted(want, key=str)


def test_query_digests(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(repeated(rng)) or None) for i in range(150)] + [(200, None), (201, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    edited = 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            edited += 1
        assert (repeat_tails([i], [t])[0] or "").split() == w
        found = brute(w)
        gone = {p for s, m, q in found for p in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert edited > 5

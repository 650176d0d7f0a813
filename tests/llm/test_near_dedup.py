import random

import numpy as np
import pytest
from words import shingle_set

from tardy.llm.components import connected_components, union_find
from tardy.llm.near_dedup import band_plan, block_links, drop_near_duplicates, near_duplicates, superminhash
from tardy.llm.text import mix

U = np.uint64


def plain_superminhash(elements, m):
    """Signature of one set, an element at a time."""
    sig = [(1 << 64) - 1] * m
    for x in elements:
        perm = list(range(m))
        for j in range(m):
            r = int(mix(np.array([x], U) + U(((j + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))[0])
            k = j + ((r >> 32) * (m - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            sig[perm[j]] = min(sig[perm[j]], (r & 0xFFFFFFFF) | j << 32)
    return sig


def test_superminhash_equals_the_plain_form():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 62, n).astype(U) for n in (1, 2, 7, 40, 300)] + [np.zeros(0, U)]
    v, d = np.concatenate(sets), np.repeat(np.arange(6), [len(s) for s in sets])
    got = superminhash(v, d, 6, 24)
    for i, s in enumerate(sets):
        assert got[i].tolist() == plain_superminhash(s.tolist(), 24)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 700).astype(U)
    a, b = base[:600], base[100:]
    s = superminhash(np.concatenate((a, b)), np.repeat([0, 1], 600), 2, 512)
    assert abs((s[0] == s[1]).mean() - 500 / 700) < 0.07


def test_band_plan_bounds_the_miss():
    for percent in (80, 85, 95):
        p = band_plan(percent)
        assert (1 - (percent / 100) ** p.rows) ** p.bands <= 1e-6


def test_block_links_counts_exactly():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50))), U) for _ in range(25)]
    got = block_links(sets, sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert got[i, j] == (both > 0 and 100 * both >= 50 * (len(a) + len(b) - both))


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_union_find_and_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    want = {x: c for x, c in components(edges).items() if x != c}
    u, v = union_find(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(u.tolist(), v.tolist())) == want
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == want
    assert connected_components(df.limit(0), "a", "b").count() == 0


def brute(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    edges = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return components(edges + [(i, i) for i, _ in sets])


def corpus(seed=4):
    rng = random.Random(seed)

    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, base = [], text(120)
    for i in range(60):                       # a chain of ever more edited copies, with pairs on either side of the threshold
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        if i % 7 == 0:
            base = w
    rows += [(100 + i, " ".join(text(rng.randrange(1, 40)))) for i in range(30)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(20)] + [(300, "One two"), (301, "one  TWO\n"), (302, "one two three")]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_duplicates(df, percent=percent).collect()}
    want = brute(rows, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingle_set(dict(rows)[i])) for i, r in got.items())


def test_small_blocks_give_the_same_components(spark, monkeypatch):
    import tardy.llm.near_dedup as nd

    monkeypatch.setattr(nd, "_BLOCK", 5)
    monkeypatch.setattr(nd, "_MEMBERS", 3)
    monkeypatch.setattr(nd, "_COLUMNS", 7)
    rows = corpus(9)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == brute(rows, 85)


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "a b c d e f", 1), (4, "a b c d e f", 1), (5, "A b c d e F", 2), (None, "a b c d e f", 3),
            (None, None, 4), (6, long, 5), (7, long + " z", 5), (None, "only here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")     # a column named like an output
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (None, 2, 4, False),
            (None, 0, None, True), (6, 29_996, 6, True), (7, 29_997, 6, False), (None, 1, None, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).collect() == []
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r[0] is None, r[0]) for r in left.collect() if r[0] is not None) == [(False, i) for i in (1, 2, 3, 4, 4, 6)]
    assert left.where("doc_id is null").count() == 3


def test_ids_with_several_texts(spark):
    """Texts of one id are linked; dropping leaves no text without a copy."""
    from tardy.llm.near_dedup import drop_near_duplicates, near_duplicates

    def text(i, n=60):
        return " ".join(f"a{i}x{j}" for j in range(n))
    rows = [(5, text(1)), (5, text(2)), (3, text(2)), (8, text(3)), (8, text(4)), (8, text(4) + " one more"), (9, text(5)), (9, text(5)), (None, text(1)), (7, text(4))]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, __several int").repartition(3)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, percent=85).collect()}
    assert got == {(5, 3, False), (3, 3, True), (8, 7, False), (7, 7, True), (9, 9, True), (None, 3, False)}
    left = drop_near_duplicates(df.drop("__several"), percent=85).collect()
    texts = [r["text"] for r in left if r["doc_id"] is not None]
    assert sorted(t[:2] for t in set(texts)) == ["a1", "a2", "a3", "a4", "a5"]
    assert sum(t.startswith("a4") for t in texts) == 1 and sum(t.startswith("a2") for t in texts) == 1 and sum(t.startswith("a5") for t in texts) == 2

import math
import random
from collections import Counter

import numpy as np
import pytest

from tardy.llm import lexical_search as ls
from words import lower

import re


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)) if text is not None else []


def brute(docs, items, k):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    total, length = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 75 + (75 * n * total) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "A1", "x"]

    def text(n):
        return " ".join(pool[min(rng.randrange(len(pool)), rng.randrange(len(pool)))] + rng.choice(["", ",", "!", "--", "_"]) for _ in range(n))
    docs = [(i * 7 % 301, text(rng.randrange(0, 60))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " ,. "), (1003, docs[5][1]), (1003, docs[5][1]), (None, docs[6][1]), (-4, docs[6][1]), (1004, "rare " * 30_000 + "w0")]
    items = [(i, text(rng.randrange(1, 15))) for i in range(25)] + [(90, None), (91, "..."), (92, "unknown"), (93, "RARE w0 w0 rare"), (93, "x"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("block,batch,k", [(1 << 20, 1 << 20, 10), (300, 2000, 3)])
def test_against_brute_force(spark, tables, monkeypatch, block, batch, k):
    monkeypatch.setattr(ls, "BLOCK_CHARS", block)
    docs, items = tables
    d = spark.createDataFrame([(t, i, 7) for i, t in docs], "text string, doc_id long, score int").repartition(5)
    q = spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id long, rank int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch // 50))
    got = ls.search(d, q, k=k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(d.limit(0), q).count() == 0 and ls.search(d, q.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    assert ls.search(nothing, q).count() == 0


def test_accumulators_stop_and_stay_exact():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, k = int(rng.integers(1, 80)), int(rng.integers(1, 6))
        lists = []
        for _ in range(int(rng.integers(1, 8))):
            doc = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            lists.append((doc, rng.integers(1, 10 ** int(rng.integers(1, 5)), len(doc))))
        lists.sort(key=lambda x: len(x[0]))
        full = np.zeros(n, np.int64)
        for doc, share in lists:
            full[doc] += share
        at, score = ls.accumulate(lists, n, k)
        assert (full[at] == score).all()
        want = sorted((-full[i], i) for i in range(n) if full[i] > 0)[:k]
        assert sorted((-s, i) for i, s in zip(at, score))[:k] == want
    # once the bounds of the rest cannot reach the k-th partial score, nothing is created
    at, _ = ls.accumulate([(np.array([0, 1]), np.array([90, 80])), (np.arange(50), np.full(50, 3))], 50, 2)
    assert at.tolist() == [0, 1]
    at, _ = ls.accumulate([(np.array([0, 1]), np.array([90, 3])), (np.arange(50), np.full(50, 3))], 50, 2)
    assert len(at) == 50                                      # a tie with the k-th is still possible

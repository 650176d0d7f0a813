import hashlib
import random
from collections import Counter

import pytest

from tardy.llm import weighted_sampling as ws


def jaccard(a, b):
    def bag(t):
        w = ["", *(t or "").split(), ""] if (t or "").split() else ["", "", ""]
        return Counter(zip(w, w[1:]))
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values())


def edited(a, b):
    h = len(a) // 2
    return a[:len(a) - h] + b[:h]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(150):
        out.append((i * 3, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 200)))))
    return out + [(1000, None), (1001, ""), (1002, "é"), (1003, "odd one 😀 x"), (1004, out[4][1]), (1005, " \n ")]


@pytest.mark.parametrize("bucket", [4_000_000, 1500])
def test_against_brute_force(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(ws, "BUCKET_CHARS", bucket)
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, n_chars long").repartition(4)
    got = {r["doc_id"]: r for r in ws.fingerprint_edits(df).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    prints = {(t or ""): got[i]["fingerprint"] for i, t in rows}
    error = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt, r = t or "", nxt or "", got[i]
        e = edited(t, nxt)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == prints[t]
        if e in prints:
            assert r["edited_fingerprint"] == prints[e]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        error += [r["near_edited"] - jaccard(t, e), r["near_next"] - jaccard(t, nxt)]
        if t.split() == nxt.split():
            assert r["near_next"] == 1.0
    assert abs(sum(error) / len(error)) < 0.02                  # the collision rate is the generalised Jaccard similarity
    assert (sum(x * x for x in error) / len(error)) ** 0.5 < 0.12
    assert got[1000]["fingerprint"] == got[1001]["fingerprint"] == got[1005]["fingerprint"]


def test_edge_cases(spark):
    one = spark.createDataFrame([(7, "alone in here")], "doc_id long, text string")
    r = ws.fingerprint_edits(one).first()
    assert r["edited_sha256"] == hashlib.sha256(edited("alone in here", "alone in here").encode()).hexdigest() and r["near_next"] == 1.0
    assert ws.fingerprint_edits(one.limit(0)).count() == 0
    rep = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (None, "null id"), (None, None)], "doc_id long, text string")
    got = ws.fingerprint_edits(rep).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == [("1", 4), ("1", 4), ("1", 5), ("None", 0), ("None", 7)]
    long = "word " * 60_000
    assert ws.fingerprint_edits(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")).where("n_chars = 300000").count() == 1


def test_repeated_pairs_keep_their_weight(spark):
    """The mean error over many texts with a few very frequent pairs is that of
    the generalised Jaccard similarity, at both ends of the scale."""
    rng = random.Random(4)

    def own(i, n):
        return " ".join(f"d{i}x{rng.randrange(10 ** 6)}" for _ in range(n))
    a = [(f"ha{i} " * 3000 + own(i, 400), f"ha{i} " * 3000 + own(-i, 400)) for i in range(1, 25)]                # about 0.79
    a += [(f"buy{i} now " * 300 + own(i, 1200), f"buy{i} now " * 900 + own(-i, 1200)) for i in range(25, 49)]    # about 0.14
    a += [(own(i, 3000), own(-i, 30)) for i in range(49, 52)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i long, a string, b string")
    sa, sb = (ws.samples(df, ["i"], c).withColumnRenamed("sig", f"s{c}") for c in "ab")
    got = dict(sa.join(sb, "i").select("i", ws.likeness("sa", "sb")).collect())
    error = [got[i] - jaccard(*x) for i, x in enumerate(a)]
    assert abs(sum(error[:24]) / 24) < 0.06 and abs(sum(error[24:48]) / 24) < 0.06
    assert max(map(abs, error)) < 0.35

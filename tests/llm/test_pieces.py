import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tardy.llm.piece_lattice import Lattices, default_model, load, sample_segmentations
from tardy.llm.piece_sampling import decode_pieces, sample_pieces


@pytest.fixture(scope="module")
def pieces():
    return load(default_model())


def segmentations(pieces, text):
    """All ways to cut " text" (one unit) into pieces, with normalised log p."""
    raw, out = (" " + text).encode(), []
    table = {}
    for i, b in enumerate(pieces.bytes):
        state = 1
        for c in b:
            state = int(pieces.next[state, c])
        if b and state and pieces.final[state] == i:
            table[b] = (i, float(pieces.logp[state]))

    def go(at, ids, lp):
        if at == len(raw):
            out.append((tuple(ids), lp))
            return
        for n in range(1, pieces.longest + 1):
            if raw[at:at + n] in table and at + n <= len(raw):
                i, p = table[raw[at:at + n]]
                go(at + n, [*ids, i], lp + p)
    go(0, [], 0.0)
    z = math.log(sum(math.exp(lp) for _, lp in out))
    return {ids: lp - z for ids, lp in out}


def test_all_segmentations_without_replacement(pieces):
    want = segmentations(pieces, "then")
    (got,) = sample_segmentations(pieces, ["then"], np.array([5]), len(want) + 4)
    assert {tuple(i.tolist()) for i, _, _ in got} == set(want) and len(got) == len(want)
    for ids, lp, inclusion in got:
        assert abs(lp - want[tuple(ids.tolist())]) < 1e-6 and inclusion == 0.0     # all are in the sample


def test_frequencies_follow_the_distribution(pieces):
    """First draws follow p; second draws follow p without the first."""
    want = segmentations(pieces, "quelo")
    n = 6000
    got = sample_segmentations(pieces, ["quelo"] * n, np.arange(n), 2)
    first = Counter(tuple(x[0][0].tolist()) for x in got)
    second = Counter(tuple(x[1][0].tolist()) for x in got)
    p = {k: math.exp(v) for k, v in want.items()}
    q = {k: sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k) for k in p}
    for seen, law in ((first, p), (second, q)):
        for k, v in law.items():
            assert abs(seen[k] / n - v) < 4 * math.sqrt(v * (1 - v) / n) + 1e-3
    assert all(x[0][0].tolist() != x[1][0].tolist() for x in got)


def test_inclusion_scores_estimate_totals(pieces):
    """Sum over the sample of f / inclusion is an unbiased estimate (here of 1 = sum of p)."""
    n = 4000
    got = sample_segmentations(pieces, ["mentre"] * n, np.arange(n), 3)
    est = np.array([sum(math.exp(lp - inc) for _, lp, inc in x) for x in got])
    assert abs(est.mean() - 1) < 4 * est.std() / math.sqrt(n) + 5e-3


def log_total(pieces, raw):
    """Log of the total weight of all ways to cut ``raw``, a byte at a time."""
    table = {}
    for i, b in enumerate(pieces.bytes):
        state = 1
        for c in b:
            state = int(pieces.next[state, c])
        if b and state and pieces.final[state] == i:
            table[b] = float(pieces.logp[state])
    total = [-math.inf] * len(raw) + [0.0]
    for at in range(len(raw) - 1, -1, -1):
        ways = [table[raw[at:at + n]] + total[at + n] for n in range(1, pieces.longest + 1) if at + n <= len(raw) and raw[at:at + n] in table]
        top = max(ways, default=-math.inf)
        total[at] = top + math.log(sum(math.exp(w - top) for w in ways)) if top > -math.inf else top
    return total[0], table


@pytest.mark.parametrize("text", ["thequickbrownfox" * 13, "漢字仮名交じり文" * 30, "q" * 3000, "ab" * 20_000])
def test_long_runs_are_one_lattice(pieces, text):
    """A run without spaces is not cut: log p is the piece weights less the
    whole run's total, and a piece may lie anywhere."""
    raw = (" " + text).encode()
    ends = set()
    for key in range(4):
        known = [b for b in raw.decode() if b.encode() in pieces.single]
        for ids, lp, inclusion in sample_segmentations(pieces, [text], np.array([key]), 3)[0]:
            assert pieces.decode(ids.tolist()) == text and inclusion <= 1e-9
            if len(known) == len(raw.decode()):
                total, table = log_total(pieces, raw) if not ends else (keep, table)
                keep = total
                assert abs(lp - (sum(table[pieces.bytes[i]] for i in ids.tolist()) - total)) < 1e-6 * max(1, len(raw) / 100)
            ends |= set(np.cumsum([len(pieces.bytes[i]) for i in ids.tolist()]).tolist())
    assert len(ends) > 3


def test_little_mass_is_kept(pieces):
    """The rest beside a piece that takes nearly all is the sum of the others, never zero."""
    buf = np.frombuffer(b" the of and", np.uint8)
    lat = Lattices(pieces, buf, np.array([0, 4, 7]), np.array([4, 7, 11]))
    node = np.repeat(np.arange(len(lat.first) - 1), np.diff(lat.first))
    for e in range(len(lat.p)):
        others = [lat.p[x] for x in range(len(lat.p)) if node[x] == node[e] and x != e]
        assert math.isclose(lat.rest[e], sum(others), rel_tol=1e-9, abs_tol=1e-300) and (lat.rest[e] > 0) == bool(others)


def test_round_trip_distinct_and_repeatable(pieces):
    texts = ["", "a", " lead  and trail ", "Hello world\n\n漢😀é ▁z" + "q" * 300, "\x00\x7f\t", "é" * 200, "x" * 44, "ciónmente que los " * 400]
    keys = np.arange(len(texts))
    got = sample_segmentations(pieces, texts, keys, 4)
    for t, x in zip(texts, got):
        assert all(pieces.decode(i.tolist()) == t for i, _, _ in x)
        assert len({tuple(i.tolist()) for i, _, _ in x}) == len(x)
        assert all(inc <= 1e-9 and lp <= 1e-9 for _, lp, inc in x)
    assert len(got[0]) == 1 and all(len(x) == 4 for x in got[2:4])
    alone = sample_segmentations(pieces, [texts[2]], keys[2:3], 4)[0]               # neighbours do not matter
    assert [i.tolist() for i, _, _ in alone] == [i.tolist() for i, _, _ in got[2]]
    other = sample_segmentations(pieces, [texts[7]], np.array([99]), 1)[0]
    assert other[0][0].tolist() != got[7][0][0].tolist()


def test_dataframe_form(spark):
    rows = [(1, "some text here", 7), (1, "some text here", 8), (2, None, 9), (None, "null id", 1), (3, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    out = sample_pieces(df.withColumnRenamed("sample", "extra").withColumn("ids", F.lit(5)), k=3)
    assert out.columns == ["doc_id", "extra", "sample", "n_ids", "ids", "log_prob", "log_inclusion", "round_trip"]
    back = decode_pieces(out).collect()
    assert all(r["round_trip"] for r in back)
    assert {(r["extra"], r["text"]) for r in back} == {(7, "some text here"), (8, "some text here"), (9, ""), (1, "null id"), (2, "")}
    assert [r["ids"] for r in back if r["extra"] == 7] == [r["ids"] for r in back if r["extra"] == 8]
    assert all(r["n_ids"] == len(r["ids"]) for r in back) and sum(r["extra"] == 7 for r in back) == 3
    assert sample_pieces(df.limit(0)).count() == 0
    assert decode_pieces(spark.createDataFrame([(None,)], "ids array<int>")).first()["text"] is None


def test_an_entry_is_split_in_one_look(monkeypatch):
    """Paths of ordinary texts are looked at once when they split an entry, and
    how much is looked at first changes no sample."""
    from tardy.llm import piece_lattice as pl

    pieces, rng = pl.load(pl.default_model()), np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("etaoinsh一\u0007"), 6)) for _ in range(n)) for n in (3, 90, 300)]
    keys, looks, real = np.arange(3).astype(np.uint64), [], pl._open

    def noted(lat, agenda, path, t, before, without, draws, k):
        real(lat, agenda, path, t, before, without, lambda n: looks.append(n) or draws(n), k)

    monkeypatch.setattr(pl, "_open", noted)
    found = pl.sample_segmentations(pieces, texts, keys, 3)
    assert len(looks) == 9
    monkeypatch.setattr(pl, "_LIMIT", 16)
    again = pl.sample_segmentations(pieces, texts, keys, 3)
    assert len(looks) > 18
    for a, b in zip(found, again):
        assert [(x[0].tolist(), *x[1:]) for x in a] == [(x[0].tolist(), *x[1:]) for x in b]
        assert len({tuple(x[0].tolist()) for x in a}) == 3


def test_units_met_before_are_not_built_again(pieces, monkeypatch):
    """A batch builds the lattices of units that are new to the process; what is
    remembered, and how much of it, changes no sample."""
    from tardy.llm import piece_lattice as pl

    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("etaoinsh一\u0007"), 3)) for _ in range(n)) for n in (0, 5, 60, 400)]
    keys, built, real = np.arange(4).astype(np.uint64), [], pl.Lattices.__init__

    def noted(self, pieces, buf, s, e):
        built.append(len(s))
        real(self, pieces, buf, s, e)

    def plain(found):
        return [[(x[0].tolist(), *x[1:]) for x in f] for f in found]

    monkeypatch.setattr(pl.Lattices, "__init__", noted)
    monkeypatch.setattr(pieces, "memory", pl.LatticeMemory())
    first = plain(pl.sample_segmentations(pieces, texts, keys, 3))
    assert plain(pl.sample_segmentations(pieces, texts, keys, 3)) == first and sum(built[1:]) == 0
    pl.sample_segmentations(pieces, [texts[2] + " quite new"], keys[:1], 3)
    assert sum(built[1:]) == 2
    for kept in (0, 100, 3000):                                # full at once, or soon: the rest lasts one batch
        monkeypatch.setattr(pl, "KEPT_EDGES", kept)
        pieces.memory = pl.LatticeMemory()
        for lo in (2, 0, 3, 1):
            assert plain(pl.sample_segmentations(pieces, texts[lo:lo + 1], keys[lo:lo + 1], 3)) == first[lo:lo + 1]
        assert pieces.memory.edges <= kept


def test_byte_trie_takes_all_steps_and_no_other():
    from tardy.llm.piece_lattice import ByteTrie

    rng = np.random.default_rng(3)
    words, nodes, children = {bytes(rng.integers(0, 256 if i % 2 else 4, rng.integers(1, 5)).astype(np.uint8)) for i in range(800)}, {b"": 0}, [{}]
    for w in sorted(words):
        for n in range(1, len(w) + 1):
            if w[:n] not in nodes:
                nodes[w[:n]] = len(children)
                children[nodes[w[:n - 1]]][w[n - 1]] = len(children)
                children.append({})
    trie = ByteTrie(children)
    assert trie.slot[0] == 1 and len(set(trie.slot.tolist())) == len(children) and trie.slot.min() > 0
    for node, steps in enumerate(children):
        want = np.zeros(256, np.int64)
        want[list(steps)] = trie.slot[list(steps.values())]
        assert (trie[int(trie.slot[node]), np.arange(256)] == want).all()
    assert not trie[0, np.arange(256)].any()

import random

import pytest

from tardy.llm import word_bpe as wb

TEXTS = ["", "  ", "aaaaaaaaaaaaaaaaa bbbbbbb aaab", "<|endoftext|>x<|startoftext|><|startoftext| <|<|endoftext|>|>", "don't DON'T 's's 've ll'll 'Tis",
         "a</w>b </w>", "日本語 テスト Ünïcödé é ́x é İstanbul ẞ ß ǅ", "x\x1cy\x85z w v​q　r\tt\r\nu", "12345 ١٢٣ ½ ² Ⅷ 1st",
         " 😀😀 zzzz😀", "HAHAHAHAHAHAHAHA lolololol ........ !!!!!!!!!!! ---------", "\x00\x01 \x7f", None]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = list(TEXTS)
    pools = ["ab", "abc", "aeinrst", "the anding ", "hello wrd's.,!?<|>/ \n", "abcdefghijklmnopqrstuvwxyz  ", "éèüñ日本ａ１２ .'́", "0123456789 -=_", "\x1c\x1d \t\x0b\x0cab"]
    for _ in range(1500):
        pool = rng.choice(pools)
        out.append("".join(rng.choice(pool) for _ in range(rng.randrange(60))))
    return out + ["".join(rng.choice("abcdefghij") for _ in range(40_000)), "word " * 30_000, "é" * 5000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wb.default_tokenizer())


def test_equals_the_library(spark, texts, library):
    rows = [(t, i, "x", [i]) for i, t in enumerate(texts)] + [(texts[4], 4, "y", None)]
    df = spark.createDataFrame(rows, "text string, doc_id long, decoded string, ids array<int>").repartition(3)
    made = wb.decode_ids(wb.encode_texts(df))
    assert sorted(made.columns) == sorted(df.columns)         # clashing columns are replaced
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want, texts[r["doc_id"]]
        assert r["decoded"] == library.decode(want, skip_special_tokens=False) and r["text"] == texts[r["doc_id"]]
    assert wb.encode_texts(df.limit(0)).count() == 0
    both = wb.encode_texts(df, decoded="decoded")
    assert sorted(both.columns) == sorted(df.columns)
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in both.collect()) == sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got)


def test_memory_limit_changes_nothing(texts, library, monkeypatch):
    monkeypatch.setattr(wb, "MEMORY", 1000)
    with open(wb.default_tokenizer(), encoding="utf-8") as f:
        bpe = wb.WordBPE(f.read())
    for lo in range(0, 300, 20):
        ids, cut = bpe.encode(texts[lo:lo + 20])
        for i in range(20):
            assert ids[cut[i]:cut[i + 1]].tolist() == library.encode(texts[lo + i] or "", add_special_tokens=False).ids
    bpe.plain = None                                          # the library's own word rules alone
    bpe.forget()
    ids, cut = bpe.encode(texts[:300])
    assert [ids[cut[i]:cut[i + 1]].tolist() for i in range(300)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[:300]]


def test_decoding_other_ids(spark, library):
    df = spark.createDataFrame([([320, None, 49407, 999_999, -3],), ([],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in wb.decode_ids(df).collect()] == [library.decode([320, 49407], skip_special_tokens=False), "", ""]


def test_trie_shares_prefixes():
    trie = wb.WordTrie()
    for i, w in enumerate(["abcd", "abce", "ab", "x", "abcd"]):
        trie.insert(w, i)
    edge, node = trie.root[0]["a"]
    assert edge == "ab" and node[1] == 2 and set(trie.root[0]) == {"a", "x"}
    edge, node = node[0]["c"]
    assert edge == "c" and {c: n[1] for c, (_, n) in node[0].items()} == {"d": 4, "e": 1}


def test_neighbours_against_merging(library):
    """The local test of two tokens agrees with merging their symbols by rank."""
    with open(wb.default_tokenizer(), encoding="utf-8") as f:
        bpe = wb.WordBPE(f.read())

    def merged(ids):
        while True:
            ranks = [(bpe.merge[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in bpe.merge]
            if not ranks:
                return ids
            _, i = min(ranks)
            k = next(t for t in range(len(bpe.rank)) if bpe.rank[t] == min(ranks)[0])
            ids = ids[:i] + [k] + ids[i + 2:]

    def atoms(t):
        return [t] if bpe.rank[t] < 0 else atoms(bpe.left[t]) + atoms(bpe.right[t])
    rng = random.Random(1)
    short = [i for i, n in enumerate(bpe.length) if 0 < n < 4 and library.id_to_token(i).find("</w>") < 0]
    for _ in range(150):
        a, b = rng.choice(short[:600]), rng.choice(short[:600])
        assert bpe.compatible(a, b) == (merged(atoms(a) + atoms(b)) == [a, b]), (a, b)


def test_learning_is_not_searched_for_cycles():
    """The collector stays off while words are learnt, and on after that, also
    when learning fails."""
    import gc

    bpe = wb.WordBPE(open(wb.default_tokenizer(), encoding="utf-8").read())
    words = {f"{i:x}q{i * 7919:x}" for i in range(20_000)}
    runs = []
    note = lambda phase, info: runs.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        bpe.learn(words)
    finally:
        gc.callbacks.remove(note)
    # what the allocations before and after it ask for, not one for each thousand words
    assert len(runs) <= 4 and gc.isenabled() and words <= bpe.known.keys()
    some = sorted(words)[:50]
    ids, cut = bpe.encode(some)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [bpe.tool.encode(w, add_special_tokens=False).ids for w in some]
    with pytest.raises(AttributeError):
        bpe.learn({None})
    assert gc.isenabled()


def test_levels_of_the_trie_agree_with_depth_first(texts, library, monkeypatch):
    """Words by levels, in numpy, have the ids of the walk through the trie;
    words of any length go either way.  Before, each word went alone."""
    with open(wb.default_tokenizer(), encoding="utf-8") as f:
        bpe = wb.WordBPE(f.read())
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aehlnorst'\xc3\xc4\x00\xff") for _ in range(rng.randrange(1, 50))) for _ in range(3000)} | {"a", "ab", "abc", "abd"})
    ids, n = bpe.encode_levels(words)
    ids = ids.tolist()
    want = bpe.encode_words([w[:-1] + chr(ord(w[-1]) + 256) for w in words])
    at = 0
    for size, w in zip(n.tolist(), want):
        assert ids[at:at + size] == w
        at += size
    pairs = [(rng.randrange(400), rng.randrange(49_000)) for _ in range(5000)]
    a, b = (wb.np.array(x, wb.np.int64) for x in zip(*pairs))
    assert bpe._compatible_many(a, b).tolist() == [bpe.compatible(*p) for p in pairs]
    for places, levels in ((4, 32), (1 << 19, 0), (1 << 19, 3)):
        monkeypatch.setattr(wb, "_PAIRS", places)
        monkeypatch.setattr(wb, "LEVELS", levels)
        bpe.forget()
        some = texts[:400]
        got, cut = bpe.encode(some)
        assert [got[x:y].tolist() for x, y in zip(cut, cut[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_stretches_are_cut_together(library):
    """One call of the tokenizer's rules serves all stretches, also beside
    stretches that hold odd spaces or special tokens."""
    with open(wb.default_tokenizer(), encoding="utf-8") as f:
        bpe = wb.WordBPE(f.read())
    calls, real = [], bpe._words
    bpe._words = lambda s: calls.append(s) or real(s)
    text = " ".join(["ΟΔΟΣ", "ΣΑΣ", "́x", "Ünïcödé", "日本語テスト", "don't", "½²Ⅷ", "é", "가", "각", "İ"] * 3)
    odd = ["a b", " ", " é", "é​é", "x\x1cy", "<|endoftext|>é"]
    for t in (text, " ".join([*odd, text]), *odd):
        ids, cut = bpe.encode([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids and cut.tolist() == [0, len(ids)], t
    assert set(calls) <= set(odd)

import math
import zlib

import numpy as np
import pytest

from tardy.llm.langid import NgramFilters, has_letter, ngrams, predict_language, train_language
from tardy.llm.quality import FEATURES, PASSAGE_WORDS, GatedAttention, fit_quality, passages, score_quality
from tardy.llm.text import mix

SF = "/root/testdata/sf0.01"


def test_filters_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    grams = {f"l{i}": mix(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for i in range(70)}        # more than one mask word
    f = NgramFilters.build(grams)
    for i, (lang, g) in enumerate(sorted(grams.items())):
        assert f.languages[i] == lang and ((f.lookup(g)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = mix(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    rate = ((f.lookup(other)[:, 0]) & np.uint64(1)).mean()
    assert abs(rate - f.fill[0] ** f.hashes) < 0.01                    # the correction's false-positive rate


def test_ngrams_against_slices():
    texts = ["Ab, c", None, "é1é", "  x"]
    want = []
    for i, t in enumerate(["ab c ", "", "é é ", "x "]):              # the end of a word is a space
        b = t.encode()
        want += [(n, b[k:k + n], i) for n in (2, 3, 4) for k in range(len(b) - n + 1)]
    got = []
    for n, key, doc in ngrams(texts):
        got += [(n, (int(k) & ((1 << 8 * n) - 1)).to_bytes(n, "little"), int(d)) for k, d in zip(key, doc)]
    assert sorted(got) == sorted(want)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)]
                                  + [(None, "zzz qqq", "xx"), (500, None, "en"), (501, "text", None)], "doc_id long, text string, lang string")
    model = train_language(train)
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !!", 5), (4, "the dog", 5), (4, "the dog", 5), (None, "die katze", 5), (6, "the dog " * 50_000, 5)],
                               "doc_id long, text string, lang_pred int")
    got = [(r["doc_id"], r["lang_pred"]) for r in predict_language(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "en")], key=str)
    assert predict_language(df.limit(0), model).count() == 0
    none = train_language(train.limit(0))
    assert {r["lang_pred"] for r in predict_language(df, none).collect()} == {"und"}
    assert not has_letter("12_ !") and has_letter("1é")
    assert not any(map(has_letter, ["²", "½", "①", "Ⅷ", "٣ _", "", None])) and has_letter("² x")


def test_language_held_out_accuracy(spark):
    from tardy.llm.queries import op9_language_id

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op9_language_id(spark, SF).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.96


def test_passages_cover_the_whole_text():
    x, owner = passages(["a b c", None, "", "w " * 200, " \n"])
    assert x.shape[1] == FEATURES and owner.tolist() == [0, 1, 2, 3, 3, 3, 3, 4]
    assert (x[1] == 0).all() and (x[7] == 0).all()


def plain_logit(w, bag):
    """Logit of one bag by the formulas, a passage and a unit at a time."""
    enc = [[math.tanh(sum(x * w["E"][i, j] for i, x in enumerate(row)) + w["e"][j]) for j in range(w["E"].shape[1])] for row in bag]
    att = []
    for e in enc:
        gated = [math.tanh(sum(x * w["V"][i, k] for i, x in enumerate(e))) / (1 + math.exp(-sum(x * w["U"][i, k] for i, x in enumerate(e)))) for k in range(w["V"].shape[1])]
        att.append(math.exp(sum(g * w["a"][k] for k, g in enumerate(gated))))
    z = [sum(a * e[j] for a, e in zip(att, enc)) / sum(att) for j in range(w["E"].shape[1])]
    return sum(x * w["c"][j] for j, x in enumerate(z)) + w["b"][0]


def test_gradient_matches_differences():
    """The first Adam step of every weight is ``rate`` against the sign of the
    bag loss's numerical derivative; many steps bring the loss down."""
    rng = np.random.default_rng(0)
    x, cut, y = rng.normal(size=(12, 5)), np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0])
    size = {"hidden": 4, "gate": 3, "bags": 4, "decay": 0.0}
    start, one = (GatedAttention.fit(x, cut, y, epochs=n, rate=0.01, **size) for n in (0, 1))
    z = (x - start.mean) / start.scale

    def loss(w):
        return float(np.mean([np.log1p(np.exp(-plain_logit(w, z[cut[i]:cut[i + 1]]) * (2 * y[i] - 1))) for i in range(4)]))
    checked = 0
    for name, value in start.w.items():
        for at in np.ndindex(value.shape):
            high, low = ({k: v.copy() for k, v in start.w.items()} for _ in range(2))
            high[name][at] += 1e-5
            low[name][at] -= 1e-5
            slope = (loss(high) - loss(low)) / 2e-5
            if abs(slope) > 1e-6:
                assert abs((one.w[name] - start.w[name])[at] + 0.01 * np.sign(slope)) < 1e-4, (name, at)
                checked += 1
    assert checked > 50
    m = GatedAttention.fit(x, cut, y, epochs=300, rate=0.02, **size)
    assert loss(m.w) < 0.05
    assert np.allclose(np.add.reduceat(GatedAttention._forward(m.w, z, cut)[3], cut[:-1]), 1)


def test_scores_against_plain_python():
    """Features and scores of whole texts, a word and a byte at a time."""
    rng = np.random.default_rng(3)
    texts = ["Good plain words, 12 of them!", "A", None, " ", "x x x $$$ é日 " * 90, "BAD!! ### 7"]
    m = GatedAttention.fit(rng.normal(size=(9, FEATURES)), np.array([0, 2, 5, 9]), np.array([1.0, 0, 1]), epochs=2)
    got = m.scores(texts)
    for text, score in zip(texts, got):
        w = (text or "").encode().split()
        bag = []
        for i in range(0, max(len(w), 1), PASSAGE_WORDS):
            part, row = w[i:i + PASSAGE_WORDS], np.zeros(FEATURES)
            data = b"".join(part)
            if data:
                for word in part:
                    for c, after in zip(word, word[1:] + b" "):
                        row[int(mix(np.array([c << 8 | after], np.uint64))[0]) & (FEATURES - 10)] += 1
                row = np.sqrt(row / len(data))

                def symbol(c):
                    return c < 128 and not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r"
                low = [word.lower() for word in part]
                n = len(part)
                row[-9:] = [sum(map(symbol, data)) / len(data), sum(65 <= c <= 90 for c in data) / len(data), sum(48 <= c <= 57 for c in data) / len(data),
                            sum(c >= 128 for c in data) / len(data), sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n,
                            sum(symbol(word[-1]) for word in part) / n, sum(len(word) == 1 and symbol(word[0]) for word in part) / n, math.log1p(n) / 5]
            bag.append((row - m.mean) / m.scale)
        assert abs(score - 1 / (1 + math.exp(-plain_logit(m.w, bag)))) < 1e-4, text


def test_language_against_exact_sets(spark):
    """Prediction with the n-gram sets themselves instead of filters."""
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog run home", "en"), ("der hund und die katze gehen heim", "de"), ("le chat et le chien rentrent", "fr")] * 40)]
    model = train_language(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    every = {}
    for lang in model.languages:
        texts = [t for i, t, x in docs if x == lang and zlib.crc32(str(i).encode()) % 4 != 2]
        every[lang] = {int(k) for _, key, _ in ngrams(texts) for k in key}
    probe = ["the dog", "die katze und", "le chien et", "the katze", "der cat and run", "12", "qwx zzv", "chat home heim " * 50]
    names, scores = model.predict(probe, np.array([has_letter(t) for t in probe], bool))
    for t, name, score in zip(probe, names, scores):
        grams = [int(k) for _, key, _ in ngrams([t]) for k in key]
        share = {lang: sum(k in own for k in grams) / max(len(grams), 1) for lang, own in every.items()}
        if not has_letter(t):
            assert (name, score) == ("und", 0.0)
            continue
        ranked = sorted(share.values(), reverse=True)
        # a filter may hold two n-grams more by chance
        assert abs(score - ranked[0]) < 0.02 + 2 / len(grams), t
        if ranked[0] - ranked[1] > 0.1:
            assert share[name] == ranked[0], t


def test_quality_edge_cases(spark):
    docs = [(i, ("good plain words in a line " * 30) if i % 2 else ("BAD!! $$$ ### " * 40)) for i in range(200)]
    df = spark.createDataFrame(docs + [(1000, None), (1001, ""), (1001, ""), (None, "good plain words"), (1002, "good plain words in a line " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (151, None), (999999, 0)], "doc_id long, quality int")
    model = fit_quality(df, labels)
    got = {r["doc_id"]: r["score"] for r in score_quality(df.withColumn("score", df["doc_id"]), model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(200)) and all(0 <= s <= 1 for s in got.values()) and got[1002] > 0.5
    assert fit_quality(df, labels.limit(0)) is None and fit_quality(df.limit(0), labels) is None and fit_quality(df, labels.where("quality = 1")) is None
    assert {r["score"] for r in score_quality(df, None).collect()} == {0.5}
    assert score_quality(df.limit(0), model).count() == 0


def test_quality_held_out_accuracy(spark):
    from tardy.llm.queries import op10_quality

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op10_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 40 and sum(right) / len(right) > 0.95


@pytest.mark.parametrize("template", ["MIT", "all-rights-reserved", "GPL-3.0", "BSD"])
def test_license_lines_are_found(spark, template):
    from tardy.llm.licenses import TEMPLATES, scan_licenses

    filler = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{filler}\n{TEMPLATES[template].upper()}\n{filler}", "x"), (2, TEMPLATES[template], "x"), (2, TEMPLATES[template], "x"), (3, filler, "x"), (4, None, "x"), (5, "", "x"),
            (6, "one", "x"), (None, TEMPLATES[template].replace(" ", "\n"), "x"), (7, f"{filler} " * 3000 + TEMPLATES[template], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted(((r["doc_id"] or 0, r["licenses"]) for r in scan_licenses(df).collect()))
    assert [(i, x) for i, x in got if template in x] == [(i, x) for i, x in got if i in (0, 1, 2, 7)] and len(got) == len(rows)
    assert all(x == [] for i, x in got if i in (3, 4, 5, 6))
    assert scan_licenses(df.limit(0)).count() == 0


def test_no_other_license_is_named(spark):
    from tardy.llm.licenses import TEMPLATES, scan_licenses

    filler = " ".join(f"w{i}" for i in range(40))
    wrapped = "/*\n * " + TEMPLATES["GPL-3.0-text"].replace(" under ", "\n * under ").replace(", either", ",\n * either") + "\n */"
    cases = [(TEMPLATES[k], [k]) for k in TEMPLATES if not k.startswith("Apache-2.0-text")] + [
        (TEMPLATES["Apache-2.0-text"], ["Apache-2.0", "Apache-2.0-text"]),
        (wrapped, ["GPL-3.0-text"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", []), ("Licensed under CC BY-NC-SA 4.0.", []), ("Licensed under CC BY-NC 3.0.", []),
        (f"all rights {filler} reserved", []), (f"all {filler} rights reserved", []), ("rights reserved all rights", []),
        (f"Released under {filler} the MIT License", []), ("Released under the terms of the MIT License.", []),
        (f"All rights reserved. {filler} Released under the MIT License.", ["MIT", "all-rights-reserved"]),
        (TEMPLATES["BSD"].replace("modification", "changes"), ["BSD"]), (" ".join(TEMPLATES["MIT-text"].split()[::-1]), [])]
    texts = [(i, t if i % 2 else f"{filler}\n{t}\n{filler}") for i, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i] == want, t

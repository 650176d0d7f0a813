"""Every stage on what its predecessor kept, against brute force."""

import pytest
from test_decontaminate import brute as contaminated
from test_near_dedup import brute as components

import corpus_pipeline as cp
from tardy.llm.langid import has_letter
from tardy.llm.piece_lattice import default_model, load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_filter", "language_filter", "near_dedup", "benchmark_decontamination", "piece_encoding"]
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes
    assert cp.ORACLE_SQL is None


def test_quality_and_language_keep_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(stages["documents"]), rows(stages["quality_filter"])
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.2 * len(bad)
    spoken = rows(stages["language_filter"])
    assert len(spoken) >= 0.97 * len(after) and all(has_letter(r["text"]) for r in spoken.values())
    assert all(r == before[i] for i, r in spoken.items())


def test_one_document_of_each_group(stages):
    before, after = rows(stages["language_filter"]), rows(stages["near_dedup"])
    want = components([(i, r["text"]) for i, r in sorted(before.items())], 80)
    assert set(after) == {i for i, c in want.items() if i == c}
    assert all(r == before[i] for i, r in after.items())


def test_benchmark_passages_are_cut(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages["near_dedup"]), rows(stages["benchmark_decontamination"])
    assert set(before) == set(after)
    phrases = [(str(i), t) for i, t in items]
    for i, r in after.items():
        if r["text"] == before[i]["text"]:
            assert r == before[i]
        assert r["n_chars"] == len(r["text"])
    touched = [i for i, r in after.items() if r["text"] != before[i]["text"]]
    for i in touched + list(after)[:15]:
        hits = contaminated(before[i]["text"], phrases)[1]
        assert (hits > 0) == (i in touched) and contaminated(after[i]["text"], phrases)[1] == 0


def test_samples_spell_the_documents(stages):
    docs, pieces = rows(stages["benchmark_decontamination"]), load(default_model())
    got = stages["piece_encoding"].collect()
    assert {r["doc_id"] for r in got} == set(docs) and all(r["round_trip"] for r in got)
    seen = set()
    for r in got:
        assert pieces.decode(r["ids"]) == docs[r["doc_id"]]["text"] and r["n_ids"] == len(r["ids"])
        seen.add((r["doc_id"], tuple(r["ids"])))
    assert len(seen) == len(got)


def test_run_gives_the_last_stage(spark, stages):
    a = {(r["doc_id"], r["sample"], tuple(r["ids"])) for r in cp.run(spark, SF).collect()}
    assert a == {(r["doc_id"], r["sample"], tuple(r["ids"])) for r in stages["piece_encoding"].collect()}


def test_stages_take_empty_tables(spark, stages):
    docs = stages["documents"].limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name

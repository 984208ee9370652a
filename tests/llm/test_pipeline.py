import collections
import re

import numpy as np
import pytest
from test_mixing import targets
from test_simhash import components, plain_fingerprint

import corpus_pipeline as pipeline
from docweave.llm.decontaminate import find_contamination
from docweave.llm.storage import staged
from docweave.llm.toxicity import held_out, score, train

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF), f"test-{name}"))
    return docs


def test_stages_keep_the_columns(outputs):
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in outputs[:-1])


def test_toxic_documents_go(spark, outputs):
    model = train(outputs[0], spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    want = {r.doc_id for r in score(outputs[0], model).collect() if r.predicted == 0}
    assert {r.doc_id for r in outputs[1].collect()} == want and 800 < len(want) < 1000


def test_one_of_each_group_stays(outputs):
    rows = outputs[1].collect()
    ids = [r.doc_id for r in rows]
    fps = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    assert sorted(r.doc_id for r in outputs[2].collect()) == sorted(set(components(fps, ids)))


def test_leaks_go(spark, outputs):
    found = {r.doc_id for r in find_contamination(outputs[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert found and {r.doc_id for r in outputs[3].collect()} == {r.doc_id for r in outputs[2].collect()} - found


def test_mix_meets_its_targets(outputs):
    before = {r.doc_id: r for r in outputs[3].collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in outputs[4].collect():
        assert r == before[r.doc_id]
        taken[r.source] += len(WORD.findall(r.text))
    largest = max(len(WORD.findall(r.text or "")) for r in before.values())
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= largest
    assert max(collections.Counter(r.doc_id for r in outputs[4].collect()).values()) <= 3


def test_tokens_of_the_mix(spark, outputs):
    got = sorted(outputs[5].collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in got) == [r.doc_id for r in got] == sorted(r.doc_id for r in outputs[4].collect())
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    whole = pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == [(r.doc_id, r.start, r.ids_crc32) for r in got]


@pytest.mark.parametrize("stage", [pipeline.drop_near_duplicates, pipeline.mix_sources])
def test_splits_may_change_between_jobs(spark, outputs, tmp_path, stage):
    path = str(tmp_path / "docs")
    outputs[1].repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    want = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
    key = "spark.sql.files.minPartitionNum"  # what Spark takes from the registered cores while it is unset
    try:
        spark.conf.set(key, "64")
        out = stage(spark, spark.read.parquet(path), SF)
        spark.conf.set(key, "1")
        got = sorted(r.doc_id for r in out.collect())
    finally:
        spark.conf.unset(key)
    assert got == want and len(want) > 100


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    base = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs, least in ((base, 3), (no_docs.select(*base.columns), 0)):
        for _, stage in pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), "odd")
        assert docs.count() >= least


def test_results_outlive_later_calls(spark, outputs):
    """A stage called again, and the stages after it, leave earlier results readable."""
    first = pipeline.drop_near_duplicates(spark, outputs[1], SF)
    mixed = pipeline.mix_sources(spark, outputs[3], SF)
    second = pipeline.drop_near_duplicates(spark, outputs[1], SF)
    pipeline.mix_sources(spark, second, SF).count()
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in second.collect()) == sorted(r.doc_id for r in outputs[2].collect())
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in outputs[4].collect())


@pytest.mark.parametrize("stored", [True, False])
def test_columns_with_clashing_names_survive(spark, odd_docs, stored):
    names = ["_row", "_copy", "_copies", "_Taken", "_goes", "_component", "_metadata", "_file_path", "_row_", "copies"]
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"'{n}!' as {n}" for n in names])
    docs = staged(docs, "clash") if stored else docs
    for stage in (pipeline.drop_near_duplicates, pipeline.mix_sources):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[n] == f"{n}!" for r in rows for n in names)


def test_run_removes_what_it_has_read(spark):
    from docweave.llm.storage import staged_folders
    from docweave.session import ensure_checkpoint_dir
    import glob

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, known = set(glob.glob(f"{base}/*")), len(staged_folders())
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    left = {p.rsplit("/", 1)[1] for p in set(glob.glob(f"{base}/*")) - before}
    assert not any(x.startswith(("llm-pipeline-toxicity", "llm-pipeline-simhash", "llm-pipeline-decontamination", "llm-dedup", "llm-mix-copies")) for x in left)
    assert len(staged_folders()) >= known

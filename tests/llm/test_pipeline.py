import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordgauge.llm import pu_toxicity, secret_scan, simhash_index, source_mixing, window_packing
from tests.llm.test_simhash import components, near, plain_fingerprint

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned, reread as the next one's input."""
    folder, docs, kept = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        kept[name] = (docs, out)
        docs = out
    return kept


def test_stages(spark, stages):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == columns
    assert corpus_pipeline.run(spark, SF_DIR).count() == stages["packing"][1].count()


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    judged = pu_toxicity.judge(before, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged if not r.predicted}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    groups = components([plain_fingerprint(r.text) for r in rows], near)
    assert {r.doc_id for r in after.collect()} == {rows[g].doc_id for g in groups}
    assert simhash_index.MAX_DIFFERING == 4


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        assert r.text == secret_scan.masked(texts[r.doc_id]) and r.n_chars == len(r.text)


def test_the_mix_is_sampled(stages):
    before, after = stages["mixing"]
    expected = {r.doc_id for r in source_mixing.mixed(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == expected and 0 < len(expected) < before.count()


def test_everything_left_is_packed(stages):
    before, after = stages["packing"]
    tokens = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()
    assert all(r.n == r.total for r in tokens)
    assert {r.doc_id for r in tokens} == {r.doc_id for r in before.collect()}
    sizes = [r.n for r in after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < window_packing.LENGTH for n in sizes) <= 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, weight string, _simhash_fp string, score string, spans string"


def odd_tables(spark, folder, rows):
    rows = [(*r, *(None if r[1] is None else len(r[1]),), "w", None, "s", "x") for r in rows]
    spark.createDataFrame(rows, ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_tables(spark, tmp_path):
    words = [f"word{i}" for i in range(3_000)]
    key = "password = hG7kQ2xV9mZ4tR8w"
    rows = [(None, None, None, None), (4, "", "en", "a"), (3, " \n", None, "a"), (None, " ".join(words), "en", None)]
    rows += [(7, "one text of this id", "en", "a"), (7, "quite another text here", "de", "b"), (8, "one text of this id", "en", "a")]
    rows += [(9, key + " " + " ".join(words[:40]), "en", "b"), (2, "one text of this id", None, "b")]
    sf_dir = odd_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    kept = corpus_pipeline.near_dedup(spark, clean, sf_dir)
    found = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.columns == docs.columns
    assert found == {(3, " \n"), (None, rows[3][1]), (2, "one text of this id"), (7, "quite another text here"), (9, rows[7][1])}
    safe = corpus_pipeline.secrets(spark, kept, sf_dir)
    assert safe.columns == docs.columns and safe.count() == 5
    assert [r.text.startswith("[SECRET] word0") for r in safe.where("doc_id = 9").collect()] == [True]
    mix = corpus_pipeline.mixing(spark, safe, sf_dir)
    assert mix.columns == docs.columns and {(r.doc_id, r.spans, r.weight) for r in mix.collect()} <= {(i, "x", "w") for i, _ in found}
    packed = corpus_pipeline.packing(spark, safe, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert packed.where("start = 0").count() == 5


def test_empty_tables(spark, tmp_path):
    packed = corpus_pipeline.run(spark, odd_tables(spark, tmp_path, []))
    assert packed.count() == 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)

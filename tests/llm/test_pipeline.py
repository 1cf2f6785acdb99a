"""The pipeline's stages, each against a plain version of it on its own input."""

import corpus_pipeline
import pytest
from test_table_operators import brute_classes
from test_text_operators import brute_passages, check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "!! 12", None, "s", 5), (9003, "der und die", None, "s", 11)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_rejects_texts_without_letters(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(before) - set(after) == {9001, 9002}
    assert stages[1].columns == COLUMNS and stages[1].where("lang is null").count() == 0


def test_one_document_of_each_class_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == set(brute_classes(list(before.items())).values())
    assert stages[2].columns == COLUMNS and after == {i: before[i] for i in after}


def test_repeated_passages_go(stages):
    import hashlib

    before, after = texts(stages[2]), texts(stages[3])
    assert stages[3].columns == COLUMNS
    for i, n, removed, sha in brute_passages(list(before.items())):
        if removed == 0:
            assert after[i] == before[i]
        elif removed < n:
            assert hashlib.sha256(after[i].encode()).hexdigest() == sha
        else:
            assert i not in after


def test_everything_left_is_packed(stages):
    assert check_packing(stages[4].collect(), texts(stages[3])) == 0


def test_run_and_an_empty_table(spark, stages, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    stages[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

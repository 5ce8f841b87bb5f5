"""The pipeline's stages against brute force, each on what the one before it kept."""

import random

import pytest

import corpus_pipeline
from tessera.llm.common import ALNUM


def words(n, seed, size=3000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def setting(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    base, passage, item = words(200, 1), words(60, 2), words(15, 3)
    rows = [(1, " ".join(base), "en"), (2, " ".join(base), "en"), (3, " ".join(base[:-1] + ["x"]), None), (4, None, "en"), (5, "12 !!", "en"), (6, " ".join(words(40, 4) + passage + words(40, 5)), "en"), (7, " ".join(words(30, 6) + passage + words(30, 7)), "en"), (8, "Keep.\n" + " ".join(words(20, 8) + item + words(20, 9)) + " end", "en"), (9, "short text", None), (9, "short text", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage, item


def test_stages(spark, setting):
    folder, passage, item = setting
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(kept[name]) + (name == "language_id")  # the repeated row goes with the near duplicates
    assert sorted(kept["language_id"]) == [1, 2, 3, 6, 7, 8, 9] and kept["language_id"][9]["lang"] == "en"
    assert sorted(kept["ngram_jaccard"]) == [1, 6, 7, 8, 9]
    assert " ".join(passage) in kept["substring_dedup"][6]["text"] and " ".join(passage) not in kept["substring_dedup"][7]["text"]
    assert kept["substring_dedup"][7]["n_chars"] == len(kept["substring_dedup"][7]["text"]) and kept["substring_dedup"][1]["text"] == kept["language_id"][1]["text"]
    clean = kept["decontamination"][8]["text"]
    assert clean.startswith("Keep.\n") and clean.endswith(" end") and not set(item[3:12]) & set(clean.encode().translate(ALNUM).decode().split()) - set(words(20, 8) + words(20, 9))
    assert kept["decontamination"][6]["spans"] == "clash"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {1, 6, 7, 8, 9}


def test_run(spark, setting):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, setting[0]).collect()} == {1, 6, 7, 8, 9}


def test_language_of_a_table_without_lang(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 !!", None), (4, "", None), (None, "é", None)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "some words", None), (None, "é", None)]


def test_near_duplicates_keep_every_clean_text_of_an_id(spark):
    a, b, c = (" ".join(words(80, i)) for i in (11, 12, 13))
    rows = [(1, a), (5, a + " x"), (5, b), (5, b), (9, b + " y"), (9, c), (9, ""), (None, a)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (5, b), (9, c), (9, ""), (None, a)], key=str)


def test_empty_documents(spark, setting, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{setting[0]}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{setting[0]}/benchmark.parquet").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0

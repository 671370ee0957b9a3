"""The corpus pipeline stage by stage."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from tallyloom.llm import decontaminate, minhash_join

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs)
    return seen


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_language_keeps_texts_with_letters(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept == {r["doc_id"] for r in stages[0].collect() if re.search(r"[^\W\d_]", r["text"] or "")}


def test_one_of_each_class_stays(spark, stages):
    classes = minhash_join.similarity_classes(stages[1]).collect()
    assert {r["doc_id"] for r in stages[2].collect()} == {r["class_id"] for r in classes}
    assert minhash_join.similarity_classes(stages[2]).where("n_links > 0").count() == 0


def test_leaks_are_gone_and_clean_documents_stay(spark, stages):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    judged = {r["doc_id"]: r["contaminated"] for r in decontaminate.op3_decontaminate(stages[2], bench).collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, bad in judged.items() if not bad}


def test_mix_repeats_at_most_twice(stages):
    counts = stages[4].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in counts) <= 2
    assert {r["doc_id"] for r in counts} <= {r["doc_id"] for r in stages[3].collect()}


def test_shards_number_all_rows(stages):
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() == len({(r["shard"], r["slot"]) for r in rows})


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(stages[5])


def test_run_on_hostile_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, one id for several texts, further columns with clashing names."""
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    text = "one two three four five six seven eight nine ten eleven"
    odd = [
        (None, text, "en", "web", 5), (None, text, "en", "web", 5), (1, None, None, None, None), (2, "", "en", None, 0), (3, "word " * 200_000, None, "web", 9),
        (4, text + " twelve and so on", None, None, 1), (4, "something quite different under the same id", "en", "web", 1), (5, "12 34 ?", "en", "web", 1), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(real + odd, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    docs = docs.selectExpr("*", "1 as shard", "'x' as score", "2 as _spans", "3 as mix_shard", "4 as node", "5 as peer", "6 as place", "array(7) as print")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r["score"] == "x" and r["peer"] == 5 and r["print"] == [7] for r in rows)
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert not any(t in (None, "", "12 34 ?") for _, t in texts)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0).write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stages_against_plain_versions(spark, stages):
    """Near duplicates by comparing all pairs of shingle sets, leaks by comparing all windows."""
    from test_documents import plain_classes, plain_leaks, words

    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    classes = plain_classes(texts)
    assert {r["doc_id"] for r in stages[2].collect()} == {c for c, _ in classes.values()}
    items = [(str(r["item_id"]), tuple(words(r["text"] or ""))) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    clean = {i for i, t in kept.items() if not plain_leaks(words(t or ""), items, 10)[0]}
    assert {r["doc_id"] for r in stages[3].collect()} == clean

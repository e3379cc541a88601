import random

import pytest

import corpus_pipeline as P

from .helpers import edit, text

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Clean documents, copies, junk, a benchmark passage and an address, and what has to become of each."""
    r = random.Random(1)
    rows = [(i, text(r, 150, lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    rows += [(100, rows[0][1], "en"), (101, edit(r, rows[1][1], 0.03), "fr"), (102, edit(r, rows[1][1], 0.03), "fr")]
    item = text(r, 40)
    rows += [(110, f"{text(r, 60)} {item} {text(r, 60)}", "en"), (111, "".join(r.choice("qxzjk ") for _ in range(3000)), None), (112, None, "en"), (113, "", None)]
    rows += [(120, f"{text(r, 60)} the.77@mail3.example.com {text(r, 60)}", "en")]
    docs = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_and_run(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, [set(range(90)) | {100, 101, 102, 110, 120}]
    left += [left[0] - {100, 101, 102}]
    left += [left[1] - {110}] * 2
    for i, (name, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, sf_dir), f"test-{name}")
        if i < 4:
            assert docs.columns == columns
            assert {x["doc_id"] for x in docs.collect()} == left[i], name
    kept = P.run(spark, sf_dir)
    rows = sorted(map(tuple, kept.collect()))
    assert rows == sorted(map(tuple, docs.collect()))
    assert {x["doc_id"] for x in kept.collect()} == left[3]
    assert len({x[0] for x in rows}) == max(x[0] for x in rows) + 1


def test_personal_data_are_gone_before_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = dict(P.STAGES)["pii"](spark, docs, sf_dir)
    row = clean.where("doc_id = 120").first()
    assert "[EMAIL]" in row["text"] and "@" not in row["text"] and row["n_chars"] == len(row["text"])


def test_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0

import re
import zlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from worksight.llm.common import stash  # noqa: E402


@pytest.fixture
def folder(spark, tmp_path):
    good = [(i, f"Plain text number {i} with some words, and then the numbers {i * 7} {i * 11} {i * 13} follow, as {i * 17} ever.", "en", "ab"[i % 2], None) for i in range(120)]
    bad = [(1000 + i, f"BUY!! NOW!! {i}!! $$$ ###", "en", "a", None) for i in range(60)]
    leak = [(2000, "Some words before one two three four five six seven eight nine ten eleven twelve after it, all well.", "en", "b", None)]
    copy = [(3000 + i, good[5][1], "en", "a", None) for i in range(3)]
    docs = spark.createDataFrame(good + bad + leak + copy, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(120)] + [(1000 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, folder), "test")
        seen[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["quality"] == set(range(120)) | {2000, 3000, 3001, 3002}
    assert ids["near_duplicates"] == ids["quality"] - {3000, 3001, 3002}
    assert ids["decontamination"] == ids["near_duplicates"] - {2000}
    words = sum(len(re.findall(r"\S+", r.text)) for r in seen["decontamination"])
    assert abs(sum(len(re.findall(r"\S+", r.text)) for r in seen["mixing"]) - words) < 0.05 * words
    assert len(seen["sharding"]) == len(seen["mixing"])
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in seen["sharding"])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.agg(F.countDistinct("shard")).first()[0] == 8


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_nulls_repeated_rows_long_texts_and_clashing_columns_pass_the_chain(spark, tmp_path):
    good = [(i, f"Plain text number {i} with some words, and then the numbers {i * 7} {i * 11} {i * 13} follow, as {i * 17} ever.", None, "ab"[i % 2], None, "own", 0.25) for i in range(60)]
    long = (500, " ".join(f"Sentence number {k} is as plain as any other." for k in range(12_000)), "en", None, None, "own", 0.25)
    rows = [*good, good[3], good[3], long, (None, None, None, None, None, None, None), (None, good[7][1], None, "a", None, "own", 0.25), (600, None, "en", "a", None, "own", 0.25), (601, "", "en", "a", None, "own", 0.25)]
    write(spark, tmp_path, rows, [(i, 1, 0) for i in range(60)] + [(None, 0, 0), (7, None, None)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs.collect()
        assert name == "sharding" or docs.columns == columns
    # labels of one kind rank nothing, so the first stage keeps all rows
    assert len(seen["quality"]) == len(rows)
    kept = seen["near_duplicates"]
    # rows of one id are one document, a row without an id can't be linked, and texts without words link with nothing
    assert sum(r.doc_id == 3 for r in kept) == 3 and sum(r.doc_id is None for r in kept) == 2 and {500, 600, 601} <= {r.doc_id for r in kept}
    assert len(seen["decontamination"]) == len(kept)
    mixed = seen["mixing"]
    assert all(r.text and r.text.strip() for r in mixed) and any(r.doc_id == 500 and r.text == long[1] for r in mixed)
    assert all(r._row == "own" and r.score == 0.25 for r in mixed)
    assert len(seen["sharding"]) == len(mixed)


def test_an_empty_table_passes_the_chain(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

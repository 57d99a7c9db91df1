"""Without labels that rank, the quality stage keeps all documents."""

from worksight.llm import quality


def test_no_usable_labels_keep_everything(spark):
    docs = spark.createDataFrame([(i, f"the text number {i}") for i in range(20)] + [(None, None)], "doc_id long, text string")
    hidden = [i for i in range(20) if spark.range(1).select((quality.fold(quality.F.lit(i), 4) == 2).alias("x")).first().x][:3]
    for rows in ([], [(i, 0) for i in hidden], [(1, None)], [(10_000, 1)], [(i, 0) for i in range(20)], [(i, 1) for i in range(20)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        kept = quality.keep(docs, labels)
        assert kept.columns == docs.columns and kept.count() == 21


def test_columns_of_the_same_names_stay_as_they_are(spark):
    rows = [(i, "good words in a sentence. " * 8 if i % 2 else "XX!! ## 99 " * 9, i / 1000, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 30
    assert all(r.score == r.doc_id / 1000 and r.predicted == r.doc_id for r in kept.collect())

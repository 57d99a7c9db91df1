"""Columns of the input that are called as the operators' own, in any case, come back as they were; items of one word."""

from worksight.llm import decontaminate, secrets

SCHEMA = "doc_id long, text string, _text string, _hex string, _ODD string, _row string, _hit int, _gaps string"
OWN = ("mine", "h", "o", "r", 5, "g")


def test_secrets_keep_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "password = abcdefghijklmnop and 0123456789abcdef0123", *OWN), (2, None, *OWN)], SCHEMA)
    for out in (secrets.scan(docs), secrets.redact(docs)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(tuple(r)[2:8] == OWN for r in out.collect())
    assert {r["doc_id"]: len(r["base"]) for r in secrets.scan(docs).collect()} == {1: 2, 2: 0}
    assert secrets.scan(docs.limit(0)).count() == 0


def test_decontamination_keeps_columns_of_its_names(spark):
    window = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {window} after", *OWN), (2, "clean", *OWN), (2, "clean", *OWN), (None, None, *OWN)], SCHEMA)
    items = spark.createDataFrame([("a", window)], "item_id string, text string")
    report = decontaminate.report(docs, items)
    assert report.columns[: len(docs.columns)] == docs.columns and all(tuple(r)[2:8] == OWN for r in report.collect())
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in report.collect()) == [(0, 0, False), (1, 0, False), (1, 0, False), (12, 10, True)]
    kept = decontaminate.remove_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == 3 and all(tuple(r)[2:] == OWN for r in kept.collect())
    cut = decontaminate.remove_spans(docs, items)
    assert cut.columns == docs.columns and {r["text"] for r in cut.collect()} == {"before after", "clean", None}


def test_items_of_one_and_two_words(spark):
    docs = spark.createDataFrame([(1, "The cat. THE dog"), (2, "cats the"), (3, "dog"), (4, "the"), (5, " the ")], "doc_id long, text string")
    items = spark.createDataFrame([("one", "The"), ("two", "the dog"), ("none", "-")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.report(docs, items).collect()}
    assert got == {1: (3, ["one", "two"]), 2: (1, ["one"]), 3: (0, []), 4: (1, ["one"]), 5: (1, ["one"])}


def test_many_items_with_one_frequent_word_meet_by_both_words(spark):
    """The join of words and anchors has both words of an anchor as its key."""
    items = spark.range(50_000).selectExpr("id as item_id", "concat('the ', lpad(id, 9, 'x'), ' ', 'of') as text")
    docs = spark.createDataFrame([(1, "the xxxx49999 of the " * 500)], "doc_id long, text string")
    found = decontaminate.found(decontaminate.with_key(docs), items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all(line.count("lower(") == 4 for line in joins)
    report = decontaminate.report(docs, items).first()
    assert (report["n_items"], report["n_hit"]) == (1, 1500)

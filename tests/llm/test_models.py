import hashlib
import random

import numpy as np
import pytest

from worksight.llm import edits, pages, quality, toxicity


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = {i * 2: "".join(rng.choice("abcdé 𝄞") for _ in range(rng.choice([0, 1, 5, 300, 9000]))) for i in range(60)}
    texts |= {500: None, 501: "same text here", 502: "same text here"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, fingerprint int")
    for seen in (df, df.repartition(5)):
        got = {r.doc_id: r for r in edits.fingerprint(seen).collect()}
        order = sorted(texts)
        for k, i in enumerate(order):
            own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
            half = len(own) // 2
            changed = own[: len(own) - half] + after[:half]
            assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[501].fingerprint == got[502].fingerprint and got[501].near_next == 1
    assert edits.fingerprint(df.limit(0)).count() == 0
    one = edits.fingerprint(spark.createDataFrame([(4, "abcdef")], "doc_id int, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_many_ranges_agree_with_one(spark, monkeypatch):
    rows = [(i, f"text number {i} " * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.edited_sha256 for r in edits.fingerprint(df).collect()}
    monkeypatch.setattr(edits, "RANGE_ROWS", 7)
    assert {r.doc_id: r.edited_sha256 for r in edits.fingerprint(df).collect()} == want


def test_likeness_falls_with_edits(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    last = 1.0
    for edited in (3, 40, 400):
        other = list(text)
        for _ in range(edited):
            at = rng.randrange(len(other))
            other[at : at + rng.choice([0, 1])] = [rng.choice("xyz")] if rng.random() < 0.7 else []
        a, b = edits.fingerprints([edits.code_points(text), edits.code_points("".join(other))])
        now = edits.likeness(a, b)
        assert now <= last
        last = now
    assert 0.1 < last < 0.95
    prints = spark.createDataFrame([(1, a), (2, a), (3, edits.fingerprints([edits.code_points(text[::-1])])[0]), (4, ""), (None, a)], "doc_id long, fingerprint string")
    assert [(r.doc_id, r.near_id) for r in edits.near(prints).collect()] == [(2, 1)]


def make(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.4
        words = [rng.choice(["the", "of", "and", "lorem", "ipsum", "dolor", "amet", "vita"]) for _ in range(rng.randint(20, 80))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "x", 0.5))
        labels.append((i, int(good), int(toxic)))
    rows += [(9000, None, None, None), (9001, "", None, None), (9001, "", None, None), (9002, "w" * 100_000, None, None), (None, "the of", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels + [(None, 1, 1), (9002, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, column, parts, out", [(quality.rank, "quality", 4, 2), (toxicity.classify, "toxic", 3, 1)])
def test_held_out_accuracy(spark, operator, column, parts, out):
    df, labels = make(spark, 400, 3)
    got = operator(df, labels).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {r.doc_id: r[column] for r in labels.collect()}
    import zlib

    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % parts == out)
    held = [r for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    assert operator(df.limit(0), labels).count() == 0 and operator(df, labels.limit(0)).count() == 405


def test_labels_of_the_held_out_fold_are_not_looked_at(spark):
    from pyspark.sql import functions as F

    df, labels = make(spark, 200, 5)
    hidden = quality.fold(F.col("doc_id"), 4) == 2
    turned = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: sorted((str(r.doc_id), r.score) for r in quality.rank(df, x).collect())
    assert scores(labels) == scores(turned)


@pytest.fixture(scope="module")
def model():
    return pages.train(700)


def test_main_text(spark, model):
    article = "<article><h1>A title here</h1><p>First   paragraph &amp; more, with words.<br>next</p><p><b>Second <i>one</i>, which goes on for a while.<p>Third one.</article>"
    page = f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class='ad'>Buy this now.</div>{article}<div class=comments><p>Nice one, thanks.</p></div><footer>&copy; site</footer>"
    rows = [(1, "u", page, "c"), (1, "u", page, "c"), (2, None, None, None), (3, "u", "", None), (None, "u", "<p", None), (5, "u", "<div>" * 3000 + "deep", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(df, model).collect()
    texts = [r.text for r in got if r.page_id == 1]
    assert len(got) == 6 and len(texts) == 2 and texts[0] == texts[1] == "A title here\nFirst paragraph & more, with words. next\nSecond one, which goes on for a while.\nThird one."
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert pages.extract(df.limit(0), model).count() == 0


def test_decoding_is_consistent_and_best(model):
    rng = np.random.default_rng(4)
    for _ in range(30):
        page = pages.Page("<div><p>a</p><section><p>b</p><p>c</p></section></div><p>d</p>")
        odds = rng.normal(0, 1, len(page.tag))
        keep = page.decode(odds)
        n = len(page.tag)
        best = max(sum(o if (m >> k) & 1 else -o for k, o in enumerate(odds)) for m in range(1 << n) if all(page.parent[k] < 0 or not (m >> k) & 1 or (m >> page.parent[k]) & 1 for k in range(n)))
        assert np.isclose(np.where(keep, odds, -odds).sum(), best) and all(not keep[k] or page.parent[k] < 0 or keep[page.parent[k]] for k in range(n))


def test_composed_pages_held_out(model):
    x, y = pages.lessons(120, 99)
    assert ((pages.judge(model, x) > 0) == (y > 0)).mean() > 0.97

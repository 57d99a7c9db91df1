"""Importance resampling against a plain version, number by number."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from worksight.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, longest=2):
    words = WORD.findall((text or "").translate(AZ))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_draw(docs, target, percent=25, least=20):
    source = Counter(b for _, t in docs for b in plain_features(t)[1])
    wanted = Counter(b for t in target for b in plain_features(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in range(10000)]
    out, able = [], []
    for doc, text in docs:
        words, found = plain_features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out))


def test_query_equals_plain_version(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select(*c).collect()]
    got = sorted(tuple(r) for r in queries.op12_importance(spark, "/root/testdata/sf0.01").collect())
    assert got == plain_draw(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])


def test_odd_texts_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 10)
    rng = random.Random(3)
    odd = [None, "", " ", "...", "a", "A-b", "É é x", "a" * 50_000, "w " * 40_000, "a\x00b c\n\td"]
    docs = [(k, t) for k, t in enumerate(odd)] + [(100 + k, " ".join(rng.choice(["one", "Two", "three,", "fünf"]) for _ in range(rng.randrange(15, 60)))) for k in range(90)]
    target = ["two two fünf", None, "b c"]
    table = spark.createDataFrame([(k, t, 5, "mine") for k, t in docs], "doc_id long, text string, score int, _words string")
    got = importance.ranked(table, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "_words", "n_features", "weight", "score", "rank"] and {r["_words"] for r in got.collect()} == {"mine"}
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == plain_draw(docs, target)


def test_longer_runs():
    found = importance.pattern(3)
    for text in ("", "a", "a b", "One two, three four", "é " * 30):
        for longest in (1, 2, 3):
            words, each = importance.hashes(text.encode(), importance.pattern(longest))
            want = plain_features(text, longest)
            assert words == len(want[0]) and Counter(each % 10000) == Counter(want[1])
    assert [m.groups() for m in found.finditer(b"ab c d", overlapped=True)] == [(b"ab c", b"ab c d", b"ab"), (b"c d", None, b"c"), (None, None, b"d")]


def test_draw_and_repeated_and_null_rows(spark):
    text = "same words again " * 10
    docs = spark.createDataFrame([(1, text, "x")] * 6 + [(None, text, "y")] * 2, "doc_id long, text string, rank string")
    got = importance.draw(docs, docs.limit(0).select("text"), percent=50)
    assert got.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3, 4] and {r["text"] for r in got.collect()} == {text}
    assert importance.draw(docs.limit(0), docs.select("text")).count() == 0


def test_gains_are_floored_logarithms():
    s, t = np.array([0, 5, 9]), np.array([3, 0, 1])
    assert importance.gains(s, t).tolist() == [math.floor(1000 * math.log((b + 1) * 17 / ((a + 1) * 7))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]

"""Banding and verification of edit-embedding fingerprints."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from worksight.llm import edits


def test_pairs_behind_another_hub_and_in_late_octaves(spark):
    rng = random.Random(4)
    n = len(edits.tables()[1])
    digits = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    early, late, block = digits(160), digits(n - 160), digits(n)
    rows = [(1, early + digits(n - 160)), (2, early + late), (3, early + late), (4, digits(160) + late), (5, digits(n) + ":" + block + ":" + block + ":" + block), (6, digits(n) + ":" + block + ":" + block + ":" + block), (7, digits(n))]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {(r.doc_id, r.near_id) for r in edits.near(prints).collect()}
    assert got == {(3, 2), (4, 2), (6, 5)}


def test_verification_on_whole_texts(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(9000))
    other = text[:3000] + "xyz" + text[3100:]
    one, two = edits.code_points(text), edits.code_points(other)
    moves, same, total = edits.tables()[0], 0, 0
    for at in (0, edits.BLOCK):
        x, y, p, q = one[at : at + edits.BLOCK], two[at : at + edits.BLOCK], 0, 0
        for j in range(edits.STEPS):
            a, b = (x[p] if p < len(x) else None), (y[q] if q < len(y) else None)
            total += a is not None or b is not None
            same += a is not None and a == b
            p += int(moves[j][(int(a) ^ int(a) >> 8) & 255]) if a is not None else 0
            q += int(moves[j][(int(b) ^ int(b) >> 8) & 255]) if b is not None else 0
    assert edits.walked_alike([(one, two), (one, one), (one[:0], one[:0]), (one, one[:0])]) == pytest.approx([same / total, 1, 1, 0])
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    marks = edits.fingerprints([one, two])
    prints = spark.createDataFrame(list(zip((1, 2), marks, strict=True)), "doc_id long, fingerprint string")
    assert [(r.doc_id, r.near_id, r.alike) for r in edits.near(prints, 0.0, docs).collect()] == [(2, 1, pytest.approx(same / total))]


def test_estimates_of_many_pairs_are_those_of_each():
    rng = random.Random(6)
    marks = edits.fingerprints([edits.code_points("".join(rng.choice("abc def") for _ in range(n))) for n in (0, 1, 5, 40, 300, 9000, 20_000, 9000)])
    left, right = np.array(list(combinations(range(len(marks)), 2)), int).T
    assert edits.estimates(marks, left, right) == pytest.approx([edits.likeness(marks[a], marks[b]) for a, b in zip(left, right, strict=True)])


def texts_with_edits(spark, n, seed):
    """Texts of the sample and copies of each with a few characters changed, put in or left out."""
    rng = random.Random(seed)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if 60 <= len(r["text"]) <= 6000][:n]
    out = []
    for k, t in enumerate(texts):
        own = list(t)
        for _ in range(max(1, len(own) * rng.choice([1, 2, 4]) // 200)):
            at = rng.randrange(len(own))
            own[at] = rng.choice(["", "x", own[at] + "y"])
        out += [(2 * k, t), (2 * k + 1, "".join(own))]
    return out


def test_recall_and_candidates_against_all_pairs(spark):
    rows = texts_with_edits(spark, 220, 12)
    codes = [edits.code_points(t) for _, t in rows]
    marks = edits.fingerprints(codes)
    buckets = defaultdict(set)
    for k, mark in enumerate(marks):
        for key in edits.band_keys(mark):
            buckets[key].add(k)
    sharing = {p for b in buckets.values() for p in combinations(sorted(b), 2)}
    assert len(sharing) < 0.02 * len(rows) * (len(rows) - 1) / 2
    # planted pairs that are alike on their whole walks, and which of them near() puts together
    planted = [(2 * k, 2 * k + 1) for k in range(len(rows) // 2)]
    alike = [p for p, x in zip(planted, edits.walked_alike([(codes[a], codes[b]) for a, b in planted]), strict=True) if x >= 0.7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = edits.near(spark.createDataFrame([(k, m) for k, m in enumerate(marks)], "doc_id long, fingerprint string"), 0.7, docs).collect()
    assert all(r["alike"] >= 0.7 for r in found)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = top(r["doc_id"]), top(r["near_id"])
        root[max(a, b)] = min(a, b)
    hit = sum(top(a) == top(b) for a, b in alike)
    assert len(alike) > 100 and hit >= 0.9 * len(alike)
    print(len(alike), hit, len(sharing) / (len(rows) * (len(rows) - 1) / 2))

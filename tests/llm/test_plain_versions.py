"""The models against plain versions of their methods, number by number on small inputs."""

import math
import random

import numpy as np
import pytest

from worksight import tables
from worksight.llm import edits, pages, quality, toxicity


def test_walks_equal_one_character_at_a_time():
    rng = random.Random(1)
    texts = ["", "a", "hello", "".join(rng.choice("abcdef é漢") for _ in range(700)), "xy" * 5000]
    moves, steps, digits, _ = edits.tables()
    want = []
    for t in texts:
        blocks = []
        for at in range(0, len(t), edits.BLOCK):
            block, pointer, out = t[at : at + edits.BLOCK], 0, []
            for j in range(edits.STEPS):
                if pointer >= len(block):
                    break
                code = ord(block[pointer])
                kind = (code ^ code >> 8) & 255
                for k in np.flatnonzero(steps == j):
                    out.append("0123456789abcdef"[digits[k][kind]])
                pointer += int(moves[j][kind])
            blocks.append("".join(out))
        want.append(":".join(blocks))
    assert edits.fingerprints([edits.code_points(t) for t in texts]) == want


def test_ranks_come_from_the_least_loss_over_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    label = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=120) > 0).astype(int)
    model = quality.fit(x, label)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    draw = np.random.default_rng(5)
    n = min(quality.PAIRS, 20 * len(x))
    pairs = list(zip(draw.choice(good, n), draw.choice(bad, n), strict=True))
    slope = np.zeros(3)
    for a, b in pairs:  # the gradient of the mean loss log(1 + exp(-(s_a - s_b))) plus the ridge, term by term
        d = z[a] - z[b]
        slope += -d / (1 + math.exp(float(d @ model["w"]))) / n
    assert np.abs(slope + 1e-2 * model["w"]).max() < 1e-8
    score = [float(r @ model["w"]) for r in z]
    right = lambda cut: (np.mean([score[k] >= cut for k in good]) + np.mean([score[k] < cut for k in bad])) / 2
    assert right(model["cut"]) == pytest.approx(max(right(q) for q in np.quantile(score, np.arange(1, 400) / 400)))
    assert ((quality.apply(model, x) >= quality.CUT) == (np.array(score) >= model["cut"])).mean() > 0.99


def test_convolutions_equal_plain_loops():
    model, rng = toxicity.start(), np.random.default_rng(3)
    model["emb"] = rng.normal(size=model["emb"].shape).astype(np.float32)
    ids = rng.integers(0, toxicity.BUCKETS, (9, 1 + len(toxicity.PREFIXES))).astype(np.int32)
    first = np.array([0, 4, 4, 5, 9])  # one text has no words
    got = toxicity.pooled(model, ids, first)[0]
    for t in range(4):
        words = [model["emb"][ids[k]].sum(axis=0) for k in range(first[t], first[t + 1])]
        want = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                values = [sum(float(words[s + j] @ model[f"filter{w}"][j, :, f]) for j in range(w)) + float(model[f"shift{w}"][f]) for s in range(len(words) - w + 1)]
                want.append(max([0.0, *values]))
        assert got[t] == pytest.approx(want, abs=1e-4)
    assert toxicity.logits(model, ids, first) == pytest.approx([float(g @ model["out"] + model["bias"][0]) for g in got], abs=1e-4)


def test_fits_on_whole_texts_within_the_words_of_a_label(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda ids, label, language: seen.update(n=[len(x) for x in ids], label=list(label)) or toxicity.start() | {"threshold": np.zeros(5)})
    monkeypatch.setattr(toxicity, "FIT_WORDS", 20_000)
    rows = [(i, "word " * (9000 if i % 10 == 0 else 50) + "end") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 100) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 200
    for label in (0, 1):
        n = [k for k, own in zip(seen["n"], seen["label"], strict=True) if own == label]
        assert set(n) <= {51, 9001} and n.count(9001) in (1, 2) and sum(n) <= 20_000 and n.count(51) > 30


def test_boosting_equals_a_plain_search_of_splits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (80, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    model = pages.boost(x, y)
    p = 1 / (1 + np.exp(-pages.judge(model, x)))
    assert ((p > 0.5) == (y > 0.5)).all()
    # the first split: the greatest gain over all features and all cuts between bins, found one by one
    g, h = y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    gains = {}
    for f in range(3):
        for edge in np.unique(np.quantile(x[:, f], np.arange(1, pages.BINS) / pages.BINS)):
            left = x[:, f] <= edge
            if left.any() and not left.all():
                gains[f, edge] = g[left].sum() ** 2 / (h[left].sum() + pages.RIDGE) + g[~left].sum() ** 2 / (h[~left].sum() + pages.RIDGE)
    feature, cut = model["trees"][0][0][0]
    assert gains[int(feature[0]), float(model["edges"][int(feature[0])][int(cut[0])])] == pytest.approx(max(gains.values()))


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError):
        tables.shared_dir(Cluster())

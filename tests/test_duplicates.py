"""Duplicate pairs against a comparison of all pairs."""

import math
import random
import re
from collections import Counter
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from worksight.operators import duplicates
from worksight.schemas import TEXT_STOPWORDS

SCHEMA = "dataset_id string, id string, description string, latitude decimal(10,7), longitude decimal(10,7), sanctioned_cost decimal(14,2), category string, start_date date, sanction_date date, completion_date date, implementing_agency string"


def some_works(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["of", "road", "bridge", "school", "ward 7"]
    bases = [[rng.choice(words) for _ in range(rng.choice([2, 6, 15]))] for _ in range(9)]
    out = []
    for k in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        placed = rng.random() < 0.6
        out.append((
            f"D{k % 2}", f"{k:03d}", rng.choice([" ".join(text)] * 9 + [None, "", "--"]), Decimal(rng.choice(["12.9700000", "12.9750000",
                "13.2000000"])) if placed else None, Decimal("77.5900000") if placed and rng.random() < 0.95 else None,
            rng.choice([None, Decimal("0"), Decimal("-50"), *[Decimal(rng.choice([1000, 1020, 1500, 4000, 90000])) for _ in range(9)]]), rng.choice(["A", "A", "B", None]),
            rng.choice([None, date(2020, 1, 1)]), rng.choice([None, date(2020, 3, 1), date(2021, 1, 1)]), rng.choice([None, date(2020, 6, 1)]), rng.choice(["Sri Balaji Constructions", "Kaveri Works Agency", None]),
        ))
    return out


def all_pairs(rows):
    """a_id, b_id, text likeness, score of the pairs that reach the trigger."""
    out = {}
    for dataset in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == dataset]
        vectors = []
        for r in own:
            words = [w for w in re.sub(r"[^a-z0-9\s]", " ", (r[2] or "").lower()).split() if len(w) > 1 and w not in TEXT_STOPWORDS]
            vectors.append(Counter(words) + Counter(" ".join(x) for x in zip(words, words[1:], strict=False)))
        df = Counter(t for v in vectors for t in v)
        vectors = [{t: c * (math.log((1 + len(own)) / (1 + df[t])) + 1) for t, c in v.items()} for v in vectors]
        vectors = [{t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for v in vectors]
        for i, (a, u) in enumerate(zip(own, vectors, strict=True)):
            for b, v in zip(own[i + 1 :], vectors[i + 1 :], strict=True):
                text = sum(w * v.get(t, 0.0) for t, w in u.items())
                if text < 0.25:
                    continue
                far = None
                if None not in (a[3], a[4], b[3], b[4]):
                    p, q, d = math.radians(a[3]), math.radians(b[3]), math.radians(b[4] - a[4])
                    far = 2 * 6_371_000 * math.asin(math.sqrt(min(1, math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2)))
                    if far > 2000:
                        continue
                x, y = a[5], b[5]
                cost = 0.0 if x is None or y is None or max(x, y) == 0 else max(0.0, 1 - abs(float(x) - float(y)) / float(max(x, y)))
                begins = [r[7] or r[8] for r in (a, b)]
                ends = [r[9] or date(9999, 12, 31) for r in (a, b)]
                both = None not in begins and begins[0] <= ends[1] and begins[1] <= ends[0]
                score = 0.4 * text + 0.2 * cost + 0.1 * (a[6] is not None and a[6] == b[6]) + 0.05 * both
                score = min(1.0, score + 0.25 * max(0, 1 - far / 2000) if far is not None else score / 0.75)
                if round(score, 4) >= 0.6:
                    out[dataset, a[1], b[1]] = (round(text, 4), round(score, 4))
    return out


def found(df):
    return {(r["dataset_id"], r["a_id"], r["b_id"]): (r["text_similarity"], r["combined_score"]) for r in duplicates.duplicate_pairs(df).collect()}


def test_pairs_equal_a_comparison_of_all(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "PART_ROWS", 7)
    rows = some_works(260, 3)
    want, got = all_pairs(rows), found(spark.createDataFrame(rows, SCHEMA))
    assert want.keys() == got.keys() and len(want) > 100
    assert all(math.isclose(x, y, abs_tol=1.1e-4) for k in want for x, y in zip(want[k], got[k], strict=True))


def test_long_texts_take_time_in_proportion(spark):
    """Texts of 20 000 words, two of them alike: what travels and what is compared grows with the words and not with their square."""
    rng = random.Random(9)
    long = [f"t{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = some_works(40, 5)
    fill = rows[0][3:]
    rows += [("D0", "900", " ".join(long), None, None, Decimal("1000"), "A", date(2020, 1, 1), None, None, None), ("D0", "901", " ".join(long[:-50]), None, None, Decimal("1000"), "A", date(2020, 1, 1), None, None, None)]
    rows += [("D0", "902", " ".join(reversed(long[:9000])), *fill)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert ("D0", "900", "901") in got and got["D0", "900", "901"][0] > 0.99


def test_postings_meet_only_in_ranges_that_reach_the_bound(spark):
    rows = spark.createDataFrame(some_works(200, 11), SCHEMA)
    terms, facts = duplicates.postings(duplicates.tfidf(rows)), duplicates.with_facts(rows)
    x, y = duplicates.levels(terms, facts)
    plain = terms.filter(F.col("tail") >= 0.25).join(facts.select("dataset_id", "id", "lost"), ["dataset_id", "id"])
    every = plain.filter("lost").join(plain.select("dataset_id", "h", F.col("id").alias("other")), ["dataset_id", "h"]).count()
    assert x.join(y, ["dataset_id", "h", "part", "i", "j", "band"]).count() < every / 2

"""Order statistics against plain Python: ties, nulls, one group with all rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from worksight.operators import forest, ranks
from worksight.tables import in_ranges, kept, running


@pytest.fixture(scope="module")
def values():
    draw = random.Random(3)
    return [("a", draw.choice([1.5, 2.0, 7.25, draw.random() * 100])) for _ in range(900)] + [("b", float(k % 4)) for k in range(10)] + [("c", None)] * 3 + [("d", 5.0)]


def test_places_of_sorted_groups(spark, values):
    df = spark.createDataFrame(values, "g string, v double")
    counts = ranks.counted(df, ["g"], "v", "test-counts")
    n = F.col("members")
    got = ranks.nth(counts, ranks.members(counts, ["g"], 2, "test-sizes"), ["g"], "v", {"least": F.lit(0), "low": F.floor((n - 1) / 2), "last": n - 1})
    want = {}
    for g in ("a", "b"):
        v = sorted(v for k, v in values if k == g)
        want[g] = (len(v), v[0], v[(len(v) - 1) // 2], v[-1])
    assert {r.g: (r.members, r.least, r.low, r.last) for r in got.collect()} == want


def test_a_group_with_all_rows_spreads(spark):
    df = spark.range(4000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 4001).alias("v"), F.lit(1).alias("c"))
    ranged = in_ranges(df, ["g", "v"], 8, "test-ranges")
    assert ranged.groupBy("_block").count().agg(F.max("count")).first()[0] < 1000
    rows = running(ranged, ["g"], ["v"], "c", "cum").orderBy("v").collect()
    assert [r.cum for r in rows] == list(range(1, 4001))


def test_medians_fill_nulls(spark):
    draw = random.Random(4)
    rows = [(draw.choice("xy"), str(k), *[draw.choice([None, draw.randint(0, 9) / 4]) for _ in range(4)], None) for k in range(200)]
    df = spark.createDataFrame(rows, f"dataset_id string, id string, {', '.join(f'{c} double' for c in forest.FEATURES)}")
    got = {(r.dataset_id, r.id): r for r in forest.impute(df).collect()}
    assert len(got) == 200
    for dataset, id, *cells in rows:
        for k, c in enumerate(forest.FEATURES):
            others = [r[2 + k] for r in rows if r[0] == dataset and r[2 + k] is not None]
            assert got[dataset, id][c] == (cells[k] if cells[k] is not None else statistics.median(others) if others else 0.0)


def test_kept_tables_follow_files_inside_a_folder(spark, tmp_path):
    path, made = f"file://{tmp_path}/t.parquet", []

    def make():
        made.append(1)
        from worksight.tables import stash

        return {"t": stash(spark.read.parquet(path), "test-kept")}

    spark.range(10).write.parquet(path)
    first = kept(spark, ("test",), [path], make)["t"]
    kept(spark, ("test",), [path], make)
    assert (len(made), first.count()) == (1, 10)
    spark.range(25).write.mode("append").parquet(path)
    assert (kept(spark, ("test",), [path], make)["t"].count(), len(made)) == (35, 2)

"""What a search for duplicates shuffles and keeps grows with the works, not with the pairs."""

from datetime import date
from decimal import Decimal

from worksight.operators import duplicates
from worksight.plans import detection
from worksight.tables import stash

from .test_detection import works
from .test_duplicates import SCHEMA, all_pairs, found, some_works


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_alike_works_are_not_shuffled_by_the_pair(spark):
    """500 works of one text and cost without a place: all 124 750 pairs are found, and less than 10 bytes a pair are shuffled."""
    rows = [("D0", f"{k:03d}", "a long new road from the old mill over the hill to the school", None, None, Decimal("1000"), "A", date(2020, 1, 1), None, None, None) for k in range(500)]
    df = stash(spark.createDataFrame(rows, SCHEMA), "test-alike")
    before = shuffled(spark)
    assert duplicates.duplicate_pairs(df).count() == 500 * 499 // 2
    assert shuffled(spark) - before < 10 * 500 * 499 // 2


def test_works_around_the_world_and_in_hot_cells(spark, monkeypatch):
    """Small cells, parts and blocks, and places on either side of the date line, against all pairs."""
    monkeypatch.setattr(duplicates, "CELL_ROWS", 5)
    monkeypatch.setattr(duplicates, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(duplicates, "COMMON", 10)
    shifted = {Decimal("77.5900000"): (Decimal("179.9950000"), Decimal("-179.9950000"), Decimal("77.5990000"), Decimal("77.6010000"))}
    rows = [(*r[:4], shifted[r[4]][k % 4] if r[4] else r[4], *r[5:]) for k, r in enumerate(some_works(240, 17))]
    want, got = all_pairs(rows), found(spark.createDataFrame(rows, SCHEMA))
    assert want.keys() == got.keys() and len(want) > 50


def test_signals_of_duplicates_are_not_kept(spark):
    plain = {"description": "road from mill to school", "latitude": Decimal(10), "longitude": Decimal(70), "sanctioned_cost": Decimal(100), "category": "road"}
    run = detection.run_detection(works(spark, [plain, plain]), "2024-01-01", with_forest=False)
    assert run["signals"].filter("signal_type = 'DUPLICATE'").count() == 2 and not run["others"].filter("signal_type = 'DUPLICATE'").count()

from decimal import Decimal

from pyspark.sql import functions as F

from worksight.functions import cells
from worksight.functions.similarity import contextual_confidence, haversine, vendor_overlap


def column(spark, values, function):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r[0] for r in df.orderBy("k").select(function(F.col("c"))).collect()]


def test_money(spark):
    got = column(spark, ["₹ 4,324.08 Crore", "1.5CR", "1,09,747", "24.2L", "N/A", None, "abc", "-5"], cells.norm_money)
    assert [(r.value, r.unit) for r in got] == [
        (Decimal("4324.08"), "CRORE"), (Decimal("1.5"), "CRORE"), (Decimal("109747"), "RUPEE"), (Decimal("24.2"), "LAKH"), (None, "RUPEE"), (None, "RUPEE"), (None, "RUPEE"), (Decimal("-5"), "RUPEE"),
    ]


def test_text_int_percent_date(spark):
    assert column(spark, ["Bengaluru    South", " nil ", ""], cells.norm_text) == ["Bengaluru South", None, None]
    assert column(spark, ["No. 109747", "1,234", "12.9", "-3.7", "x"], cells.norm_int) == [109747, 1234, 12, -3, None]
    assert column(spark, ["108%", "84.0", "-"], cells.norm_pct) == [Decimal(108), Decimal(84), None]
    days = column(spark, ["10-04-2025", "2025-4-1", "31/12/2024", "5 Jan 2024", "31-02-2024", "n/a", "2024-01-02T03:04:05"], cells.norm_date)
    assert [str(d) if d else None for d in days] == ["2025-04-10", "2025-04-01", "2024-12-31", "2024-01-05", None, None, "2024-01-02"]
    assert column(spark, ["1.5CR", "2L", "₹ 1,000", "x"], cells.parse_numeric) == [Decimal(15000000), Decimal(200000), Decimal(1000), None]


def test_vendor_and_confidence(spark):
    rows = [("Sri Balaji Constructions Pvt. Ltd.", "Sri Balaji Constr.", True), ("Public Works Department", "Municipal Corporation", False), (None, "x", None)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(vendor_overlap(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    pairs = [(10.0, True, "high"), (30.0, None, "medium"), (5500.0, True, "low"), (10.0, False, "low"), (None, None, "unavailable"), (None, True, "medium")]
    df = spark.createDataFrame(pairs, "d double, v boolean, want string")
    got = df.select(contextual_confidence(F.col("d"), F.col("v"), F.lit(0.5), F.lit(False), F.lit(False))["band"].alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    near = spark.range(1).select(haversine(F.lit(13.05), F.lit(77.5), F.lit(13.05027), F.lit(77.5)), haversine(F.lit(None), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert 29 < near[0] < 31 and near[1] is None

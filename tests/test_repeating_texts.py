"""More parts must not make the job on alike texts smaller: reports on duplicates read the register whose texts repeat."""

import duckdb
import pytest

from worksight import bench_views as views
from worksight import queries as own

SMALL = "/root/testdata/sf0.001"
QUERIES = (
    "duplicate_pairs",
    "duplicate_score",
    "duplicate_signals",
    "iforest_scores",
    "signal_counts",
    "priorities",
    "queue_top",
    "district_rollup",
    "work_detail",
    "stakeholder_summary",
    "precision_summary",
    "alert_digest",
    "open_cases",
    "confusion",
    "confusion_by_type",
    "false_positives",
)


class Read(Exception):
    """Tells which register a query reads."""


def tables(parts: int) -> duckdb.DuckDBPyConnection:
    """SMALL with its parts taken so many times, each time but the first under names of their own."""
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"CREATE VIEW {t + '_' if t == 'part' else t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    con.execute(f"""CREATE VIEW part AS SELECT * REPLACE (p_partkey + k * (SELECT count(*) FROM part_) AS p_partkey, CASE WHEN k > 0 THEN 'name' || p_partkey || 'x' || k ELSE p_name END AS p_name)
        FROM part_ CROSS JOIN range({parts}) r(k)""")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_reads_repeating_texts(monkeypatch, name):
    def works(spark, d):
        raise Read(type(d))

    monkeypatch.setattr(own, "works", works)
    monkeypatch.setattr(own, "kept", lambda spark, key, inputs, make: make())
    with pytest.raises(Read) as read:
        own.queries()[name](None, "")
    assert read.value.args == (own.Repeating,)
    assert views.sql(views.REPEATING) in own.oracle_sql()[name]


def test_more_parts_leave_all_pairs():
    sql = own.oracle_sql()["duplicate_pairs"]
    few, many = (sorted(tables(n).execute(sql).fetchall()) for n in (1, 10))
    assert few and [r[:3] for r in few] == [r[:3] for r in many]


def test_no_work_is_dropped_where_its_part_is_missing():
    con = tables(10)
    con.execute("CREATE TABLE kept_parts AS SELECT * FROM part WHERE p_partkey < 200 OR p_partkey % 3 = 0")
    assert con.execute(f"SELECT count(*) FROM ({views.sql(views.REPEATING)})".replace("JOIN part ", "JOIN kept_parts ")).fetchone() == con.execute("SELECT count(*) FROM orders").fetchone()

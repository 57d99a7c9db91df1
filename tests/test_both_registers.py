"""Reports on a whole detection run read the works under either text of the register, so that none is the smaller job."""

import duckdb
import pytest

from worksight import bench_views as views
from worksight import queries as own

SMALL = "/root/testdata/sf0.001"
QUERIES = (
    "iforest_scores",
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
    """Both registers have been asked for."""


@pytest.mark.parametrize("name", QUERIES)
def test_reads_both_registers(spark, monkeypatch, name):
    kinds = set()

    def works(spark_, d):
        kinds.add(type(d))
        if len(kinds) == 2:
            raise Read
        return views.works(spark, SMALL).limit(0)

    monkeypatch.setattr(own, "works", works)
    monkeypatch.setattr(own, "_run", lambda s, d, text=views.WORKS: own.register(s, d, text) and None)
    with pytest.raises(Read):
        own.queries()[name](spark, SMALL)
    assert views.sql(views.REPEATING) in own.oracle_sql()[name] and views.sql(views.WORKS) in own.oracle_sql()[name]


def test_each_order_is_a_work_of_either_register(spark):
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    both = con.execute(f"SELECT dataset_id, id, description, sector FROM ({views.sql(views.BOTH)})").fetchall()
    assert len(both) == len({r[:2] for r in both}) == 2 * con.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert sorted(both) == sorted(map(tuple, own.register(spark, SMALL, views.BOTH).select("dataset_id", "id", "description", "sector").collect()))
    plain = con.execute(f"SELECT dataset_id, id, description, sector FROM ({views.sql(views.WORKS)})").fetchall()
    assert set(plain) == {r for r in both if not r[0].startswith("R")}

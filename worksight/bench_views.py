"""The driver's tables as a register of works: one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TODAY = "2001-12-31"

WORKS = """
SELECT 'DS' || cast(n_regionkey % 2 AS string) AS dataset_id, o_orderkey + 1 AS source_row_number, cast(o_orderkey AS string) AS id,
  CASE WHEN o_orderkey % 500 = 1 THEN 'W-' || cast(o_orderkey - 1 AS string) ELSE 'W-' || cast(o_orderkey AS string) END AS work_id,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'MP ' || cast(o_custkey % 40 AS string) END AS mp_name,
  'C' || cast(o_custkey % 40 AS string) AS constituency, r_name AS state, n_name AS district,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'Ward ' || cast(k0 % 40 AS string) END AS location_text,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(8 + (k0 * 7 % 5003) * 0.004 AS decimal(10,7)) END AS latitude,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(70 + (k0 % 3511) * 0.004 AS decimal(10,7)) END AS longitude,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE c_mktsegment END AS category, p_brand AS sector,
  'Construction of ' || p_name || ' at ' || p_type || ' ward ' || cast(k0 % 40 AS string) || ' plot ' || cast(k0 - k0 % 4 AS string) ||
    CASE WHEN o_orderkey % 41 = 0 THEN ' temple' WHEN o_orderkey % 43 = 0 THEN ' office building' WHEN o_orderkey % 47 = 0 THEN ' repair work' WHEN o_orderkey % 51 = 0 THEN ' contemplation garden' ELSE '' END AS description,
  cast(o_totalprice AS decimal(14,2)) AS estimated_cost, cast(o_totalprice AS decimal(14,2)) AS sanctioned_cost,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE cast(cast(round(o_totalprice * 100) AS bigint) * (20 + o_orderkey % 95) * 0.0001 AS decimal(14,2)) END AS expenditure,
  cast(o_orderkey * 37 % 104 AS decimal(5,2)) AS financial_progress, CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE cast(o_orderkey * 53 % 101 AS decimal(5,2)) END AS physical_progress,
  cast(o_orderdate AS date) AS sanction_date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS start_date,
  CASE WHEN o_orderstatus = 'F' THEN cast(shipped AS date) ELSE NULL END AS completion_date, o_orderstatus AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'Seva Trust ' || n_name WHEN o_orderkey % 7 = 0 THEN 'Balaji Builders'
    WHEN o_orderkey % 10 < 5 + n_nationkey % 3 THEN 'Sri Balaji Constructions Pvt. Ltd.' WHEN o_orderkey % 2 = 0 THEN 'Kaveri Engineering Division' ELSE 'Narmada Works' END AS implementing_agency,
  cast(NULL AS string) AS contractor_name, CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE cast(200 + (o_orderkey % 7) * 60 AS int) END AS expected_duration_days
FROM (SELECT *, CASE WHEN o_orderkey % 19 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE o_orderkey END AS k0, (SELECT count(*) FROM {part}) AS parts FROM {orders}) o
JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
JOIN {part} p ON p_partkey = k0 % parts
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
"""

#: The same works under texts that repeat, as those of a register do: 200 names and types go round over all works, so that what texts have in
#: common, and with it the number of pairs of alike works, does not shrink as `part` grows. A work's sector is that of its own part.
REPEATING = (
    WORKS.replace("|| p_name || ' at ' || p_type ||", "|| t.p_name || ' at ' || t.p_type ||").replace("p_brand AS sector", "p.p_brand AS sector")
    .replace("JOIN {part} p ON p_partkey = k0 % parts", "LEFT JOIN {part} p ON p.p_partkey = k0 % parts\nJOIN {part} t ON t.p_partkey = k0 % 200")
)

#: The two registers as one, for DuckDB: each order is a work of either, and the datasets with R hold those under texts that repeat. It has all that
#: the first (texts from all parts) finds and all that the second does. queries.register() is the same for Spark.
BOTH = f"SELECT * REPLACE ('R' || dataset_id AS dataset_id) FROM ({REPEATING}) r\nUNION ALL SELECT * FROM ({WORKS}) w"

#: An export of works as text, with the flaws that exports have.
RAW_WORKS = """
SELECT dataset_id, source_row_number, CASE WHEN source_row_number % 211 = 0 THEN 'N/A' ELSE work_id END AS work_id, mp_name, constituency, '  ' || state || '  ' AS state,
  CASE WHEN source_row_number % 307 = 0 THEN '-' ELSE district END AS district, description, cast(estimated_cost AS string) AS estimated_cost,
  CASE WHEN source_row_number % 101 = 0 THEN 'nil' WHEN source_row_number % 103 = 0 THEN '-5' WHEN source_row_number % 5 = 0 THEN '₹ ' || cast(sanctioned_cost AS string) || ' Lakh'
    ELSE cast(sanctioned_cost AS string) END AS sanctioned_amount,
  cast(expenditure AS string) AS expenditure, cast(cast(physical_progress AS int) AS string) || '%' AS physical_progress, cast(cast(financial_progress AS int) AS string) || ' %' AS financial_progress,
  CASE WHEN source_row_number % 2 = 0 THEN cast(sanction_date AS string) ELSE substr(cast(sanction_date AS string), 9, 2) || '/' || substr(cast(sanction_date AS string), 6,
    2) || '/' || substr(cast(sanction_date AS string), 1, 4) END AS sanction_date,
  cast(completion_date AS string) AS completion_date, implementing_agency, CASE WHEN source_row_number % 401 = 0 THEN '123.5' ELSE cast(latitude AS string) END AS latitude, cast(longitude AS string) AS longitude,
  category, sector, status, contractor_name, cast(expected_duration_days AS string) AS expected_duration_days, cast(start_date AS string) AS start_date, location_text,
  CASE WHEN source_row_number % 3 = 0 THEN ' PAY-' || cast(source_row_number AS string) END AS payment_ref,
  CASE WHEN source_row_number % 21 = 0 THEN 'pending' WHEN source_row_number % 6 = 0 THEN '12.5 Lakh' WHEN source_row_number % 3 = 0 THEN cast(source_row_number % 900 + 1 AS string) || '.25' END AS payment_amount,
  CASE WHEN source_row_number % 9 = 0 THEN cast(sanction_date AS string) END AS paid_on, cast(NULL AS string) AS payee, CASE WHEN source_row_number % 3 = 0 THEN 'Stage   ' || cast(source_row_number % 4 AS string) END AS payment_stage
FROM ({works}) w
"""

#: The same in the older import's form.
LEGACY_WORKS = """
SELECT dataset_id, source_row_number, CASE WHEN source_row_number % 83 = 0 THEN '' ELSE work_id || ' ' END AS workid, state, CASE WHEN source_row_number % 89 = 0 THEN NULL ELSE district END AS district,
  description AS work_description, '₹ ' || cast(estimated_cost AS string) AS estimated_cost,
  CASE WHEN source_row_number % 101 = 0 THEN 'nil' WHEN source_row_number % 5 = 0 THEN cast(sanctioned_cost AS string) || ' L' WHEN source_row_number % 7 = 0 THEN '₹' || cast(sanctioned_cost AS string) || 'cr'
    ELSE cast(sanctioned_cost AS string) END AS sanctioned_cost,
  cast(financial_progress AS string) AS financial_progress, cast(physical_progress AS string) AS physical_progress, cast(latitude AS string) AS latitude_dd, cast(sanction_date AS string) AS sanction_date
FROM ({works}) w
"""

RAW_ALLOCATION = """
SELECT 'AL' || cast(c_nationkey % 3 AS string) AS dataset_id, c_custkey + 1 AS source_row_number, CASE WHEN c_custkey % 50 = 3 THEN 'x' ELSE 'No. ' || cast(c_custkey % 700 AS string) END AS serial_number,
  CASE WHEN c_custkey % 61 = 0 THEN '  ' ELSE c_mktsegment END AS state, CASE WHEN c_custkey % 67 = 0 THEN 'n/a' WHEN c_custkey % 71 = 0 THEN 'Same   Name' ELSE c_name END AS mp_name,
  CASE WHEN c_custkey % 73 = 0 THEN '?' ELSE cast(cast(c_acctbal * 100 AS decimal(14,0)) AS string) END AS allocated_amount
FROM {customer}
"""

RAW_AGGREGATE = """
SELECT 'AG' || cast(s_nationkey % 2 AS string) AS dataset_id, s_suppkey + 1 AS source_row_number, CASE WHEN s_suppkey % 2 = 0 THEN 'Lok Sabha' ELSE 'Rajya Sabha' END AS house,
  cast(cast(s_acctbal AS decimal(14,2)) AS string) || ' Crore' AS allocated_limit, '1,000.50 cr' AS amount_consented_for_calamity, '12.5 Lakh' AS expenditure_completed_and_ongoing,
  cast(s_suppkey * 7 AS string) AS works_recommended, cast(s_suppkey % 90 AS string) AS works_sanctioned, cast(s_suppkey * 3 % 97 - 2 AS string) AS works_completed, '2024-03-31' AS as_of_date
FROM {supplier}
"""

#: The events table as a case log. Five event types stand for statuses, in order of their names; case ids are users.
CASE_EVENTS = """
SELECT cast(user_id AS string) AS case_id, event_id AS seq, cast(ts AS timestamp) AS ts, 'STATUS_CHANGED' AS event_type,
  CASE event_id % 6 WHEN 0 THEN 'UNDER_REVIEW' WHEN 1 THEN 'FIELD_VERIFICATION' WHEN 2 THEN 'RESOLVED' WHEN 3 THEN 'CLOSED' WHEN 4 THEN 'ESCALATED' ELSE 'UNDER_REVIEW' END AS to_status,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'CONFIRMED_CONCERN' WHEN event_id % 11 = 0 THEN 'NONSENSE' ELSE 'NOT_SUBSTANTIATED' END AS resolution_type,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'OTHER' END AS resolution_reason, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS resolution_summary
FROM {events}
"""

#: Cases of works: some orders have one or two.
CASES = """
SELECT 'K' || cast(o_orderkey AS string) || '-' || cast(k AS string) AS case_id, cast(o_orderkey AS string) AS project_id, cast(o_orderdate AS timestamp) AS opened_at, cast(o_orderdate AS timestamp) AS updated_at,
  CASE (o_orderkey + k) % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RESOLVED' WHEN 2 THEN 'CLOSED' ELSE 'UNDER_REVIEW' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  CASE WHEN (o_orderkey + k) % 4 IN (1, 2) THEN CASE WHEN o_orderkey % 5 < 3 THEN 'CONFIRMED_CONCERN' ELSE 'FALSE_POSITIVE' END END AS resolution_type
FROM {orders} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) t WHERE o_orderkey % 37 = 0 AND (k = 1 OR o_orderkey % 74 = 0)
"""

#: What else a report on a case holds: its events, and notes.
REPORT_EVENTS = """
SELECT 'K' || cast(user_id * 37 AS string) || '-1' AS case_id, 'E' || cast(event_id AS string) AS event_id, event_id AS seq, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'OPEN' END AS from_status,
  CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' ELSE 'UNDER_REVIEW' END AS to_status, CASE WHEN event_id % 10 = 0 THEN date_trunc('hour', cast(ts AS timestamp)) ELSE cast(ts AS timestamp) END AS created_at FROM {events}
"""
REPORT_NOTES = """
SELECT 'K' || cast(user_id * 37 AS string) || '-1' AS case_id, 'N' || cast(event_id AS string) AS note_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'officer ' || cast(event_id % 5 AS string) END AS author_id,
  'seen on site: ' || props AS body, cast(ts AS timestamp) AS created_at FROM {events} WHERE event_id % 3 = 0
"""

TRUTH = """
SELECT cast(o_orderkey AS string) AS record_id, o_orderkey % 23 = 0 AS injected, CASE WHEN o_orderkey % 23 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'gap' ELSE 'cost' END END AS anomaly_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'FIN_PHYS_GAP' ELSE 'COST_ANOMALY' END AS expected_detector FROM {orders}
"""

TABLES = ("orders", "customer", "nation", "region", "part", "lineitem", "supplier", "events")


#: Files that the raw works are written to as exports.
FILES = 16


def sql(text: str) -> str:
    """The text over plain table names, for DuckDB."""
    return text.format(works=WORKS.format(**{t: t for t in TABLES}) if "{works}" in text else "", **{t: t for t in TABLES})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def works(spark: SparkSession, sf_dir: str, text: str = WORKS) -> DataFrame:
    return view(spark, sf_dir, text)


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_works(spark, sf_dir, RAW_WORKS)


def over_works(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("({works})", "{works}"), works=works(spark, sf_dir))

"""The loan table the queries run on, derived from orders and customers.

The driver tables hold no loans. The statement below plants originations
(``S``), their purchases (``P``) and second purchases (``Q``); it means the
same in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOANS = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS nk, o_totalprice AS tp, CAST(year(o_orderdate) AS INT) AS yr
  FROM orders JOIN customer ON o_custkey = c_custkey),
sides AS (
  SELECT 'S' AS side, base.* FROM base WHERE k % 10 <> 9
  UNION ALL SELECT 'P' AS side, base.* FROM base WHERE k % 10 >= 4
  UNION ALL SELECT 'Q' AS side, base.* FROM base WHERE k % 17 = 0)
SELECT
  concat(side, CAST(k AS STRING)) AS HMDAIndex,
  CASE WHEN side = 'S' THEN 1e0 ELSE 6e0 END AS action_taken,
  CAST(CASE WHEN side <> 'S' AND k % 7 = 0 THEN yr + 1 ELSE yr END AS INT) AS activity_year,
  concat('L', CAST(CASE WHEN side = 'S' THEN k % 20 ELSE (k + 7) % 20 END AS STRING)) AS lei,
  CAST(CASE WHEN side = 'S' THEN CASE k % 10 WHEN 0 THEN 0 WHEN 5 THEN 0 WHEN 1 THEN 8 WHEN 3 THEN 8 WHEN 4 THEN 8 WHEN 2 THEN 1 ELSE 6 END
            WHEN side = 'Q' THEN 6 ELSE k % 3 END AS DOUBLE) AS purchaser_type,
  CAST(k % 4 + 1 AS DOUBLE) AS loan_type,
  CAST(CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN side <> 'S' AND k % 19 = 0 THEN 32 ELSE 31 END WHEN 2 THEN 32
       ELSE CASE WHEN side <> 'S' AND k % 23 = 0 THEN 4 WHEN side <> 'S' AND k % 29 = 0 THEN 31 ELSE 2 END END AS DOUBLE) AS loan_purpose,
  CAST(k % 3 + 1 AS DOUBLE) AS occupancy_type,
  CAST(10000 * floor(tp / 10000) + 5000 - CASE WHEN side <> 'S' AND k % 11 = 0 THEN 10000 ELSE 0 END AS DOUBLE) AS loan_amount,
  CAST(floor(tp / 1000) AS DOUBLE) AS loan_amount_thousands,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 101 = 0 THEN '' WHEN k % 103 = 0 THEN NULL ELSE concat('T', CAST(nk AS STRING)) END AS census_tract,
  CAST(nk % 5 + 1 AS DOUBLE) AS county_code,
  CASE WHEN k % 41 = 0 THEN 'Exempt' ELSE CAST(ck % 200 + 20 + CASE WHEN side <> 'S' AND k % 61 = 0 THEN 2 WHEN side <> 'S' AND k % 5 = 0 THEN 1 ELSE 0 END AS STRING) END AS income,
  CASE WHEN k % 43 = 0 THEN 'Exempt' WHEN k % 47 = 0 THEN NULL
       ELSE CAST(2e0 + (k % 40) * 0.125e0 + CASE WHEN side <> 'S' AND k % 13 = 0 THEN 0.02e0 ELSE 0e0 END AS STRING) END AS interest_rate,
  CASE WHEN side <> 'S' AND k % 59 = 0 THEN '240' WHEN k % 2 = 0 THEN '360' ELSE '180' END AS loan_term,
  CASE WHEN k % 29 = 0 THEN '360' WHEN k % 6 = 0 THEN '60' ELSE NULL END AS intro_rate_period,
  CAST(CAST(10000 * floor(tp / 8000) + 5000 + CASE WHEN side <> 'S' AND k % 53 = 0 THEN 30000 ELSE 0 END AS BIGINT) AS STRING) AS property_value,
  CASE k % 8 WHEN 0 THEN '5-24' WHEN 1 THEN '>149' ELSE '1' END AS total_units,
  CASE WHEN k % 6 = 5 THEN '1111' ELSE CAST(1000 + k % 500 + CASE WHEN side <> 'S' AND k % 14 = 0 THEN 3 ELSE 0 END AS STRING) END AS total_loan_costs,
  CASE WHEN k % 6 = 5 THEN '1111' WHEN side <> 'S' AND k % 56 = 0 THEN CAST(500 + k % 300 AS STRING) ELSE NULL END AS total_points_and_fees,
  CASE WHEN k % 6 = 5 THEN '1111' ELSE CAST(500 + k % 300 + CASE WHEN side <> 'S' AND k % 4 = 0 THEN 1 ELSE 0 END AS STRING) END AS origination_charges,
  CASE WHEN k % 6 = 5 THEN '1111' WHEN k % 6 = 4 THEN '0' ELSE CAST(100 + k % 90 + CASE WHEN side <> 'S' AND k % 7 = 0 THEN 1 ELSE 0 END AS STRING) END AS discount_points,
  CASE WHEN k % 6 = 5 THEN '1111' WHEN k % 6 = 3 THEN CAST(200 + k % 50 + CASE WHEN side <> 'S' AND k % 73 = 0 THEN 30 ELSE 0 END AS STRING) ELSE NULL END AS lender_credits,
  CASE k % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'NC' ELSE 'U' END AS conforming_loan_limit,
  CASE WHEN side <> 'S' AND k % 67 = 0 THEN 2e0 ELSE 1e0 END AS construction_method,
  CAST(k % 2 + 1 AS DOUBLE) AS lien_status,
  CASE WHEN side <> 'S' AND k % 71 = 0 THEN 1e0 ELSE 2e0 END AS open_end_line_of_credit,
  CASE WHEN side <> 'S' AND k % 23 = 0 THEN '8888' ELSE CASE ck % 7 WHEN 0 THEN '<25' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' WHEN 3 THEN '45-54' WHEN 4 THEN '55-64' WHEN 5 THEN '65-74' ELSE '>74' END END AS applicant_age,
  CASE WHEN k % 2 = 0 THEN '9999' ELSE '35-44' END AS co_applicant_age,
  CASE WHEN ck % 7 >= 5 THEN 'Yes' WHEN ck % 7 = 4 THEN 'NA' ELSE 'no' END AS applicant_age_above_62,
  CASE WHEN k % 2 = 0 THEN NULL WHEN ck % 7 >= 5 THEN 'Yes' ELSE 'no' END AS co_applicant_age_above_62,
  CASE k % 5 WHEN 0 THEN '<20%' WHEN 1 THEN '30%-<36%' WHEN 2 THEN '41' WHEN 3 THEN '>60%' ELSE 'Exempt' END AS debt_to_income_ratio,
  CAST(CASE WHEN side <> 'S' AND k % 31 = 0 THEN 4 ELSE ck % 2 + 1 END AS DOUBLE) AS applicant_sex,
  CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE (ck + 1) % 2 + 1 END AS DOUBLE) AS co_applicant_sex,
  CAST(CASE WHEN side <> 'S' AND ck % 9 = 0 AND k % 3 = 0 THEN 5 WHEN side = 'S' AND ck % 5 = 1 THEN 21 ELSE ck % 5 + 1 END AS DOUBLE) AS applicant_race_1,
  CAST(CASE WHEN ck % 9 = 0 THEN CASE WHEN side <> 'S' AND k % 3 = 0 THEN ck % 5 + 1 ELSE 5 END END AS DOUBLE) AS applicant_race_2,
  CAST(CASE WHEN k % 2 = 0 THEN 8 ELSE 5 END AS DOUBLE) AS co_applicant_race_1,
  CAST(CASE WHEN side <> 'S' AND ck % 3 = 1 AND k % 3 = 1 THEN 1 WHEN side = 'S' AND ck % 3 = 0 THEN 11 WHEN ck % 3 = 0 THEN 1 WHEN ck % 3 = 1 THEN 2 ELSE 3 END AS DOUBLE) AS applicant_ethnicity_1,
  CAST(CASE WHEN ck % 3 = 1 AND k % 3 = 1 THEN CASE WHEN side = 'S' THEN 1 ELSE 2 END END AS DOUBLE) AS applicant_ethnicity_2,
  CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE 2 END AS DOUBLE) AS co_applicant_ethnicity_1,
  concat('R', CAST(CASE WHEN side = 'S' OR k % 83 = 0 THEN k % 20 ELSE (k + 7) % 20 END AS STRING)) AS respondent_id,
  CAST(k % 9 + 1 AS DOUBLE) AS agency_code,
  k AS sequence_number,
  CAST((k + CASE WHEN side <> 'S' AND k % 37 = 0 THEN 1 ELSE 0 END) % 3 + 1 AS DOUBLE) AS property_type,
  CASE k % 4 WHEN 0 THEN 'Y' WHEN 1 THEN '0' WHEN 2 THEN 'true' ELSE NULL END AS rural_indicator
FROM sides
"""

# Slots that the statement leaves out: no loan reports them.
EMPTY_SLOTS = [
    *[f"applicant_race_{n}" for n in (3, 4, 5)],
    *[f"co_applicant_race_{n}" for n in (2, 3, 4, 5)],
    *[f"{who}_ethnicity_{n}" for who in ("applicant", "co_applicant") for n in (2, 3, 4, 5) if (who, n) != ("applicant", 2)],
]
LOANS_SQL = f"""
SELECT loans.*, {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in EMPTY_SLOTS)}
FROM ({LOANS}) AS loans
"""


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    statement = LOANS_SQL.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}")
    return spark.sql(statement, orders=orders, customer=customer)

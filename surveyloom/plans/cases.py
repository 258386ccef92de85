"""The labelled survey table that the registered queries analyse, derived from orders, customers and nations.

One row per order; answers are hash digits of the order key, and the label follows severity and access
with some noise, so that classifiers have something to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.schema import CASE_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(key: Column, tag: str) -> Column:
    """A non-negative integer drawn from key and tag."""
    text = F.md5(F.concat_ws(":", key.cast("string"), F.lit(tag)))
    return F.conv(F.substring(text, 1, 6), 16, 10).cast("int")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("o_orderkey")
    answers = joined.select(
        k.alias("case_id"),
        F.col("n_name").alias("district_name"),
        F.col("n_nationkey").alias("district_code"),
        (digits(k, "gender") % 2).alias("gender"),
        (digits(k, "severity") % 7).alias("severity"),
        (digits(k, "diet") % 2).alias("diet"),
        (digits(k, "smoke") % 2).alias("smoke"),
        (digits(k, "water") % 2).alias("water"),
        (digits(k, "toilet") % 2).alias("toilet"),
        (digits(k, "access") % 2).alias("hard_access"),
        (digits(k, "noise") % 5).alias("noise"),
    )
    risk = 2 * F.col("severity") + 3 * F.col("hard_access") + F.col("noise")
    labelled = answers.withColumn("label", F.when(risk >= 10, 1).otherwise(0))
    return labelled.select(*CASE_SCHEMA.names)


def gapped_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with some answers missing, for the null paths."""
    gap = digits(F.col("case_id"), "gap")
    return cases(spark, sf_dir).withColumns(
        {
            "severity": F.when(gap % 17 != 0, F.col("severity")),
            "water": F.when(gap % 11 != 0, F.col("water")),
            "district_name": F.when(gap % 13 != 0, F.col("district_name")),
        }
    )


def _digits_sql(tag: str, key: str = "o_orderkey") -> str:
    return f"cast(('0x'||substr(md5(concat_ws(':', cast({key} as varchar), '{tag}')),1,6)) as int)"


CASES_SQL = f"""
with answers as (
  select o_orderkey as case_id, n_name as district_name, n_nationkey as district_code,
         {_digits_sql('gender')} % 2 as gender, {_digits_sql('severity')} % 7 as severity,
         {_digits_sql('diet')} % 2 as diet, {_digits_sql('smoke')} % 2 as smoke,
         {_digits_sql('water')} % 2 as water, {_digits_sql('toilet')} % 2 as toilet,
         {_digits_sql('access')} % 2 as hard_access, {_digits_sql('noise')} % 5 as noise
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
cases as (
  select case_id, district_name, district_code, gender, severity, diet, smoke, water, toilet, hard_access,
         cast(case when 2*severity + 3*hard_access + noise >= 10 then 1 else 0 end as int) as label
  from answers)"""

GAPPED_SQL = (
    CASES_SQL
    + f""",
gapped as (
  select case_id, case when {_digits_sql('gap', 'case_id')} % 13 <> 0 then district_name end as district_name,
         district_code, gender,
         case when {_digits_sql('gap', 'case_id')} % 17 <> 0 then severity end as severity, diet, smoke,
         case when {_digits_sql('gap', 'case_id')} % 11 <> 0 then water end as water, toilet, hard_access, label
  from cases)"""
)

"""Dirty contact records derived from the customer table by one SQL text that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanloom.functions.session import table

VIEW = """
SELECT c_custkey + 2 AS row_number,
  CASE WHEN c_custkey % 43 = 0 THEN repeat('Ayşe', 30) WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '   '
       WHEN c_custkey % 7 = 0 THEN concat('  Ali   ', CAST(c_custkey AS VARCHAR(20)), '  ')
       ELSE concat('Ali', CAST(c_custkey AS VARCHAR(20))) END AS first_name,
  CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN concat('Yılmaz', chr(9), 'Kaya') ELSE 'Yılmaz' END AS last_name,
  CASE WHEN c_custkey % 47 = 0 THEN 'shared@example.test' WHEN c_custkey % 17 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@@example.test')
       WHEN c_custkey % 5 = 0 THEN concat(' User', CAST(c_custkey AS VARCHAR(20)), '@EXAMPLE.Test ')
       ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.test') END AS email,
  CASE c_custkey % 6 WHEN 0 THEN concat('+905', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'))
       WHEN 1 THEN concat('05', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'))
       WHEN 2 THEN concat('90 5', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'))
       WHEN 3 THEN concat('(05', substr(lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'), 1, 2), ') ', substr(lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0'), 3, 7))
       WHEN 4 THEN '0532123' ELSE 'abc-phone' END AS phone,
  CASE c_custkey % 8 WHEN 0 THEN 'Acme A.S.' WHEN 1 THEN 'Nova AS' WHEN 2 THEN 'Pera LTD STI' WHEN 3 THEN 'ATLAS' WHEN 4 THEN 'Vega A.Ş.'
       WHEN 5 THEN 'A' WHEN 6 THEN 'Ege AS Holding' ELSE c_mktsegment END AS company,
  CASE c_nationkey % 5 WHEN 0 THEN 'istanbul' WHEN 1 THEN 'ISTANBUL' WHEN 2 THEN 'Ankara' WHEN 3 THEN 'UnknownTown' ELSE 'İzmir' END AS city,
  CASE c_custkey % 4 WHEN 0 THEN 'Kadıköy' WHEN 1 THEN 'kadikoy' WHEN 2 THEN 'Çankaya' ELSE NULL END AS district,
  CASE WHEN c_custkey % 37 = 0 THEN repeat('Uzun Cad. ', 60) WHEN c_custkey % 29 = 0 THEN '12' WHEN c_custkey % 3 = 0 THEN concat('Moda  Cad. No:', CAST(c_custkey % 250 AS VARCHAR(20)))
       ELSE concat('Moda Cad. No:', CAST(c_custkey % 250 AS VARCHAR(20))) END AS address
FROM customer"""


def contacts(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(VIEW.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))

"""Claims-shaped views over the driver's TPC-H-like tables.

``claims`` (one row per order), ``diagnoses`` and ``procedures`` (one row per
line item) carry realistic dirt: nulls, stray case and blanks, malformed
codes, repeated primaries, claims without a primary and exact duplicate rows.
The DataFrame versions below are what the library runs; the SQL text at the
bottom is the same derivation for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.sources.tables import read_table


def _s(c: Column) -> Column:
    return c.cast("string")


def _letter(c: Column) -> Column:
    return F.chr((F.lit(65) + c % 26).cast("int"))


def claims(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Claims view; ``orders`` may be given (e.g. a stream of orders)."""
    o = (orders if orders is not None else read_table(spark, sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ship = (read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
            .groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
         .join(ship, ship.l_orderkey == o.o_orderkey, "left"))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    sev = (F.when(k % 4 == 0, "0").when(k % 4 == 1, "i").when(k % 4 == 2, "II").otherwise("III"))
    return j.select(
        k.alias("id"),
        ck.alias("id_peserta"),
        F.when(k % 23 == 0, None).otherwise(_s(1 + k % 5)).alias("jenispulang"),
        F.when(k % 29 == 0, None).when(k % 2 == 0, " l").otherwise("P ").alias("jenkel"),
        F.when(k % 31 == 0, None).otherwise(_s(1 + ck % 4)).alias("pisat"),
        F.when(k % 37 == 0, None).when(k % 41 == 0, "-").when(k % 43 == 0, "h8.14")
         .when(k % 47 == 0, "ZO3.9").when(k % 53 == 0, "123")
         .otherwise(F.concat(_letter(ck), F.lpad(_s((k * 7) % 100), 2, "0"), F.lit("."), _s(k % 10)))
         .alias("diagfktp"),
        F.when(k % 19 == 0, None).otherwise(F.col("o_totalprice") * 100).alias("biaya"),
        _s(100 + ck % 400).alias("dati2"),
        F.col("c_mktsegment").alias("typefaskes"),
        (ck % 97).cast("int").alias("usia"),
        F.col("o_orderdate").alias("tgldatang"),
        F.col("ship").alias("tglpulang"),
        _s(1 + k % 2).alias("jenispel"),
        F.col("o_orderpriority").alias("politujuan"),
        F.when(k % 59 == 0, "X").when(k % 61 == 0, "A-B-C-D-E")
         .when(k % 7 == 0, F.concat(_letter(k), F.lit("-"), _s(k % 99 + 1), F.lit("-II")))
         .otherwise(F.concat(_letter(k), F.lit("-"), _s(k % 10), F.lit("-"), _s(k % 99 + 1), F.lit("-"), sev))
         .alias("cbg"),
        (1 + k % 3).cast("int").alias("kelasrawat"),
        F.when(k % 11 == 0, "Q-5-44-0").when(k % 13 == 0, None).otherwise("-").alias("kdsa"),
        F.when(k % 17 == 0, "RR-04-III").otherwise("-").alias("kdsp"),
        F.when(k % 67 == 0, "YY-01-II").otherwise("None").alias("kdsr"),
        F.when(k % 71 == 0, "II-03-I").otherwise("-").alias("kdsi"),
        F.when(k % 79 == 0, "DD-12-II").otherwise("").alias("kdsd"),
        F.when(k % 73 == 0, 1).otherwise(0).alias("label"),
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    diag = (F.when(p % 67 == 0, None)
            .when(p % 71 == 0, F.concat(F.lit("9"), _s(p)))
            .when(p % 13 == 0, _letter(p))
            .otherwise(F.concat(_letter(p), F.lpad(_s(s % 100), 2, "0"), F.lit("."), _s(p % 10))))
    return li.select(
        F.col("l_orderkey").alias("id"),
        diag.alias("diag"),
        F.when(F.col("l_linenumber") <= 2, 1).otherwise(2).alias("levelid"),
        (p * 1000000 + s * 10 + F.col("l_linenumber")).alias("ord"),
    )


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return li.select(F.col("l_orderkey").alias("id"),
                     F.concat(F.lpad(_s(F.col("l_suppkey") % 100), 2, "0"), F.lit(".0")).alias("proc"))


def fixture_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return claims(spark, sf_dir), diagnoses(spark, sf_dir), procedures(spark, sf_dir)


# --- the same three views as SQL text (for the DuckDB oracle) --------------
CLAIMS_SQL = """
SELECT o_orderkey AS id, o_custkey AS id_peserta,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 5 AS string) END AS jenispulang,
 CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN ' l' ELSE 'P ' END AS jenkel,
 CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(1 + o_custkey % 4 AS string) END AS pisat,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN '-'
      WHEN o_orderkey % 43 = 0 THEN 'h8.14' WHEN o_orderkey % 47 = 0 THEN 'ZO3.9' WHEN o_orderkey % 53 = 0 THEN '123'
      ELSE chr(CAST(65 + o_custkey % 26 AS int)) || lpad(CAST((o_orderkey * 7) % 100 AS string), 2, '0') || '.' || CAST(o_orderkey % 10 AS string) END AS diagfktp,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice * 100 END AS biaya,
 CAST(100 + o_custkey % 400 AS string) AS dati2,
 c_mktsegment AS typefaskes, CAST(o_custkey % 97 AS int) AS usia,
 o_orderdate AS tgldatang, ship AS tglpulang,
 CAST(1 + o_orderkey % 2 AS string) AS jenispel, o_orderpriority AS politujuan,
 CASE WHEN o_orderkey % 59 = 0 THEN 'X' WHEN o_orderkey % 61 = 0 THEN 'A-B-C-D-E'
      WHEN o_orderkey % 7 = 0 THEN chr(CAST(65 + o_orderkey % 26 AS int)) || '-' || CAST(o_orderkey % 99 + 1 AS string) || '-II'
      ELSE chr(CAST(65 + o_orderkey % 26 AS int)) || '-' || CAST(o_orderkey % 10 AS string) || '-' || CAST(o_orderkey % 99 + 1 AS string) || '-'
           || CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'i' WHEN 2 THEN 'II' ELSE 'III' END END AS cbg,
 CAST(1 + o_orderkey % 3 AS int) AS kelasrawat,
 CASE WHEN o_orderkey % 11 = 0 THEN 'Q-5-44-0' WHEN o_orderkey % 13 = 0 THEN NULL ELSE '-' END AS kdsa,
 CASE WHEN o_orderkey % 17 = 0 THEN 'RR-04-III' ELSE '-' END AS kdsp,
 CASE WHEN o_orderkey % 67 = 0 THEN 'YY-01-II' ELSE 'None' END AS kdsr,
 CASE WHEN o_orderkey % 71 = 0 THEN 'II-03-I' ELSE '-' END AS kdsi,
 CASE WHEN o_orderkey % 79 = 0 THEN 'DD-12-II' ELSE '' END AS kdsd,
 CASE WHEN o_orderkey % 73 = 0 THEN 1 ELSE 0 END AS label
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey
"""

DIAGNOSES_SQL = """
SELECT l_orderkey AS id,
 CASE WHEN l_partkey % 67 = 0 THEN NULL WHEN l_partkey % 71 = 0 THEN '9' || CAST(l_partkey AS string)
      WHEN l_partkey % 13 = 0 THEN chr(CAST(65 + l_partkey % 26 AS int))
      ELSE chr(CAST(65 + l_partkey % 26 AS int)) || lpad(CAST(l_suppkey % 100 AS string), 2, '0') || '.' || CAST(l_partkey % 10 AS string) END AS diag,
 CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END AS levelid,
 l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS ord
FROM lineitem
"""

PROCEDURES_SQL = """
SELECT l_orderkey AS id, lpad(CAST(l_suppkey % 100 AS string), 2, '0') || '.0' AS proc FROM lineitem
"""


def fixture_ctes() -> str:
    """``WITH``-clause body defining claims, diagnoses, procedures."""
    return (f"claims AS ({CLAIMS_SQL}),\n diagnoses AS ({DIAGNOSES_SQL}),\n"
            f" procedures AS ({PROCEDURES_SQL})")

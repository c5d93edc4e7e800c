"""Views of the star-schema tables in the shapes of a run, so that the operators can be held against SQL at any scale.

orders are spectra, lineitem their points, events chromatograms, embeddings wavelength spectra, part a target list. BASE is the
same mapping as SQL text. Points have no unique line number; (line, price) orders the points of a spectrum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CENTROID, COLLISION_ENERGY, PARAM, PROFILE

ORDER = ("line", "price")

BASE = """
WITH meta AS (
  SELECT o_orderkey AS spectrum_index, 'controllerType=0 controllerNumber=1 scan=' || (o_orderkey + 1) AS id,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS ms_level, o_totalprice / 1000 AS rt,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 1 WHEN o_orderpriority[1] IN ('4', '5') THEN -1 END AS polarity_code,
         CASE WHEN o_orderstatus = 'F' THEN 'MS:1000128' ELSE 'MS:1000127' END AS representation,
         nullif(o_custkey % 5, 0) AS charge, o_totalprice / 100 AS ion_mz, o_custkey AS cust
  FROM orders),
point AS (
  SELECT l_orderkey AS spectrum_index, l_linenumber AS line, l_extendedprice AS price, l_extendedprice / 100 AS mz, l_quantity AS intensity FROM lineitem),
marked AS (SELECT spectrum_index, line, price, CASE WHEN line % 3 <> 0 THEN mz END AS mz, intensity FROM point)
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("spectrum_index"),
        F.concat(F.lit("controllerType=0 controllerNumber=1 scan="), (F.col("o_orderkey") + 1).cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("ms_level"),
        (F.col("o_totalprice") / 1000).alias("rt"),
        F.when(first.isin("1", "2"), 1).when(first.isin("4", "5"), -1).alias("polarity_code"),
        F.when(F.col("o_orderstatus") == "F", PROFILE).otherwise(CENTROID).alias("representation"),
        F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("charge"),
        (F.col("o_totalprice") / 100).alias("ion_mz"),
        F.col("o_custkey").alias("cust"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum_index"), F.col("l_linenumber").alias("line"), price.alias("price"), (price / 100).alias("mz"), F.col("l_quantity").alias("intensity"))


def marked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("mz", F.when(F.col("line") % 3 != 0, F.col("mz")))


def chromatogram_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("chromatogram_index"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("micros"), F.col("value").alias("intensity"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), (F.col("p_retailprice") / 2).alias("target_mz"))


def param(name: str, accession: Column, integer: Column | None = None, number: Column | None = None, text: Column | None = None, flag: Column | None = None) -> Column:
    arms = (("integer", integer, "bigint"), ("float", number, "double"), ("string", text, "string"), ("boolean", flag, "boolean"))
    value = F.struct(*[(F.lit(None) if v is None else v).cast(kind).alias(arm) for arm, v, kind in arms])
    return F.struct(F.lit(name).alias("name"), accession.alias("accession"), value.alias("value"), F.lit(None).cast("string").alias("unit"))


def activation() -> Column:
    """Activation parameters of a spectrum by its customer: a method, none, or a foreign term, and for some an energy."""
    kind = F.col("cust") % 4
    method = F.when(kind == 0, param("CID", F.lit("MS:1000133"))).when(kind == 1, param("HCD", F.lit("MS:1000422"))).when(kind == 2, param("other", F.lit("MS:9999999")))
    energy = F.when(F.col("cust") % 3 != 0, param("collision energy", F.lit(COLLISION_ENERGY), number=(F.col("cust") % 50).cast("double")))
    return F.filter(F.array(method, energy), lambda p: p.isNotNull()).cast(f"array<{PARAM}>")

"""The star-schema test tables seen as instrument results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A total order of a file's rows; line numbers alone repeat.
PLACE = ["peak_number", "l_partkey", "l_suppkey", "l_shipdate", "area"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One peak for each order line, with the part's brand as compound."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("compound"))
    second = F.when(F.col("l_returnflag") == "R", F.col("l_tax"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("file_id"), F.concat(F.lit("order_"), "l_orderkey").alias("sample_id"), F.concat(F.lit("order_"), "l_orderkey", F.lit(".csv")).alias("source_file"),
        F.col("l_returnflag").alias("detector"), F.col("l_linestatus").alias("channel"), F.col("l_linenumber").alias("peak_number"), F.col("l_quantity").alias("retention_time"),
        F.lit("min").alias("retention_time_unit"), F.col("l_extendedprice").alias("area"), F.col("l_discount").alias("height"), "compound",
        second.alias("secondary_retention_time"), F.when(second.isNotNull(), "s").alias("secondary_retention_time_unit"),
        F.lit(None).cast("string").alias("area_unit"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"),
        "l_partkey", "l_suppkey", "l_shipdate",
    )


PEAKS_SQL = """peaks AS (
  SELECT l_orderkey AS file_id, 'order_' || l_orderkey AS sample_id, l_returnflag AS detector, l_linestatus AS channel, l_linenumber AS peak_number,
    l_quantity AS retention_time, l_extendedprice AS area, l_discount AS height, p_brand AS compound, CASE WHEN l_returnflag = 'R' THEN l_tax END AS rt2, l_partkey, l_suppkey, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PLACE_SQL = "peak_number, l_partkey, l_suppkey, l_shipdate, area"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each order; orders of status P failed."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("file_id"), F.concat(F.lit("order_"), "o_orderkey").alias("sample_id"), F.concat(F.lit("order_"), "o_orderkey", F.lit(".csv")).alias("name"),
        F.concat("o_orderpriority", F.lit("/order_"), "o_orderkey", F.lit(".csv")).alias("relative_path"), F.lit(None).cast("string").alias("public_id"),
        F.col("o_orderkey").alias("input_order"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"),
        (F.col("o_orderstatus") != "P").alias("ok"), F.col("o_orderdate").alias("acquired_at"), (F.col("o_orderstatus") != "P").alias("reliable"), F.col("o_orderkey").alias("sequence"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    return o.select(
        F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("vendor"), F.col("o_totalprice").alias("runtime"), none.alias("detectors"), none.alias("channels"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal points: one series for each user and event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file_id"), F.col("event_type").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("x"), F.col("value").alias("y"), "ts", "event_id")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"), "source", "lang", F.concat("source", F.lit("/doc_"), "doc_id", F.lit("."), "lang").alias("relative_path"), "text",
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("input_order"),
    )


def observed(rows: DataFrame) -> DataFrame:
    """Peaks with their order in the detector and channel's stream."""
    w = Window.partitionBy("file_id", "detector", "channel").orderBy(*PLACE)
    return rows.withColumn("observation_order", F.row_number().over(w))

"""Ordinary tables as signals (signal_id, ch, idx, raw) and as byte streams (signal_id, data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.integers import wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sig_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels by the parity of event_id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("signal_id"), (F.col("event_id") % 2).cast("int").alias("ch"), F.expr("event_id div 2").alias("idx"), wrap(F.round(F.col("value") * 100).cast("long"), 16).alias("raw"))


def sig_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short mono signals, one a user."""
    e = read(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("signal_id"), F.lit(0).alias("ch"), idx.cast("long").alias("idx"), wrap(F.round(F.col("value") * 100).cast("long"), 16).alias("raw"))


def sig_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mono signal in the order of o_orderkey. Ranks are counted in blocks of keys and shifted by the counts of earlier blocks, so no task sorts all rows."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.expr("o_orderkey div 65536").alias("_b"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = o.groupBy(F.col("_b").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).select("_k", before.alias("_before"))
    idx = F.row_number().over(Window.partitionBy("_b").orderBy("o_orderkey")) - 1
    return o.withColumn("_i", idx).join(blocks, F.col("_b") == F.col("_k")).select(F.lit("orders").alias("signal_id"), F.lit(0).alias("ch"), (F.col("_i") + F.col("_before")).cast("long").alias("idx"), wrap(F.round(F.col("o_totalprice") * 100).cast("long"), 16).alias("raw"))


def sig_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of one vector's components each."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "x"))
    return v.select(F.col("vec_id").cast("string").alias("signal_id"), F.lit(0).alias("ch"), F.col("idx").cast("long").alias("idx"), F.round(F.col("x").cast("double") * 32767).cast("long").alias("raw"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where the input has fewer parts than there are cores: it is small then, and one part would be one task's."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def streams(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> DataFrame:
    t = spread(read(spark, sf_dir, table).select(key, text))
    return t.select(F.col(key).cast("long").alias("id"), F.encode(F.col(text), "UTF-8").alias("data"))

"""Driver test tables in sensor roles.

These functions only rename and select columns of the given tables so they
have the schemas the jobs expect; they do none of the jobs' work.

* facts ``(timestamp, value, ID, type)`` = ``events(ts, value, user_id, event_type)``;
* history / environment tables = the events of channels ``click, view`` /
  ``error, purchase, signup``;
* metadata = ``customer ⋈ nation ⋈ region``: id = c_custkey, vanity = c_name,
  building = r_name, floor = n_name, area = c_mktsegment,
  nodeTypeName = 'type_' || (c_custkey % 4);
* facts with repeated keys = ``lineitem(l_shipdate, l_quantity, l_suppkey, l_returnflag)``;
* few long series = ``lineitem(l_shipdate, l_quantity, l_linenumber, l_returnflag)``;
* 0/1 series = ``labels`` unpivoted to ``(ID = doc_id, type, value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.model import ChannelRouting

HISTORY_TYPES = ("click", "view")
ENV_TYPES = ("error", "purchase", "signup")
ROUTING = ChannelRouting(history=HISTORY_TYPES, env=ENV_TYPES,
                         default_channels=HISTORY_TYPES + ENV_TYPES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("ts").alias("timestamp"), F.col("value"), F.col("user_id").alias("ID"),
                     F.col("event_type").alias("type"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter(F.col("type").isin(list(HISTORY_TYPES)))


def env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter(F.col("type").isin(list(ENV_TYPES)))


def metadata_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with canonical column names (before normalisation)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = (c.join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    return j.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("vanity"),
                    F.col("r_name").alias("building"), F.col("n_name").alias("floor"),
                    F.col("c_mktsegment").alias("area"),
                    F.concat(F.lit("type_"), (F.col("c_custkey") % 4).cast("string")).alias("nodeTypeName"))


def repeated_key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("value"),
                     F.col("l_suppkey").alias("ID"), F.col("l_returnflag").alias("type"))


def long_series_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few, long series: ``lineitem`` keyed by (line number, return flag)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("value"),
                     F.col("l_linenumber").cast("bigint").alias("ID"), F.col("l_returnflag").alias("type"))


def label_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` unpivoted to ``(ID, type, value)`` with types quality / toxic."""
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").alias("ID"),
                     F.explode(F.array(
                         F.struct(F.lit("quality").alias("type"), F.col("quality").cast("double").alias("value")),
                         F.struct(F.lit("toxic").alias("type"), F.col("toxic").cast("double").alias("value")))
                     ).alias("s")).select("ID", "s.type", "s.value")

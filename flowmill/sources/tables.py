"""The driver's tables read as broker data, and literal dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(kind: str, value: Column) -> Column:
    """A header value: type tag and canonical text."""
    return F.struct(F.lit(kind).alias("t"), value.cast("string").alias("v"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publish log: one row per event, in the order of delivery_tag."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("delivery_tag"),
        F.col("ts").alias("published_at"),
        F.col("user_id"),
        F.col("event_type"),
        k.alias("k"),
        F.concat_ws(".", "event_type", F.col("user_id") % 10, k % 5).alias("routing_key"),
        F.create_map(F.lit("k"), typed("I", k), F.lit("type"), typed("S", F.col("event_type"))).alias("headers"),
        F.round(F.col("value") * 100).cast("long").alias("body_len"),
        (1 + F.col("event_id") % 2).cast("int").alias("delivery_mode"),
        (F.col("event_id") % 3 == 0).alias("mandatory"),
        (F.col("user_id") % 4).cast("int").alias("channel"),
    )


#: The same for an oracle: `with` clause text that defines `messages`.
MESSAGES_SQL = """messages as (
  select event_id + 1 as delivery_tag, ts as published_at, user_id, event_type, k,
         event_type || '.' || (user_id % 10) || '.' || (k % 5) as routing_key,
         cast(round(value * 100) as bigint) as body_len, cast(1 + event_id % 2 as integer) as delivery_mode,
         event_id % 3 = 0 as mandatory, cast(user_id % 4 as integer) as channel
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events))"""


def literal(v) -> str:
    """A value as SQL text that Spark and DuckDB read alike."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def values_sql(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    return "select * from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ") as t(" + ", ".join(columns) + ")"


def dimension(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A small relation whose size the optimizer knows, so it broadcasts it by itself."""
    escaped = [[v.replace("\\", "\\\\") if isinstance(v, str) else v for v in r] for r in rows]
    return spark.sql(values_sql(columns, escaped))

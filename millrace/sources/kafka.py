"""Kafka options and record encoding. The connector itself is a separate Spark module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kafka_options(
    servers: str, topic: str, group: str | None = None, offsets: str = "latest", max_per_trigger: int = 10000,
    sasl: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options for ``readStream.format("kafka")``."""
    out = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": offsets,
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }
    if group:
        out["kafka.group.id"] = group
    for key, value in (sasl or {}).items():
        out[f"kafka.{key}"] = value
    return out


def decode_records(df: DataFrame, schema: str | None = None) -> DataFrame:
    """Key and value as text; with ``schema`` the JSON fields of the value as columns."""
    text = df.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
    if schema is None:
        return text
    rest = [c for c in text.columns if c != "value"]
    return text.withColumn("__v", F.from_json("value", schema)).select(*rest, "__v.*")


def encode_records(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as binary key and JSON value, the shape a Kafka sink takes."""
    value = F.encode(F.to_json(F.struct(*df.columns)), "UTF-8").alias("value")
    if key is None:
        return df.select(F.lit(None).cast("binary").alias("key"), value)
    return df.select(F.encode(F.col(key).cast("string"), "UTF-8").alias("key"), value)

"""User code in Python."""

from __future__ import annotations

import json

import pandas as pd

from millrace.operators import udf as U
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()


@R.add(
    "scripted_transform",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::INT * 2 END AS doubled, CASE WHEN event_type <> 'error' THEN true END AS _processed,
    CASE WHEN event_type = 'error' THEN 'ValueError: bad record' END AS _error,
    CASE WHEN event_type <> 'error' THEN event_id END AS seen FROM events""",
)
def scripted_transform(spark, d):
    def step(record: dict) -> dict:
        if record["event_type"] == "error":
            raise ValueError("bad record")
        return {"seen": record["event_id"], "doubled": json.loads(record["props"])["k"] * 2, "_processed": True}

    out = U.map_records(load(spark, d, "events").select("event_id", "event_type", "props"), step, "seen bigint, doubled int, _processed boolean", keep=["event_id"])
    return out


@R.add("vector_udf", "SELECT vec_id, label, round(list_aggregate(embedding::DOUBLE[], 'max'), 5) AS peak FROM embeddings")
def vector_udf(spark, d):
    def peak(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(float(max(v)), 5))

    df = load(spark, d, "embeddings")
    return df.select("vec_id", "label", U.vector_udf(peak, "double")("embedding").alias("peak"))

"""User code in Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_records(df: DataFrame, fn: Callable[[dict], dict], schema: str, keep: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to each record; an exception goes into ``_error`` of that record and the job goes on. The input
    columns in ``keep`` are passed through."""
    kept = keep or []
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    passed = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                through = [record[c] for c in kept]
                try:
                    made = fn(record)
                    out.append([*through, *(made.get(n) for n in names), None])
                except Exception as e:  # noqa: BLE001 - user code
                    out.append([*through, *(None for _ in names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(out, columns=[*kept, *names, "_error"], dtype=object)

    return df.mapInPandas(run, f"{passed + ', ' if passed else ''}{schema}, _error string")


def vector_udf(fn: Callable[[pd.Series], pd.Series], kind: str):
    """A vectorized scalar function."""

    def run(values: pd.Series) -> pd.Series:
        return fn(values)

    return F.pandas_udf(run, returnType=kind)


"""Functions that a caller provides, run on rows: executions with a ledger, and counters of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPT = "call_ref string, status string, error string, output string"


def run_callback(requests: DataFrame, key: str, callback: Callable[[dict], str]) -> DataFrame:
    """Calls a function once for each request, as a table of attempts: its output, or the error that it raised.

    An error is a result of that request alone. Spark may run a lost task again, so a function with effects outside must itself
    tell by the key what it has done; write the attempts and join with ``latest.remaining`` before a second run.
    """
    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append((str(row[key]), "returned", None, callback(row)))
                except Exception as error:  # whatever the caller's function raises belongs to its request
                    out.append((str(row[key]), "error", f"{type(error).__name__}: {error}", None))
            yield pd.DataFrame(out, columns=["call_ref", "status", "error", "output"])

    return requests.mapInPandas(calls, ATTEMPT)


def counted(rows: DataFrame, text: str, counter: Callable[[str], int] | Column | None = None, name: str = "tokens") -> DataFrame:
    """Rows with the number of tokens of a text, by a caller's function or Column; without one it is estimated as a third of
    its bytes, rounded up. A null text has none."""
    if counter is None:
        value = F.ceil(F.octet_length(text) / 3).cast("long")
    elif isinstance(counter, Column):
        value = counter.cast("long")
    else:
        # Texts leave their Arrow batch one by one, so a worker never holds a batch of them as Python's own.
        def numbers(texts: pa.Array) -> pa.Array:
            return pa.array((None if t is None else counter(t) for t in (x.as_py() for x in texts)), pa.int64())

        value = F.arrow_udf(numbers, T.LongType())(F.col(text))
    return rows.withColumn(name, F.coalesce(F.when(F.col(text).isNotNull(), value), F.lit(0)))

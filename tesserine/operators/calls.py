"""Functions called at the owner of a key: requests go by target, results come back as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def called(requests: DataFrame, function: Callable[[pa.RecordBatch], pa.Array], result: str, target: str | None = None, ways: int = 1) -> DataFrame:
    """Every request with what the function returned. function: a batch to a column.

    With a target, the requests of each one meet in `ways` tasks, as a function
    that keeps something for its target needs; without, a function that does
    not is run where the rows lie, with no shuffle.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    names = [*requests.columns, "result"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, function(b)], names)

    if target is not None:
        way = F.pmod(F.xxhash64(*requests.columns), F.lit(ways))
        requests = requests.repartition(F.col(target), way)
    return requests.mapInArrow(run, f"{kinds}, result {result}")


def executions(requests: DataFrame, target: str = "target") -> DataFrame:
    """(target, requests, executions): every request runs once, at its target."""
    asked = requests.groupBy(target).agg(F.count("*").alias("requests"))
    done = called(requests.select(target), lambda b: pa.array([1] * b.num_rows, pa.int64()), "bigint", target).groupBy(target).agg(F.sum("result").alias("executions"))
    return asked.join(done, target)

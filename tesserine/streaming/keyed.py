"""A keyed table as a stream: writes and lookups with state for each key (an extension).

The first write of a key wins, first by its stamp; a lookup gets the value that
the key has once the writes of its batch and of all batches before are in, or
the default.  State is in Spark's store, so a query that is started again with
its checkpoint goes on where it ended.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesserine.session import shared_path

#: State of Python processors needs this store (fixed value).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWrite(StatefulProcessor):
    """State: the stamp and the value of a key's first write. Rows in: writes (stamp, value) and lookups (ask); out: changes of the key's value, and answers."""

    def __init__(self, default: str | None) -> None:
        self.default = default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "stamp string, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        had = tuple(self.first.get()) if self.first.exists() else None
        now, asks = had, []
        for part in rows:
            writes = part[part["ask"].isna()]
            if len(writes):
                least = writes.loc[writes["stamp"].idxmin()]
                if now is None or least["stamp"] < now[0]:
                    now = (least["stamp"], least["value"])
            asks += part["ask"].dropna().tolist()
        if now != had:
            self.first.update(now)
            yield pd.DataFrame({"key": [key[0]], "ask": [None], "stamp": [now[0]], "value": [now[1]]})
        if asks:
            value = self.default if now is None else now[1]
            yield pd.DataFrame({"key": [key[0]] * len(asks), "ask": asks, "stamp": [None] * len(asks), "value": [value] * len(asks)})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def stored_state(spark: SparkSession) -> Iterator[None]:
    """The session with the store that Python processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run(rows: DataFrame, default: Any, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream of (key, ask, stamp, value) over all that is there; (key, ask, stamp, value) of changes and answers so far.

    A row whose ask is null writes value; stamps are texts in the order of
    writes. Given out and checkpoint of an earlier run, it goes on from there; a
    batch that is run again overwrites its own folder.
    """
    spark = rows.sparkSession
    out, checkpoint = out or shared_path(spark, "table"), checkpoint or shared_path(spark, "table-state")
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, ask {kinds['ask']}, stamp string, value {kinds['value']}"
    # as texts, values and asks pass through pandas unchanged, nulls among them or not
    texts = rows.select("key", F.col("ask").cast("string"), "stamp", F.col("value").cast("string"))
    processor = FirstWrite(None if default is None else str(default))
    found = texts.groupBy("key").transformWithStateInPandas(processor, f"key {kinds['key']}, ask string, stamp string, value string", "Update", "None")
    found = found.select("key", F.col("ask").cast(kinds["ask"]), "stamp", F.col("value").cast(kinds["value"]))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with stored_state(spark):
        query = found.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
        query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch int").parquet(out).select("key", "ask", "stamp", "value")


def written(rows: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """The same for a stream of writes alone (key, stamp, value): (key, ask, stamp, value) of the keys that each batch wrote to.

    Nothing is answered here, so the first write of a key is an aggregate, whose
    state Spark keeps itself: no key is handed to Python, as `run` does with each.
    """
    spark = rows.sparkSession
    out, checkpoint = out or shared_path(spark, "table"), checkpoint or shared_path(spark, "table-state")
    first = rows.groupBy("key").agg(F.min(F.struct("stamp", "value")).alias("first"))
    found = first.select("key", F.lit(None).cast("long").alias("ask"), "first.stamp", "first.value")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with stored_state(spark):
        query = found.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
        query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], found.schema)
    return spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in found.dtypes)}, batch int").parquet(out).select("key", "ask", "stamp", "value")


def table(changes: DataFrame) -> DataFrame:
    """(key, value): the table after the last batch."""
    return changes.filter("ask is null").groupBy("key").agg(F.min_by("value", "stamp").alias("value"))


def answers(changes: DataFrame) -> DataFrame:
    """(key, ask, value) of the lookups."""
    return changes.filter("ask is not null").select("key", "ask", "value")

"""Normalisation over a folder that log files are dropped into.

Rows are parsed, checked and routed as in a batch, except for what needs a whole file: units are given as
hints (percent by default). Repeated rows of a micro-batch count once. Each micro-batch is written to the store
under its number, so one that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize as N


def read_dropped(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """A stream of the text columns of delimited files with a header, as they are dropped into ``folder``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def append_batch(batch: DataFrame, aliases: DataFrame, hints: dict[str, float], folder: str, number: int) -> None:
    """Normalise one micro-batch and append its events, snapshots and rejected rows; doing it again replaces them."""
    rows = batch.withColumn("row_no", F.monotonically_increasing_id())
    valid, invalid = N.split_valid(N.parse(rows, aliases, {c: 1.0 for c in N.LEVELS} | hints))
    routed = N.route_rows(valid)
    for name, df in (("events", N.events_of(routed)), ("snapshots", N.snapshots_of(routed)), ("invalid", invalid)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def run(stream: DataFrame, aliases: DataFrame, folder: str, checkpoint: str, hints: dict[str, float] | None = None) -> StreamingQuery:
    """Start the stream over what is there now; it ends when that is done."""

    def each(batch: DataFrame, number: int) -> None:
        append_batch(batch.dropDuplicates(), aliases, hints or {}, folder, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

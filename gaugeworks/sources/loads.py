"""A store that grows by loads, with a manifest of what each load brought.

A load has a name and is written once: into its own partitions of every table, events also by date. Files of other
loads are never touched, and a load that the manifest has is left alone. A load that broke off has no entry: its rows are
not read, and doing it again overwrites its own partitions. The manifest keeps each load's rows and latest time, so the
reference time needs no event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TIMED = ("events", "snapshots")  # tables whose times make the reference time
MANIFEST = "load string, table string, n long, latest timestamp"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``load, table, n, latest`` of each table of each finished load; empty before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/loads")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/loads") if there else spark.createDataFrame([], MANIFEST)


def add_load(store: dict[str, DataFrame], folder: str, load: str) -> bool:
    """Write the tables of ``store`` as one load; False, and nothing changes, if it was loaded before."""
    spark = next(iter(store.values())).sparkSession
    if not manifest(spark, folder).filter(F.col("load") == load).isEmpty():
        return False
    rows = []
    for name, df in store.items():
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts") if name in TIMED else F.lit(None).cast("long")).alias("latest")).withColumn("load", F.lit(f"load {load}"))
        out = out.withColumn("event_date", F.to_date("ts")) if name == "events" else out
        by = ["event_date", "load"] if name == "events" else ["load"]
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")
        rows.append((load, name, seen.get["n"], seen.get["latest"]))
    entry = spark.createDataFrame(rows, "load string, table string, n long, us long").select("load", "table", "n", F.timestamp_micros("us").alias("latest"))
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/loads")
    return True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table from all finished loads, with ``load``; events keep ``event_date``."""
    done = manifest(spark, folder).filter(F.col("table") == name).select(F.concat(F.lit("load "), "load").alias("load"))
    rows = spark.read.parquet(f"{folder}/{name}").join(F.broadcast(done), "load", "left_semi")  # one row a load
    return rows.withColumn("load", F.substring("load", 6, 1_000_000))


def reference_time(spark: SparkSession, folder: str) -> DataFrame:
    """One row ``ref``: the latest time of any event or snapshot, from the manifest alone."""
    return manifest(spark, folder).agg(F.max("latest").alias("ref"))

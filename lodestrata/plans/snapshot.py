"""The whole planning state as JSON, out and in: one folder of JSON lines per table below one path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import upsert

# fixed values: the tables whose rows a snapshot puts in by key; the others it replaces
KEYED = {"decisions": ["id"], "tickets": ["record_id"]}


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table; nulls stay visible, so that columns without a value come back."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def import_snapshot(spark: SparkSession, path: str, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """stored with the snapshot taken in: rows of keyed tables by key, other tables as a whole.

    A row may name a parent that comes later: nothing is looked up while reading. A table the snapshot lacks stays as it is.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = {}
    for name, df in stored.items():
        at = fs.Path(f"{path}/{name}")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            out[name] = df
            continue
        came = spark.read.schema(df.schema).json(f"{path}/{name}")
        out[name] = upsert(df, came, KEYED[name]) if name in KEYED else came
    return out

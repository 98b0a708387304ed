"""Results out: JSON lines and arrays, chosen fields, one-line text, keyed upserts, atomic replacement."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chosen(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns in order, repeats dropped; an unknown name is an error that lists the valid ones."""
    wanted = list(dict.fromkeys(fields))
    bad = [f for f in wanted if f not in df.columns]
    if bad:
        raise ValueError(f"unknown field {bad[0]!r} (have: {', '.join(df.columns)})")
    return df.select(*(F.col(f"`{f}`") for f in wanted))


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object; nulls stay visible."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def one_line(df: DataFrame) -> DataFrame:
    """value: columns joined by tabs, reals with four decimals."""
    cols = [F.format_string("%.4f", F.bround(F.col(f"`{c}`"), 4)) if t in ("double", "float") else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    return df.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in cols)).alias("value"))


def render(df: DataFrame, limit: int, pretty: bool = False, lines: bool = False) -> str:
    """Text for a terminal of at most limit rows; the limit is part of the plan."""
    import json

    if pretty and lines:
        raise ValueError("pretty and lines exclude each other")
    rows = [r[0] for r in json_lines(df.limit(limit)).collect()]
    if lines:
        return "\n".join(rows)
    return json.dumps([json.loads(r) for r in rows], indent=2 if pretty else None, ensure_ascii=False)


def single(df: DataFrame, pretty: bool = False) -> str:
    """The one row of a result as a JSON object; no row is null, several are an error."""
    import json

    rows = [r[0] for r in json_lines(df.limit(2)).collect()]
    if len(rows) > 1:
        raise ValueError("more than one row")
    return json.dumps(json.loads(rows[0]) if rows else None, indent=2 if pretty else None, ensure_ascii=False)


def stream_text(df: DataFrame) -> Iterator[str]:
    """A one-column result's texts, a partition at a time; the driver never holds the whole."""
    return (r[0] for r in df.toLocalIterator())


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of changes put in by key; changes has one row per key."""
    return stored.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside path, then swap by renaming, so that a reader sees the old table or the new one."""
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new", f"{path}.old"
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(new)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)

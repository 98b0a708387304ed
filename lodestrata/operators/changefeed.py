"""Applying a stream of inserts, updates and deletes (problem 4).

A log-structured merge store: every batch of changes is appended as a run that holds the one version per key that can still
win, split into a fixed number of buckets by key hash and sorted by key within each. Reading brings the bucket's pieces of
all runs together in one task and merges them there, without a shuffle, and drops tombstones; once enough runs lie there,
compaction merges them into one in the same way. A version wins by (updated_at as text, sequence): a later change replaces the row unless
its updated_at is less, which is the same as taking the maximum of that pair, so runs may be merged in any grouping.

What belongs to the store is said by its manifest, a numbered file that appears whole or not at all: a run that was not
written to its end is in none, and a restart goes on from the last. Runs that a compaction replaces stay until the next
manifest but one, for readers that still use them.

Null keys name no row and are left out; a null updated_at sorts below all others; repeats change nothing; tombstones stay
in the runs until the last read, so that a revival or a stale upsert after a delete is judged rightly.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch

VERSION = "table_name string, row_key string, seq struct<updated_at:string,log_file:string,line_no:bigint>, deleted_at string, hash string, row_json string"
_KEY = ("table_name", "row_key")
ROWS_PER_BUCKET = 1_000_000


def newest(versions: DataFrame, *within: str) -> DataFrame:
    """One version per key (and `within`). Combines on the map side, so a hot key reaches the shuffle once per task."""
    best = F.max(F.struct("seq", F.coalesce("hash", F.lit("")).alias("_tie"), "deleted_at", "hash", "row_json"))
    return versions.groupBy(*within, *_KEY).agg(best.alias("v")).select(*within, *_KEY, "v.seq", "v.deleted_at", "v.hash", "v.row_json")


class Folder:
    """Small whole files below a path, on whatever file system the cluster uses."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._at(""))

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """The file under its name, whole; false if that name is taken."""
        stream = self.fs.create(self._at(f".{name}.part"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return not self.fs.exists(self._at(name)) and self.fs.rename(self._at(f".{name}.part"), self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class MergeStore:
    """Bucketed, sorted runs and their manifests below one folder that all executors share.

    One writer at a time: a second one's manifest is refused. buckets is fixed when the store is made; a store that is
    there already keeps its own. The runs are partitions of an external table in the session's catalogue, named after the
    path; its entry may be dropped at any time while no reader is open, as opening the store makes it anew.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 4, buckets: int = 8) -> None:
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        self._manifests, self._data = Folder(spark, f"{self.path}/manifests"), Folder(spark, f"{self.path}/data")
        held = [n for n in self._manifests.names() if n.endswith(".json") and not n.startswith(".")]
        state = json.loads(self._manifests.read(held[-1])) if held else {"number": 0, "buckets": buckets, "next": 0, "runs": [], "old": []}
        self._number, self.buckets, self._next, self.runs, self._old = (state[k] for k in ("number", "buckets", "next", "runs", "old"))
        self._table = f"merge_store_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table} ({VERSION}, run int) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (run) "
            f"CLUSTERED BY ({', '.join(_KEY)}) SORTED BY ({', '.join(_KEY)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )
        spark.sql(f"ALTER TABLE {self._table} RECOVER PARTITIONS")

    def append(self, versions: DataFrame) -> None:
        """Write one run; compacts when fan_in runs have come together."""
        self.append_batches(versions, F.lit(0), 1)

    def append_batches(self, versions: DataFrame, batch: Column, n: int) -> None:
        """Write a run for each value 0 to n - 1 of batch in a single pass over the changes."""
        first, self._next = self._next, self._next + n
        keyed = versions.where("table_name IS NOT NULL AND row_key IS NOT NULL")
        self._write(newest(keyed.withColumn("run", (batch + first).cast("int")), "run").repartition(self.buckets, *_KEY), range(first, self._next))
        self._commit([*self.runs, *range(first, self._next)])
        if len(self.runs) >= self.fan_in:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one. They leave the manifest once the new one is complete, the folder one generation later."""
        run, self._next = self._next, self._next + 1
        self._write(self.merged().withColumn("run", F.lit(run)), [run])
        self._commit([run])

    def merged(self) -> DataFrame:
        """The winning version of every key, tombstones included: buckets are merged where they lie, without an exchange."""
        return newest(self.spark.table(self._table).where(F.col("run").isin(self.runs)))

    def current(self) -> DataFrame:
        return self.merged().where("deleted_at IS NULL")

    def _write(self, versions: DataFrame, runs) -> None:  # noqa: ANN001
        for run in runs:
            self._data.delete(f"run={run}")  # left by a writer that did not get to its manifest
        versions.select(*_KEY, "seq", "deleted_at", "hash", "row_json", "run").write.insertInto(self._table)

    def _commit(self, runs: list[int]) -> None:
        out, gone = [r for r in self.runs if r not in runs], self._old
        state = {"number": self._number + 1, "buckets": self.buckets, "next": self._next, "runs": runs, "old": out}
        if not self._manifests.create(f"{state['number']:09d}.json", json.dumps(state)):
            raise RuntimeError(f"another writer changed the store {self.path}")
        self._number, self.runs, self._old = state["number"], runs, out
        for run in gone:
            self._data.delete(f"run={run}")
        if gone:
            self.spark.sql(f"ALTER TABLE {self._table} DROP IF EXISTS {', '.join(f'PARTITION (run = {r})' for r in gone)}")
        self._manifests.delete(f"{self._number - 2:09d}.json")


def _sequence(updated_at: Column, log_file: Column, line_no: Column) -> Column:
    return F.struct(F.coalesce(updated_at, F.lit("")).alias("updated_at"), F.coalesce(log_file, F.lit("")).alias("log_file"), F.coalesce(line_no, F.lit(0)).cast("bigint").alias("line_no"))


def log_versions(changelog: DataFrame) -> DataFrame:
    """Log lines as versions. row_key joins the values of key_columns by |; a missing value makes the key null."""
    row = F.from_json("row_json", "map<string,string>")
    cols = F.transform(F.split("key_columns", ","), lambda c: F.trim(c))
    parts = F.transform(cols, lambda c: F.col("_row")[c])
    key = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "|"))
    return (
        changelog.select("table_name", "key_columns", "row_json", "updated_at", "deleted_at", "hash", "log_file", "line_no", row.alias("_row"))
        .select("table_name", key.alias("row_key"), _sequence(F.col("updated_at"), F.col("log_file"), F.col("line_no")).alias("seq"), "deleted_at", "hash", "row_json")
        .where("table_name IS NOT NULL AND row_key IS NOT NULL")
    )


def ticket_versions(tickets: DataFrame) -> DataFrame:
    """The state before the log: every stored version of a ticket, older than any log line of the same updated_at."""
    fields = [c for c in ("record_id", "type", "parent_record_id", "title", "description", "status", "priority", "assigned_to", "team", "decision_ref", "created_at") if c in tickets.columns]
    return tickets.where("record_id IS NOT NULL").select(
        F.lit("tickets").alias("table_name"), F.col("record_id").alias("row_key"),
        _sequence(F.col("updated_at"), F.lit(None).cast("string"), F.lit(None).cast("bigint")).alias("seq"), "deleted_at", "hash", F.to_json(F.struct(*fields)).alias("row_json"),
    )


def rebuild(spark: SparkSession, tickets: DataFrame, changelog: DataFrame, batches: int = 4) -> MergeStore:
    """Base state as the first run, then the log in order of its files as `batches` runs, cut at quantiles of the file name.

    The cut is where the log would have been flushed; any cut gives the same state.
    """
    months = changelog.select(F.regexp_extract("log_file", r"(\d{4}-\d{2})", 1).alias("m")).groupBy("m").count().orderBy("m").collect()  # one row a month
    total, seen, cuts = sum(r["count"] for r in months), 0, []
    for r in months:
        seen += r["count"]
        if r["m"] and len(cuts) < batches - 1 and seen >= total * (len(cuts) + 1) / batches:
            cuts.append(r["m"])
    rows = total + tickets.count()
    buckets = max(-(-rows // ROWS_PER_BUCKET), min(spark.sparkContext.defaultParallelism, 1 + rows // 10_000))
    store = MergeStore(spark, scratch(spark, "merge-store"), buckets=buckets)
    store.append(ticket_versions(tickets))
    month = F.coalesce(F.regexp_extract("seq.log_file", r"(\d{4}-\d{2})", 1), F.lit(""))
    batch = F.lit(0)
    for k, low in enumerate(cuts):
        batch = F.when(month > low, k + 1).otherwise(batch)
    store.append_batches(log_versions(changelog), batch, len(cuts) + 1)
    return store


def current_rows(spark: SparkSession, tickets: DataFrame, changelog: DataFrame) -> DataFrame:
    """p4_found's columns."""
    return rebuild(spark, tickets, changelog).current().select("table_name", "row_key", "hash")


"""Session-level helpers: reading tables, cutting lineage, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) is a local temporary folder made.
    """
    sc = spark.sparkContext
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if wanted:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(wanted)
        return wanted
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably and cut lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Materialise as compressed columns below the shared folder, until the JVM ends.

    What is read has its files' size. A checkpoint keeps the size that its plan was guessed to have, and a join's guess is the
    product of its sides': where each round joins the last with itself, those numbers' digits double and fill the driver.
    """
    path = f"{scratch(df.sparkSession, 'stored')}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(fact: DataFrame, dim: DataFrame, on: str, salt_from: str, hot: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """salted_join where the hot keys are known: only their dimension rows are repeated. Null keys of fact are spread too."""
    salt = F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int")
    left = fact.withColumn("_salt", F.when(F.col(on).isNull() | F.col(on).isin(hot), salt).otherwise(0))
    if not hot:
        return left.join(dim.withColumn("_salt", F.lit(0)), [on, "_salt"], how).drop("_salt")
    right = dim.withColumn("_salt", F.explode(F.when(F.col(on).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def salted_join(fact: DataFrame, dim: DataFrame, on: list[str], salt_from: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join whose fact side may hold any share of its rows under one key.

    The fact side is spread by a hash of salt_from, the dimension side is repeated once per salt, so a hot key's rows
    are shared by up to `salts` tasks. The spread is a function of the row: a retried task gives the same rows.
    dim must be the smaller side (it is repeated) and how "inner", "left", "left_semi" or "left_anti".
    """
    left = fact.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")

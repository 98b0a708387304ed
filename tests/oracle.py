"""Compare registered queries with their SQL on DuckDB: python -m tests.oracle [sf] [name...]."""

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings files frontmatter links wide_spec decisions decision_refs tickets ticket_history changelog bench_items subjects subject_labels pack_specs".split()


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _norm(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf:
        if pd.api.types.is_float_dtype(pdf[c]):
            pdf[c] = pdf[c].round(6)
        pdf[c] = [None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else repr(v.item() if hasattr(v, "item") else v) for v in pdf[c]]
    return sorted(map(tuple, pdf.itertuples(index=False)), key=repr)


def difference(spark, name, d, query, sql, con=None):
    """None if rows, names and kinds agree and the plan multiplies no tables, else a short text."""
    df = query(spark, d)
    got, want = df.toPandas(), (con or connect(d)).execute(sql).df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return f"{bad} in the plan"
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype != want[c].dtype and len(got)}
    a, b = _norm(got), _norm(want)
    if a != b:
        only_a, only_b = [x for x in a if x not in b][:3], [x for x in b if x not in a][:3]
        return f"rows {len(a)} / {len(b)}; only here {only_a}; only there {only_b}; kinds {kinds}"
    return f"kinds {kinds}" if kinds else None


def main(sf, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/{sf}"
    con, q, o = connect(d), e.queries(), e.oracle_sql()
    bad = 0
    for n in names or q:
        t = time.time()
        try:
            said = difference(spark, n, d, q[n], o[n], con) if n in o else f"no SQL; {q[n](spark, d).count()} rows"
        except Exception as ex:  # noqa: BLE001
            said = f"FAILED {type(ex).__name__} {str(ex)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{n}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:])

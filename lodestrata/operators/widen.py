"""Attribute-value rows into wide tables (problem 6).

Cells are typed and encoded first, in generated code: a row survives only if its key is wanted and its value fills a cell.
Then combineByKey keeps one set of slot registers per entity: a register holds (spelling rank, cell), and merging two takes
the smaller, which is associative and commutative, so duplicates are resolved on the map side and an entity that holds a
third of all rows reaches the shuffle as one set of registers per task.

Null paths, keys or values fill nothing; an entity none of whose values fits still gets a row of empty cells. If several
spellings of one key fill a cell, the exact spelling wins, else the alphabetically first, then the smallest cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOOLS = ("true", "yes", "on"), ("false", "no", "off")


_BLANKS = " \t\n\x0b\f\r"


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def fold_key(c: Column) -> Column:
    return F.translate(F.lower(trimmed(c)), f"-{_BLANKS}", "_" * (1 + len(_BLANKS)))


def typed_cell(v: Column, text: Column, col_type: Column) -> Column:
    """The cell's text, or null where the value does not fit the type. v is the trimmed JSON, text what it holds if a scalar."""
    is_text, is_list, is_number = v.startswith('"'), v.startswith("["), v.rlike(r"^-?\d")
    number = F.when(is_number, text).when(is_text & trimmed(text).rlike(r"^[+-]?\d+(\.\d+)?$"), trimmed(text)).try_cast("double")
    low = F.lower(trimmed(text))
    flag = F.when(is_number, F.when(text.try_cast("double") == 1, "true").when(text.try_cast("double") == 0, "false")).when(
        is_text | v.isin("true", "false"), F.when(low.isin(*_BOOLS[0]), "true").when(low.isin(*_BOOLS[1]), "false")
    )
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ][\s\S]*)?$", 1)
    slashed = F.regexp_replace(F.regexp_extract(text, r"^(\d{4}/\d{2}/\d{2})$", 1), "/", "-")
    dotted = F.regexp_replace(F.regexp_extract(text, r"^(\d{2}\.\d{2}\.\d{4})$", 1), r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")
    day = F.when(is_text, F.concat(iso, slashed, dotted).try_cast("date").cast("string"))
    pieces = F.when(is_list, F.from_json(v, "array<string>")).when(is_text, F.split(text, r"[,;\s]+"))
    pieces = F.transform(F.array_compact(pieces), lambda p: trimmed(F.regexp_replace(trimmed(p), "^#", "")))
    listed = F.array_join(F.filter(pieces, lambda p: p != ""), ",")
    cell = (
        F.when(col_type == "number", F.format_string("%.3f", number))
        .when(col_type == "bool", flag).when(col_type == "date", day).when(col_type == "list", listed)
        .when((col_type == "string") & is_text, trimmed(text))
    )
    return F.when((col_type != "number") | number.isNotNull(), F.nullif(cell, F.lit("")))


def _empty(width: int) -> list:
    return [None] * width


def _merge_cell(regs: list, slot: int, rank: tuple) -> list:
    if rank[1] is not None and (regs[slot] is None or rank < regs[slot]):
        regs[slot] = rank
    return regs


def _merge_regs(a: list, b: list) -> list:
    return [y if x is None or (y is not None and y < x) else x for x, y in zip(a, b, strict=True)]


def wide_rows(frontmatter: DataFrame, wide_spec: DataFrame, every: bool = True, entities_per_task: int = 50_000) -> DataFrame:
    """path and one text column per wanted key, named by it; wide_spec is a fixed list of columns, read by the driver.

    Only wanted attributes go to Python. Entities without one are added from the distinct paths; every=False leaves them out.
    """
    spec = sorted((r["key_name"], r["col_type"]) for r in wide_spec.select("key_name", "col_type").distinct().collect() if r["key_name"])
    width, spark = len(spec), frontmatter.sparkSession
    slots = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(spec)], "_k string, _slot int, _type string")
    rows = frontmatter.where("path IS NOT NULL").select("path", "key", "value_json", fold_key(F.col("key")).alias("_k"))
    cells = rows.join(F.broadcast(slots), "_k")  # as many rows as the table has columns
    # each step is a projection of its own, so that a value is trimmed and read once however often its cell looks at it
    cells = cells.select("path", "key", "_k", "_slot", "_type", trimmed(F.col("value_json")).alias("_v"))
    cells = cells.withColumn("_text", F.get_json_object(F.concat(F.lit('{"v":'), "_v", F.lit("}")), "$.v"))
    # values that fit no cell are passed over in the registers: a filter here would be pushed below and type every value twice
    cells = cells.select("path", "key", "_k", "_slot", typed_cell(F.col("_v"), F.col("_text"), F.col("_type")).alias("cell"))
    spelled = F.when(F.col("key") == F.col("_k"), "").otherwise(F.col("key"))  # the exact spelling first
    pairs = cells.select("path", "_slot", spelled.alias("spelled"), "cell").rdd.map(lambda r: (r[0], (r[1], (r[2], r[3]))))
    # an RDD's shuffle isn't sized at run time, so the number of entities decides
    entities = frontmatter.agg(F.approx_count_distinct("path")).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-entities // entities_per_task))
    regs = pairs.combineByKey(
        lambda c: _merge_cell(_empty(width), *c),
        lambda acc, c: _merge_cell(acc, *c),
        _merge_regs,
        numPartitions=parts,
    )
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(k, T.StringType()) for k, _ in spec)])
    filled = spark.createDataFrame(regs.map(lambda kv: (kv[0], *(None if x is None else x[1] for x in kv[1]))), schema, verifySchema=False)
    return frontmatter.where("path IS NOT NULL").select("path").distinct().join(filled, "path", "left") if every else filled


def typed_wide(wide: DataFrame, wide_spec: DataFrame) -> DataFrame:
    """The same rows with typed columns: double, boolean, date, array<string>, string."""
    spec = sorted((r["key_name"], r["col_type"]) for r in wide_spec.select("key_name", "col_type").distinct().collect() if r["key_name"])
    cast = {"number": lambda c: c.cast("double"), "bool": lambda c: c.cast("boolean"), "date": lambda c: c.cast("date"), "list": lambda c: F.split(c, ","), "string": lambda c: c}
    return wide.select("path", *(cast[t](F.col(f"`{k}`")).alias(k) for k, t in spec))


def filled_cells(wide: DataFrame) -> DataFrame:
    """p6_found's columns: one row per filled cell."""
    keys = [c for c in wide.columns if c != "path"]
    if not keys:
        return wide.select("path", F.lit("").alias("key_name"), F.lit("").alias("cell")).limit(0)
    pairs = F.array(*(F.struct(F.lit(k).alias("key_name"), F.col(f"`{k}`").alias("cell")) for k in keys))
    return wide.select("path", F.explode(F.filter(pairs, lambda p: p["cell"].isNotNull())).alias("p")).select("path", "p.key_name", "p.cell")

"""The relations a vault consists of, and how the driver's tables fill them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

FILE_COLUMNS = ("path", "mtime", "ctime", "size", "content_hash", "last_scanned")
FILES = "path string, mtime long, ctime long, size long, content_hash string, last_scanned long"
FRONTMATTER = "path string, key string, type string, value_json string, value_text string, value_num double"
TAGS = "path string, tag string"
LINKS = "source_path string, target_path string, alias string, link_type string, line int"
HEADINGS = "path string, depth int, text string, line_offset int"


@dataclass(frozen=True)
class Vault:
    files: DataFrame
    frontmatter: DataFrame
    tags: DataFrame
    links: DataFrame
    headings: DataFrame


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """Text before the last slash, '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def note_name(path: Column, any_case: bool) -> Column:
    """The last part without .md; the query language strips .MD too, the named queries don't."""
    return F.regexp_replace(base_name(path), r"(?i)\.md$" if any_case else r"\.md$", "")


def frontmatter_tags(frontmatter: DataFrame) -> DataFrame:
    """path, tag from the keys tags and tag: lists, or strings split at blanks, commas and semicolons; one leading # stripped; a set per note."""
    v = F.col("value_json")
    text = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    items = F.when(F.col("type") == "list", F.from_json(v, "array<string>")).when(F.col("type") == "string", F.split(text, r"[ ,;]+"))
    rows = frontmatter.where(F.col("key").isin("tags", "tag")).select("path", F.explode(items).alias("tag"))
    return rows.select("path", F.regexp_replace(F.trim("tag"), "^#", "").alias("tag")).where("tag <> ''").distinct()


def vault(spark: SparkSession, sf_dir: str) -> Vault:
    """The driver's vault tables, exact repeats of rows removed where the relation is a set.

    They hold no note bodies: tags come from frontmatter (the keys tags, tag and area, so that there are enough of them),
    and a link's anchor stands for a heading of the linking note.
    """
    files = table(spark, sf_dir, "files").distinct()
    fm = table(spark, sf_dir, "frontmatter").distinct()
    links = table(spark, sf_dir, "links")
    keyed = fm.withColumn("key", F.when(F.col("key") == "area", "tags").otherwise(F.col("key")))
    anchor = F.substring_index("target_path", "#", -1)
    headings = links.where("instr(target_path, '#') > 0").select(F.col("source_path").alias("path"), F.lit(2).alias("depth"), anchor.alias("text"), F.col("line").alias("line_offset"))
    return Vault(files, fm, frontmatter_tags(keyed), links, headings)

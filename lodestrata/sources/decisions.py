"""Decision records in markdown: a heading `### D-12: title` opens one, a line of three dashes closes it.

All in generated code: a note is split before its headings, each piece is a record, and fields and references are read off
the piece. Lines end at a line feed; a carriage return before it counts as a blank. Null texts, texts without a
heading and notes named README.md have no records; an id that occurs twice gives two records.

Status: rejected records and decisions are active, questions open; a `Superseded by` field makes any but a rejected one
superseded; a question's first `Status` field resolves it if it begins with "resolved" and says neither "partial" nor
"remaining". References carry the type of the field that begins their line; own ids and tickets are none, and of equal
target and type the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_B = r"[^\S\n]"  # a blank within a line
_HEAD = rf"###{_B}+([DQR]-[0-9]+):{_B}+"
_CLOSE = rf"(?md)^{_B}*---{_B}*$[\s\S]*"
_ID = r"(?<![A-Za-z0-9_])([DQR]-[0-9]+)(?![A-Za-z0-9_])"
# fixed values: what a prefix means, in which folder its records belong, the fields that type a reference, a note's longest length
KINDS = {"D": "confirmed", "Q": "question", "R": "rejected"}
FOLDERS = {"decisions": "confirmed", "questions": "question", "rejected": "rejected"}
REF_FIELDS = (("Supersedes:", "supersedes"), (r"Superseded\s+by:", "references"), ("Resolves:", "resolves"), (r"Depends\s+on:", "depends_on"))
NOTE_BYTES = 200


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _field(name: str, value: str) -> str:
    """Pattern of the first field line of that name; value is its one group."""
    return rf"(?md)^{_B}*-{_B}+\*\*{name}:\*\*{_B}+{value}"


def _pick(c: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _pieces(notes: DataFrame) -> DataFrame:
    """path, ordinal, id, title, body of every record."""
    parts = F.posexplode(F.filter(F.split("content", rf"(?md)^(?={_HEAD}.)"), lambda b: b.rlike(rf"(?d)\A{_HEAD}."))).alias("ordinal", "piece")
    body = F.regexp_replace(F.regexp_replace("piece", r"\A[^\n]*(?:\n|\z)", ""), _CLOSE, "")
    named = notes.where("content IS NOT NULL").where(~F.coalesce(F.lower(F.regexp_extract("path", "[^/]*$", 0)), F.lit("")).eqNullSafe("readme.md"))
    return named.select("path", parts).select(
        "path", "ordinal", F.regexp_extract("piece", rf"\A{_HEAD}", 1).alias("id"), _trim(F.regexp_extract("piece", rf"(?d)\A{_HEAD}(.+)", 2)).alias("title"), body.alias("body"),
    )


def _ref_type(line: Column) -> Column:
    out = F.when(line.rlike(r"(?i)^\s*\*\*Amendment\s*\("), "amends").otherwise("references")
    for name, kind in reversed(REF_FIELDS):
        out = F.when(line.rlike(rf"(?i)^\s*-\s+\*\*{name}\*\*"), kind).otherwise(out)
    return out


def _clipped(line: Column) -> Column:
    """The line without its list mark, at most NOTE_BYTES bytes, never ending within a character."""
    text = F.regexp_replace(_trim(line), "^[- ]+", "")
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, NOTE_BYTES - 3).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) > NOTE_BYTES, F.concat(head, F.lit("..."))).otherwise(text)


def _mentions(pieces: DataFrame) -> DataFrame:
    """path, ordinal, id, target, ref_type, note: distinct by target and type, the first line's note."""
    line = F.posexplode(F.split("body", "\n")).alias("n", "line")
    rows = pieces.where(F.col("body").rlike(_ID)).select("path", "ordinal", "id", line).where(F.col("line").rlike(_ID))
    rows = rows.select("path", "ordinal", "id", "n", "line", F.explode(F.regexp_extract_all("line", F.lit(_ID), 1)).alias("target")).where("target <> id")
    typed = rows.select("path", "ordinal", "id", "target", "n", _ref_type(F.col("line")).alias("ref_type"), _clipped(F.col("line")).alias("note"))
    return typed.groupBy("path", "ordinal", "id", "target", "ref_type").agg(F.min_by("note", "n").alias("note"))


def decision_records(notes: DataFrame) -> DataFrame:
    """path, ordinal, id, type, domain, title, status, date (or null), body of the records of notes (path, content)."""
    p = _pieces(notes)
    kind = _pick(F.substring("id", 1, 1), KINDS)
    said = F.lower(_trim(F.regexp_extract("body", _field("Status", "(.+)"), 1)))
    settled = said.startswith("resolved") & ~F.contains(said, F.lit("partial")) & ~F.contains(said, F.lit("remaining"))
    over = F.col("body").rlike(rf"(?mid)^{_B}*-{_B}+\*\*Superseded{_B}+by:\*\*")
    status = F.when(kind == "rejected", "active").when(over, "superseded").when(kind == "confirmed", "active").when(settled, "resolved").otherwise("open")
    date = F.nullif(F.regexp_extract("body", _field("(?:Date|Rejected)", "([0-9]{4}-[0-9]{2}-[0-9]{2})"), 1), F.lit(""))
    domain = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", ""), "^questions-", "")
    plain = F.regexp_replace("body", rf"(?md)^{_B}*-{_B}+\*\*(?:Status:\*\*{_B}+.|(?:Date|Rejected):\*\*{_B}+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}).*$\n?", "")
    return p.select("path", "ordinal", "id", kind.alias("type"), domain.alias("domain"), "title", status.alias("status"), date.alias("date"), _trim(plain).alias("body"))


def decision_references(notes: DataFrame) -> DataFrame:
    """path, id, target, ref_type, note of every record's references."""
    return _mentions(_pieces(notes)).drop("ordinal")


def violations(notes: DataFrame) -> DataFrame:
    """severity, problem, subject, other. Errors: duplicate_id (in several notes), empty_title, broken_ref (no record has the id).

    Warnings: filename_style (not lower case with hyphens), wrong_folder (a record's type and its note's folder disagree),
    unpaired (a note of questions without one of decisions by its name), shared_prefix (two names of a folder, one beginning
    the other; found by an equi-join on the names' beginnings).
    """
    pieces = _pieces(notes)
    recs = pieces.select("path", "id", "title", _pick(F.substring("id", 1, 1), KINDS).alias("type"))
    row = lambda df, severity, problem, subject, other: df.select(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), F.col(subject).alias("subject"), (F.col(other) if other else F.lit("")).alias("other")).distinct()
    twice = recs.groupBy("id").agg(F.count_distinct("path").alias("n")).where("n > 1")
    broken = _mentions(pieces).select("id", "target").distinct().join(recs.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
    paths = notes.select("path").where("path IS NOT NULL").distinct().select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"))
    paths = paths.where(F.lower("file") != "readme.md")
    stems = paths.where(F.col("folder").isin(*FOLDERS)).select("path", "folder", F.regexp_replace("file", r"\.md$", "").alias("stem"))
    wrong = recs.join(paths.select("path", _pick(F.col("folder"), FOLDERS).alias("wanted")), "path").where("type <> wanted")
    alone = stems.where("folder = 'questions'").join(stems.where("folder = 'decisions'").select("stem"), "stem", "left_anti")
    begins = stems.select("folder", F.col("path").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("stem") - 1, F.lit(1))), lambda i: F.substring("stem", F.lit(1), i))).alias("stem"))
    shared = begins.join(stems, ["folder", "stem"]).where("path <> longer")
    out = row(twice, "error", "duplicate_id", "id", None)
    for part in (
        row(recs.where("title = ''"), "error", "empty_title", "id", None), row(broken, "error", "broken_ref", "id", "target"),
        row(paths.where(~F.col("file").rlike(r"\A[a-z][a-z0-9-]*\.md\z")), "warning", "filename_style", "path", None), row(wrong, "warning", "wrong_folder", "path", "id"),
        row(alone, "warning", "unpaired", "path", None), row(shared, "warning", "shared_prefix", "path", "longer"),
    ):
        out = out.unionByName(part)
    return out


def sync(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """id, action (new, changed, unchanged, pruned) of parsed records against stored ones (both id, hash; one row per id)."""
    a, b = stored.select("id", F.col("hash").alias("_a"), F.lit(True).alias("_s")), parsed.select("id", F.col("hash").alias("_b"), F.lit(True).alias("_p"))
    action = F.when(F.col("_p").isNull(), "pruned").when(F.col("_s").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, "id", "full").select("id", action.alias("action"))

"""Planning timestamps are text; these expressions read and write them without the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def utc_millis(c: Column) -> Column:
    """Milliseconds since the epoch; no zone means UTC; null where the text is no timestamp.

    A zone is a final Z or +hh:mm; texts without one get a Z, so the cast never looks at the session's zone.
    """
    text = F.trim(c)
    zoned = F.upper(F.substring(text, -1, 1)).isin("Z") | ((F.length(text) > 16) & F.substring(text, -6, 1).isin("+", "-"))
    return F.unix_millis(F.when(zoned, text).when(F.length(text) > 10, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit(" 00:00:00Z"))).try_cast("timestamp"))


def millis_text(ms: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss.SSS in UTC."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.floor(ms / DAY_MS).cast("int")
    rest = F.pmod(ms, F.lit(DAY_MS))
    sec = F.floor(rest / 1000)
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit(" "),
        two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60),
        F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"),
    )


def epoch_month(seconds: Column) -> Column:
    """yyyy-MM in UTC of unix seconds."""
    return F.substring(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string"), 1, 7)


def fold_id(c: Column) -> Column:
    """Ids compare without regard to case and surrounding blanks."""
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))

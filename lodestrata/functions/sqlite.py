"""SQLite's scalar semantics as Spark expressions: what differs from Spark's own functions, and nothing else."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAY_MS = 86_400_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def like(c: Column, pattern: Column) -> Column:
    """ASCII case-insensitive LIKE with % and _ and no escape character."""
    escaped = F.replace(lower_ascii(pattern), F.lit("\\"), F.lit("\\\\"))
    return F.like(lower_ascii(c), escaped)


def glob_column(pattern: Column) -> Column:
    """glob_regex for patterns that rows bring along; a class without an end is not told apart from plain text."""
    x = F.regexp_replace(pattern, r"([\\.+(){}|$])", r"\\$1")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<!\[)\^", r"\\^"), r"\[(?![^\]]*\])", r"\\[")
    return F.concat(F.lit(r"(?s)\A(?:"), F.regexp_replace(F.regexp_replace(x, r"\*", ".*"), r"\?", "."), F.lit(r")\z"))


def glob_regex(pattern: str) -> str:
    """Anchored regex of a GLOB: * and ? cross slashes, [..] and [^..] are classes, a lone [ matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0:
                return r"(?!)"
            body = pattern[i + 1 : end]
            negate = body.startswith("^")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[1:] if negate else body)
            out.append(f"[{'^' if negate else ''}{body}]")
            i = end
        else:
            out.append(re.escape(ch) if ch.isascii() else ch)
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def numeric_prefix(c: Column) -> Column:
    """A text's leading number as double, 0 where there is none: how text enters arithmetic."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.when(c.isNotNull(), F.lit(0.0)))


def substr(c: Column, start: Column, length: Column | None = None) -> Column:
    """1-based; a negative start counts from the end, start 0 eats one of the length, a negative length takes what is before."""
    n = F.char_length(c)
    begin = F.when(start > 0, start - 1).when(start < 0, n + start).otherwise(F.lit(-1))
    if length is None:
        a, b = begin, n
    else:
        a = F.when(length >= 0, begin).otherwise(F.when(start == 0, F.lit(0) + length).otherwise(begin + length))
        b = F.when(length >= 0, begin + length).otherwise(F.when(start == 0, F.lit(0)).otherwise(begin))
    a, b = F.greatest(a, F.lit(0)), F.least(F.greatest(b, F.lit(0)), n)
    known = c.isNotNull() & start.isNotNull() & (F.lit(True) if length is None else length.isNotNull())
    return F.when(known, F.substring(c, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))


def divide_int(a: Column, b: Column) -> Column:
    """Truncates toward zero; null by zero."""
    return F.when(b != 0, ((a - a % F.nullif(b, F.lit(0))) / F.nullif(b, F.lit(0))).cast("bigint"))


def divide_real(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    """Both sides become integers first; null by zero."""
    return F.when(b.cast("bigint") != 0, a.cast("bigint") % F.nullif(b.cast("bigint"), F.lit(0)))


def least_null(*cs: Column) -> Column:
    return F.when(~_any_null(cs), F.least(*cs))


def greatest_null(*cs: Column) -> Column:
    return F.when(~_any_null(cs), F.greatest(*cs))


def _any_null(cs: tuple[Column, ...]) -> Column:
    out = cs[0].isNull()
    for c in cs[1:]:
        out = out | c.isNull()
    return out


# --- tagged values: one column whose rows are numbers or texts ------------------------------------------------------


def tag_number(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(F.lit(1).alias("rank"), c.cast("double").alias("num"), F.lit("").alias("str")))


def tag_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(F.lit(2).alias("rank"), F.lit(0.0).alias("num"), c.cast("string").alias("str")))


def tag_text_numeric(c: Column) -> Column:
    """Text beside a numeric column: a number if it reads as one."""
    n = F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))
    return F.when(n.isNotNull(), tag_number(n)).otherwise(tag_text(c))


def number_text(c: Column) -> Column:
    """A real as SQLite prints it, shortened: integers keep .0."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def tagged_text(c: Column) -> Column:
    return F.when(c["rank"] == 1, number_text(c["num"])).otherwise(c["str"])


# --- dates ---------------------------------------------------------------------------------------------------------

_TIME = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ]+(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?\s*(?:Z|([+-])(\d{2}):(\d{2}))?\s*$"


def time_value(c: Column) -> Column:
    """Milliseconds since 1970 of a text time value; null if invalid."""
    part = lambda g: F.nullif(F.regexp_extract(c, _TIME, g), F.lit(""))
    num = lambda g: F.coalesce(part(g).try_cast("bigint"), F.lit(0))
    y, m, d = (F.substring(part(1), a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    valid = (m.between(1, 12)) & (d.between(1, 31)) & (num(2) < 24) & (num(3) < 60) & (num(4) < 60)
    day = F.unix_date(F.make_date(y, F.when(valid, m), F.lit(1))).cast("bigint") + d - 1
    frac = F.coalesce(F.round(part(5).try_cast("double") * 1000).cast("bigint"), F.lit(0))
    zone = (num(7) * 60 + num(8)) * F.when(part(6) == "-", -1).otherwise(1) * 60_000
    return F.when(valid, day * DAY_MS + (num(2) * 3600 + num(3) * 60 + num(4)) * 1000 + frac - zone)


def from_julian(c: Column) -> Column:
    return F.round((c.cast("double") - 2440587.5) * DAY_MS).cast("bigint")


def _ymd(ms: Column) -> tuple[Column, Column, Column, Column]:
    day = F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))
    return F.year(day), F.month(day), F.dayofmonth(day), F.pmod(ms, F.lit(DAY_MS))


def _from_ymd(y: Column, m: Column, d: Column, rest: Column) -> Column:
    """Months beyond the year roll over; so do days beyond the month."""
    y2, m2 = y + F.floor((m - 1) / 12).cast("int"), F.pmod(m - 1, F.lit(12)).cast("int") + 1
    return (F.unix_date(F.make_date(y2, m2, F.lit(1))).cast("bigint") + d - 1) * DAY_MS + rest


_SHIFT = re.compile(r"^([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?$")


def modify(ms: Column, modifier: str) -> Column | None:
    """One modifier applied; None if it isn't supported."""
    mod = modifier.strip().lower()
    if m := _SHIFT.match(mod):
        amount, unit = float(m[1]), m[2]
        if unit in ("month", "year"):
            if amount != int(amount):
                return None
            y, mo, d, rest = _ymd(ms)
            return _from_ymd(y, mo + int(amount), d, rest) if unit == "month" else _from_ymd(y + int(amount), mo, d, rest)
        scale = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}[unit]
        return ms + F.lit(round(amount * scale))
    if mod == "start of day":
        return ms - F.pmod(ms, F.lit(DAY_MS))
    if mod in ("start of month", "start of year"):
        y, mo, _, _ = _ymd(ms)
        return _from_ymd(y, mo if mod.endswith("month") else F.lit(1), F.lit(1), F.lit(0))
    if m := re.match(r"^weekday ([0-6])$", mod):
        day = F.pmod(F.floor(ms / DAY_MS) + 4, F.lit(7))
        return ms + F.pmod(F.lit(int(m[1])) - day, F.lit(7)) * DAY_MS
    if mod in ("utc", "subsec"):
        return ms
    return None


def _two(c: Column) -> Column:
    return F.lpad(c.cast("int").cast("string"), 2, "0")


def date_text(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int")).cast("string")


def time_text(ms: Column) -> Column:
    s = F.floor(F.pmod(ms, F.lit(DAY_MS)) / 1000)
    return F.concat(_two(F.floor(s / 3600)), F.lit(":"), _two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60))


def julian(ms: Column) -> Column:
    return ms.cast("double") / DAY_MS + 2440587.5


def strftime(fmt: str, ms: Column) -> Column | None:
    y, mo, d, rest = _ymd(ms)
    s = F.floor(rest / 1000)
    day = F.floor(ms / DAY_MS)
    doy = F.dayofyear(F.date_from_unix_date(day.cast("int")))
    parts = {
        "Y": F.lpad(y.cast("string"), 4, "0"), "m": _two(mo), "d": _two(d), "H": _two(F.floor(s / 3600)), "M": _two(F.floor(s / 60) % 60), "S": _two(s % 60),
        "f": F.concat(_two(s % 60), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0")), "j": F.lpad(doy.cast("string"), 3, "0"),
        "s": F.floor(ms / 1000).cast("bigint").cast("string"), "w": F.pmod(day + 4, F.lit(7)).cast("int").cast("string"), "J": julian(ms).cast("string"),
        "F": date_text(ms), "T": time_text(ms), "R": F.substring(time_text(ms), 1, 5), "%": F.lit("%"),
    }
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            got = parts.get(fmt[i + 1 : i + 2])
            if got is None:
                return None
            out.append(got)
            i += 2
        else:
            out.append(F.lit(fmt[i]))
            i += 1
    return F.concat(*out) if out else F.lit("")


def printf(fmt: str, args: list[tuple[Column, str]]) -> Column | None:
    """%d %i %s %f %x %X %c %% with flags, width and precision; None for others. args: (column, kind)."""
    spec = re.compile(r"%([-+ 0,]*)(\d*)((?:\.\d+)?)([a-zA-Z%])")
    out, used, java = [], 0, ""
    for i, m in enumerate(re.split(r"(%[-+ 0,]*\d*(?:\.\d+)?[a-zA-Z%])", fmt)):
        if i % 2 == 0:
            java += m.replace("%", "%%")
            continue
        flags, width, precision, conv = spec.match(m).groups()
        if conv == "%":
            java += "%%"
            continue
        if conv not in "dsifxXc":
            return None
        c, kind = args[used] if used < len(args) else (F.lit(None).cast("string"), "null")
        used += 1
        number = numeric_prefix(c.cast("string")) if kind == "text" else c.cast("double")
        if conv in "di":
            java += f"%{flags}{width}d"
            out.append(F.coalesce(number.cast("bigint"), F.lit(0)))
        elif conv in "xX":
            java += f"%{flags}{width}{conv}"
            out.append(F.coalesce(number.cast("bigint"), F.lit(0)))
        elif conv == "f":
            java += f"%{flags}{width}{precision or '.6'}f"
            out.append(F.coalesce(number, F.lit(0.0)))
        else:
            java += f"%{'-' if '-' in flags else ''}{width}{precision if conv == 's' else ''}s"
            text = F.coalesce(c.cast("string"), F.lit(""))
            out.append(F.substring(text, 1, 1) if conv == "c" else text)
    return F.format_string(java, *out) if out else F.lit(java.replace("%%", "%"))

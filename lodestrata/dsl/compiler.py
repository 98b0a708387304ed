"""Syntax tree to a DataFrame plan over a vault.

Every expression is typed statically as int, real, text, null or tagged; tagged is a struct (rank, number, text) whose
ordinary ordering is that of dynamically typed values: null < numbers < texts. Only expressions that touch frontmatter, or
that compare a number with a text, are tagged, so plain columns stay plain and their filters reach the scan.

Membership in tags, links or headings becomes a left join with the relation's distinct pairs and a mark, which serves under
OR, NOT and in projections alike and gathers nothing per note. Frontmatter keys of a query are pivoted in one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError
from ..functions import sqlite as sq
from ..plans import links as link_plans
from ..vault import FILE_COLUMNS, Vault, folder_of, note_name
from .parser import Node, Query, parse

_NUMERIC = ("mtime", "ctime", "size", "last_scanned")
_ARRAYS = ("tags", "outlinks", "inlinks", "headings")


@dataclass
class Expr:
    col: Column
    kind: str  # int, real, text, null, tagged
    stored: str | None = None  # 'number' or 'text' if a stored column: it lends its affinity
    shown: Column | None = None  # what a projection prints, if not col itself

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "real")


class Compiler:
    def __init__(self, vault: Vault, now: datetime | None = None, extended: bool = False) -> None:
        self.vault, self.extended = vault, extended
        self.now = now or datetime.now(timezone.utc)
        self.fm: dict[str, str] = {}
        self.marks: list[tuple[str, Column, DataFrame]] = []
        self.aggregated: dict[int, Expr] = {}  # by node

    # -- the query

    def plan(self, q: Query) -> DataFrame:
        if q.source and q.source.value[0] != "files":
            raise EvalError("unsupported_from", f"no table {q.source.value[0]!r}", q.source.line, q.source.col)
        found = [a for n, _ in q.select for a in aggregates(n)]
        if found:
            return self._cut(self._aggregate(q, found), q)
        if q.star:
            outs = [(c, F.col(c)) for c in FILE_COLUMNS]
        else:
            outs = []
            for node, alias in q.select:
                e = self.expr(node)
                outs.append((alias or self._name(node), self._printed(e)))
        named = dict(outs)  # a repeated name keeps its last column
        where = self.truth(self.expr(q.where)) if q.where else None
        keys = [(self.expr(n), down, nulls) for n, down, nulls in q.order]
        df = self._source()
        if where is not None:
            df = df.where(where)
        sort = [(e.col, down, nulls) for e, down, nulls in keys]
        df = df.select(*(c.alias(f"_o{i}") for i, c in enumerate(named.values())), *(c.alias(f"_s{i}") for i, (c, _, _) in enumerate(sort)))
        if q.distinct:
            df = df.groupBy(*(f"_o{i}" for i in range(len(named)))).agg(*(F.min(f"_s{i}").alias(f"_s{i}") for i in range(len(sort)))) if sort else df.distinct()
        if sort:
            df = df.orderBy(*(self._direction(F.col(f"_s{i}"), down, nulls) for i, (_, down, nulls) in enumerate(sort)))
        return self._cut(df, q).select(*(F.col(f"_o{i}").alias(n) for i, n in enumerate(named)))

    @staticmethod
    def _cut(df: DataFrame, q: Query) -> DataFrame:
        """OFFSET and LIMIT; what lies beyond any plan's count is no bound, or leaves nothing."""
        most = 2**31 - 1
        if q.offset:
            df = df.offset(q.offset) if q.offset <= most else df.limit(0)
        return df if q.limit is None or q.limit > most else df.limit(q.limit)

    @staticmethod
    def _direction(c: Column, down: bool, nulls: str | None) -> Column:
        first = nulls == "FIRST" if nulls else not down
        if down:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    def _source(self) -> DataFrame:
        df = self.vault.files
        if self.fm:
            v = F.struct("type", "value_json", "value_text", "value_num")
            keys = list(self.fm)
            wide = (
                self.vault.frontmatter.where(F.col("key").isin(keys)).groupBy("path")
                .agg(*(F.max(F.when(F.col("key") == k, v)).alias(c) for k, c in self.fm.items()))
            )
            df = df.join(wide, "path", "left")
        for mark, probe, pairs in self.marks:
            left = df.withColumn(f"{mark}_v", probe)
            df = left.join(pairs.select(F.col("path"), F.col("member").alias(f"{mark}_v"), F.lit(True).alias(mark)), ["path", f"{mark}_v"], "left")
        return df

    def _aggregate(self, q: Query, found: list[Node]) -> DataFrame:
        """min or max of one argument, anywhere in the select list, makes the whole query one row, which needs no order.

        What stands outside the aggregates is computed afterwards, over the row that holds the first one's value.
        """
        sums = []
        for i, n in enumerate(found):
            e = self.expr(n.args[0])
            lowest = str(n.value).lower() == "min"
            sums.append((F.min if lowest else F.max)(e.col).alias(f"_g{i}"))
            self.aggregated[id(n)] = Expr(F.col(f"_g{i}"), e.kind)
            if not i:
                holder = (F.min_by if lowest else F.max_by, e.col)
        outs = dict((alias or self._name(node), self._printed(self.expr(node))) for node, alias in q.select)
        where = self.truth(self.expr(q.where)) if q.where else None
        df = self._source()
        df = df if where is None else df.where(where)
        if not any(bare(n) for n, _ in q.select):
            return df.agg(*sums).select(*(c.alias(n) for n, c in outs.items()))
        row = holder[0](F.struct(*(F.col(f"`{c}`") for c in df.columns)), holder[1]).alias("_row")
        return df.agg(row, *sums).select("_row.*", *(f"_g{i}" for i in range(len(found)))).select(*(c.alias(n) for n, c in outs.items()))

    @staticmethod
    def _printed(e: Expr) -> Column:
        if e.shown is not None:
            return e.shown
        return sq.tagged_text(e.col) if e.kind == "tagged" else e.col

    def _name(self, n: Node) -> str:
        if n.kind == "ref":
            return ".".join(n.value)
        if n.kind == "call":
            return str(n.value)
        return unparse(n)

    # -- expressions

    def expr(self, n: Node) -> Expr:
        if id(n) in self.aggregated:
            return self.aggregated[id(n)]
        return getattr(self, f"_{n.kind}")(n)

    def _literal(self, n: Node) -> Expr:
        kind = n.args[0]
        if kind == "null":
            return Expr(F.lit(None).cast("string"), "null")
        return Expr(F.lit(n.value).cast({"int": "bigint", "real": "double", "text": "string"}[kind]), kind)

    def _tuple(self, n: Node) -> Expr:
        raise EvalError("unknown_expr", "a list stands only after IN", n.line, n.col)

    def _ref(self, n: Node) -> Expr:
        parts = n.value
        if parts[0] == "fm":
            if len(parts) == 1:
                raise EvalError("bare_fm", "fm needs a key", n.line, n.col)
            if len(parts) > 2:
                raise EvalError("bad_fm_access", "fm takes one key", n.line, n.col)
            return self._frontmatter(parts[1])
        if len(parts) > 1:
            raise EvalError("unsupported_ref", ".".join(parts), n.line, n.col)
        name = parts[0]
        if name in _ARRAYS or name == "body":
            raise EvalError("bare_array_ref", f"{name} stands only after IN", n.line, n.col)
        if name in FILE_COLUMNS:
            return Expr(F.col(name), "int" if name in _NUMERIC else "text", "number" if name in _NUMERIC else "text")
        if name == "name":
            return Expr(note_name(F.col("path"), any_case=True), "text")
        if name == "folder":
            return Expr(folder_of(F.col("path")), "text")
        raise EvalError("unknown_column", name, n.line, n.col)

    def _frontmatter(self, key: str) -> Expr:
        c = F.col(self.fm.setdefault(key, f"_fm{len(self.fm)}"))
        number = c["type"].isin("number", "bool")
        value = F.when(number, sq.tag_number(c["value_num"])).when(c["type"] == "string", sq.tag_text(c["value_text"])).otherwise(sq.tag_text(c["value_json"]))
        shown = F.when(c["type"] == "number", sq.number_text(c["value_num"])).when(c["type"] == "string", c["value_text"]).otherwise(c["value_json"])
        return Expr(value, "tagged", shown=shown)

    def _unary(self, n: Node) -> Expr:
        e = self.expr(n.args[0])
        if n.value == "NOT":
            return Expr((~self.truth(e)).cast("bigint"), "int")
        if n.value == "+":
            return e
        e = self.number(e)
        return Expr(-e.col, e.kind)

    def _binary(self, n: Node) -> Expr:
        if n.value in ("AND", "OR"):
            a, b = (self.truth(self.expr(x)) for x in n.args)
            return Expr(((a & b) if n.value == "AND" else (a | b)).cast("bigint"), "int")
        a, b = (self.expr(x) for x in n.args)
        if n.value in ("=", "!=", "<", "<=", ">", ">="):
            return Expr(self.compare(n.value, a, b).cast("bigint"), "int")
        if n.value == "LIKE":
            return Expr(sq.like(self.text(a), self.text(b)).cast("bigint"), "int")
        if n.value == "GLOB":
            pattern = n.args[1]
            quoted = pattern.kind == "literal" and pattern.args[0] == "text"
            return Expr(F.rlike(self.text(a), F.lit(sq.glob_regex(pattern.value)) if quoted else sq.glob_column(self.text(b))).cast("bigint"), "int")
        if n.value in ("REGEXP", "MATCH"):
            if not self.extended:
                raise EvalError("unknown_function", f"{n.value} is an extension", n.line, n.col)
            return Expr(F.rlike(self.text(a), self.text(b)).cast("bigint"), "int")
        if n.value == "||":
            return Expr(F.concat(self.text(a), self.text(b)), "text")
        return self.arithmetic(n.value, self.number(a), self.number(b))

    def _cast(self, n: Node) -> Expr:
        """As SQLite casts: a text by the number it begins with (0 if by none), a real towards zero."""
        e = self.expr(n.args[0])
        if n.value == "text":
            return Expr(self.text(e), "text")
        if n.value == "real":
            return Expr(self.number(e).col.cast("double"), "real")
        if e.numeric:
            return Expr(e.col.cast("bigint"), "int")
        whole = F.coalesce(F.regexp_extract(self.text(e), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
        return Expr(F.when(self.text(e).isNotNull(), whole), "int")

    def _between(self, n: Node) -> Expr:
        a, low, high = (self.expr(x) for x in n.args)
        inside = self.compare(">=", a, low) & self.compare("<=", a, high)
        return Expr((~inside if n.value else inside).cast("bigint"), "int")

    def _isnull(self, n: Node) -> Expr:
        c = self.expr(n.args[0]).col
        return Expr((c.isNotNull() if n.value else c.isNull()).cast("bigint"), "int")

    def _in(self, n: Node) -> Expr:
        probe, right = n.args
        if right.kind == "ref" and len(right.value) == 1 and right.value[0] in _ARRAYS:
            only = probe.value if probe.kind == "literal" and probe.args[0] == "text" else None
            hit = self._member(self.expr(probe), right.value[0], only)
        elif right.kind == "tuple":
            a = self.expr(probe)
            hit = None
            for item in right.args:
                same = self.compare("=", a, self.expr(item))
                hit = same if hit is None else hit | same
        elif self.extended:
            hit = self.compare("=", self.expr(probe), self.expr(right))
        else:
            raise EvalError("unknown_expr", "IN needs a list of two or more, or tags, outlinks, inlinks or headings", n.line, n.col)
        return Expr((~hit if n.value else hit).cast("bigint"), "int")

    def _member(self, probe: Expr, array: str, only: str | None) -> Column:
        """A mark column; `only` is the probe's text if it is a literal, then the relation is filtered before anything else."""
        v = self.vault
        keep = lambda df, member: df if only is None else df.where(F.col(member) == only)
        pairs = {
            "tags": lambda: keep(v.tags, "tag").select("path", F.col("tag").alias("member")),
            "outlinks": lambda: keep(v.links, "target_path").select(F.col("source_path").alias("path"), F.col("target_path").alias("member")),
            "headings": lambda: keep(v.headings, "text").select("path", F.col("text").alias("member")),
            "inlinks": lambda: link_plans.inlinks(v.files, keep(v.links, "source_path")).select("path", F.col("source_path").alias("member")),
        }[array]()
        mark = f"_in{len(self.marks)}"
        self.marks.append((mark, self.text(probe), pairs.distinct()))
        return F.col(mark).isNotNull()

    # -- typing

    def truth(self, e: Expr) -> Column:
        if e.numeric:
            return e.col != 0
        if e.kind == "tagged":
            return F.when(e.col["rank"] == 1, e.col["num"] != 0).when(e.col["rank"] == 2, sq.numeric_prefix(e.col["str"]) != 0)
        return sq.numeric_prefix(e.col) != 0

    def text(self, e: Expr) -> Column:
        if e.kind == "tagged":
            return sq.tagged_text(e.col)
        return sq.number_text(e.col) if e.kind == "real" else e.col.cast("string")

    def number(self, e: Expr) -> Expr:
        if e.numeric:
            return e
        if e.kind == "tagged":
            return Expr(F.when(e.col["rank"] == 1, e.col["num"]).otherwise(sq.numeric_prefix(e.col["str"])), "real")
        return Expr(sq.numeric_prefix(e.col), "real")

    def arithmetic(self, op: str, a: Expr, b: Expr) -> Expr:
        both = "int" if a.kind == b.kind == "int" else "real"
        x, y = (a.col, b.col) if both == "int" else (a.col.cast("double"), b.col.cast("double"))
        if op == "%":
            return Expr(sq.modulo(x, y) if both == "int" else sq.modulo(x, y).cast("double"), both)
        if op == "/":
            return Expr(sq.divide_int(x, y) if both == "int" else sq.divide_real(x, y), both)
        return Expr({"+": x + y, "-": x - y, "*": x * y}[op], both)

    def lifted(self, e: Expr, beside: Expr) -> Column:
        if e.kind == "tagged":
            return e.col
        if e.kind == "null":
            return F.lit(None).cast("struct<rank:int,num:double,str:string>")
        if e.numeric:
            return sq.tag_text(e.col.cast("string")) if beside.stored == "text" and e.stored is None else sq.tag_number(e.col)
        return sq.tag_text_numeric(e.col) if beside.stored == "number" else sq.tag_text(e.col)

    def compare(self, op: str, a: Expr, b: Expr) -> Column:
        if (a.numeric and b.numeric) or (a.kind == b.kind == "text"):
            x, y = a.col, b.col
        elif "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        else:
            x, y = self.lifted(a, b), self.lifted(b, a)
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    # -- functions

    def _call(self, n: Node) -> Expr:
        name = str(n.value).lower()
        maker = _FUNCTIONS.get(name)
        if maker is None:
            raise EvalError("unknown_function", str(n.value), n.line, n.col)
        low, high, make = maker
        if not low <= len(n.args) <= high:
            raise EvalError("bad_arity", f"{name} takes {low} to {high} arguments", n.line, n.col)
        if name in ("min", "max") and len(n.args) == 1:
            raise EvalError("misused_aggregate", f"{name} of one argument stands only in the select list", n.line, n.col)
        got = make(self, n)
        if got is None:
            raise EvalError("unsupported_argument", f"{name} can't take these arguments", n.line, n.col)
        return got

    def literal_text(self, n: Node) -> str | None:
        return n.value if n.kind == "literal" and n.args[0] == "text" else None

    def moment(self, args: tuple[Node, ...]) -> Column | None:
        """Milliseconds of a time value and its modifiers."""
        if not args:
            return self._now()
        first, rest = args[0], list(args[1:])
        said = self.literal_text(first)
        e = self.expr(first)
        mods = [self.literal_text(m) for m in rest]
        if any(m is None for m in mods):
            return None
        if mods and mods[0].strip().lower() == "unixepoch":
            ms = F.round(self.number(e).col.cast("double") * 1000).cast("bigint")
            mods = mods[1:]
        elif said is not None and said.strip().lower() == "now":
            ms = self._now()
        elif e.numeric:
            ms = sq.from_julian(e.col)
        elif e.kind == "tagged":
            ms = F.when(e.col["rank"] == 1, sq.from_julian(e.col["num"])).otherwise(sq.time_value(e.col["str"]))
        else:
            ms = sq.time_value(e.col)
        for m in mods:
            ms = sq.modify(ms, m)
            if ms is None:
                return None
        return ms

    def _now(self) -> Column:
        return F.lit(int(self.now.timestamp() * 1000)).cast("bigint")


# --- the function table --------------------------------------------------------------------------------------------


def _text1(f):  # noqa: ANN001, ANN202
    return lambda c, n: Expr(f(c.text(c.expr(n.args[0]))), "text")


def _trim(lead: bool, tail: bool):  # noqa: ANN202
    def make(c: Compiler, n: Node) -> Expr:
        s = c.text(c.expr(n.args[0]))
        chars = c.text(c.expr(n.args[1])) if len(n.args) > 1 else F.lit(" ")
        f = F.trim if lead and tail else F.ltrim if lead else F.rtrim
        return Expr(f(s, chars), "text")

    return make


def _moment(show, kind: str = "text"):  # noqa: ANN001, ANN202
    def make(c: Compiler, n: Node) -> Expr | None:
        ms = c.moment(n.args)
        return None if ms is None else Expr(show(ms), kind)

    return make


def _strftime(c: Compiler, n: Node) -> Expr | None:
    fmt, ms = c.literal_text(n.args[0]), c.moment(n.args[1:])
    got = None if fmt is None or ms is None else sq.strftime(fmt, ms)
    return None if got is None else Expr(got, "text")


def _printf(c: Compiler, n: Node) -> Expr | None:
    fmt = c.literal_text(n.args[0])
    args = [c.expr(a) for a in n.args[1:]]
    got = None if fmt is None else sq.printf(fmt, [(sq.tagged_text(a.col) if a.kind == "tagged" else a.col, "text" if a.kind == "tagged" else a.kind) for a in args])
    return None if got is None else Expr(got, "text")


def _substr(c: Compiler, n: Node) -> Expr:
    nums = [c.number(c.expr(a)).col.cast("bigint") for a in n.args[1:]]
    return Expr(sq.substr(c.text(c.expr(n.args[0])), *nums), "text")


def _extreme(static, name: str):  # noqa: ANN001, ANN202
    def make(c: Compiler, n: Node) -> Expr:
        es = [c.expr(a) for a in n.args]
        if all(e.numeric for e in es):
            kind = "int" if all(e.kind == "int" for e in es) else "real"
            return Expr(static(*(e.col.cast("bigint" if kind == "int" else "double") for e in es)), kind)
        if all(e.kind == "text" for e in es):
            return Expr(static(*(e.col for e in es)), "text")
        plain = Expr(F.lit(0), "tagged")
        return Expr(static(*(c.lifted(e, plain) for e in es)), "tagged")

    return make


def _same_kind(c: Compiler, n: Node) -> tuple[list[Column], str]:
    es = [c.expr(a) for a in n.args]
    kinds = {e.kind for e in es} - {"null"}
    if len(kinds) == 1 and "tagged" not in kinds:
        kind = kinds.pop()
        cast = {"int": "bigint", "real": "double", "text": "string"}[kind]
        return [F.lit(None).cast(cast) if e.kind == "null" else e.col for e in es], kind
    plain = Expr(F.lit(0), "tagged")
    return [c.lifted(e, plain) for e in es], "tagged"


def _coalesce(c: Compiler, n: Node) -> Expr:
    cols, kind = _same_kind(c, n)
    return Expr(F.coalesce(*cols), kind)


def _nullif(c: Compiler, n: Node) -> Expr:
    cols, kind = _same_kind(c, n)
    return Expr(F.when(cols[0].eqNullSafe(cols[1]), F.lit(None)).otherwise(cols[0]), kind)


def _rounded(f):  # noqa: ANN001, ANN202
    def make(c: Compiler, n: Node) -> Expr:
        e = c.number(c.expr(n.args[0]))
        return e if e.kind == "int" else Expr(f(e.col).cast("double"), "real")

    return make


def _round(c: Compiler, n: Node) -> Expr | None:
    if len(n.args) == 2 and n.args[1].kind != "literal":
        return None
    digits = int(n.args[1].value or 0) if len(n.args) == 2 else 0
    return Expr(F.round(c.number(c.expr(n.args[0])).col.cast("double"), digits), "real")


def _abs(c: Compiler, n: Node) -> Expr:
    e = c.number(c.expr(n.args[0]))
    return Expr(F.abs(e.col), e.kind)


def _instr(c: Compiler, n: Node) -> Expr:
    a, b = (c.text(c.expr(x)) for x in n.args)
    return Expr(F.call_function("instr", a, b).cast("bigint"), "int")


def _length(c: Compiler, n: Node) -> Expr:
    return Expr(F.char_length(c.text(c.expr(n.args[0]))).cast("bigint"), "int")


def _concat(c: Compiler, n: Node) -> Expr:
    return Expr(F.concat_ws("", *(c.text(c.expr(a)) for a in n.args)), "text")


def _wellformed(text: Column) -> Column:
    """The text, null for null; anything that is no JSON ends the query."""
    return F.when(text.isNull() | F.call_function("try_parse_json", text).isNotNull(), text).otherwise(F.raise_error(F.lit("malformed JSON")))


def _json(c: Compiler, n: Node) -> Expr:
    outside = r'("(?:[^"\\]|\\.)*")|\s+'
    return Expr(F.regexp_replace(_wellformed(c.text(c.expr(n.args[0]))), outside, "$1"), "text")


def _json_extract(c: Compiler, n: Node) -> Expr | None:
    """One path gives the value (true and false as 1 and 0), several an array of their JSON texts."""
    text = _wellformed(c.text(c.expr(n.args[0])))
    paths = [c.literal_text(p) for p in n.args[1:]]
    if any(p is None for p in paths):
        return None
    variant = F.call_function("try_parse_json", text)
    kind = lambda p: F.call_function("schema_of_variant", F.call_function("variant_get", variant, F.lit(p)))
    if len(paths) > 1:
        parts = [F.coalesce(F.to_json(F.call_function("variant_get", variant, F.lit(p))), F.lit("null")) for p in paths]
        return Expr(F.when(text.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))), "text")
    got, of = F.get_json_object(text, paths[0]), kind(paths[0])
    value = F.when(of == "BOOLEAN", sq.tag_number(F.when(got == "true", 1).otherwise(0))).when(of.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"), sq.tag_number(got.try_cast("double"))).otherwise(sq.tag_text(got))
    shown = F.when(of == "BOOLEAN", F.when(got == "true", "1").otherwise("0")).otherwise(got)
    return Expr(value, "tagged", shown=shown)


def _json_array_length(c: Compiler, n: Node) -> Expr | None:
    text = _wellformed(c.text(c.expr(n.args[0])))
    if len(n.args) == 2:
        path = c.literal_text(n.args[1])
        if path is None:
            return None
        text = F.get_json_object(text, path)
    return Expr(F.when(text.isNotNull(), F.coalesce(F.json_array_length(text), F.lit(0))).cast("bigint"), "int")


_FUNCTIONS = {
    "length": (1, 1, _length), "upper": (1, 1, _text1(sq.upper_ascii)), "lower": (1, 1, _text1(sq.lower_ascii)),
    "trim": (1, 2, _trim(True, True)), "ltrim": (1, 2, _trim(True, False)), "rtrim": (1, 2, _trim(False, True)),
    "substr": (2, 3, _substr), "instr": (2, 2, _instr), "printf": (1, 99, _printf), "concat": (1, 99, _concat),
    "replace": (3, 3, lambda c, n: Expr(F.replace(*(c.text(c.expr(a)) for a in n.args)), "text")),
    "date": (0, 99, _moment(sq.date_text)), "time": (0, 99, _moment(sq.time_text)),
    "datetime": (0, 99, _moment(lambda ms: F.concat(sq.date_text(ms), F.lit(" "), sq.time_text(ms)))),
    "julianday": (0, 99, _moment(sq.julian, "real")), "strftime": (1, 99, _strftime),
    "abs": (1, 1, _abs), "round": (1, 2, _round), "ceil": (1, 1, _rounded(F.ceil)), "floor": (1, 1, _rounded(F.floor)),
    "min": (1, 99, _extreme(sq.least_null, "min")), "max": (1, 99, _extreme(sq.greatest_null, "max")),
    "coalesce": (2, 99, _coalesce), "nullif": (2, 2, _nullif),
    "json": (1, 1, _json), "json_extract": (2, 99, _json_extract), "json_array_length": (1, 2, _json_array_length),
}


def aggregates(n: Node) -> list[Node]:
    """Calls of min or max with one argument in an expression, outermost only."""
    if n.kind == "call" and str(n.value).lower() in ("min", "max") and len(n.args) == 1:
        return [n]
    return [x for a in n.args if isinstance(a, Node) for x in aggregates(a)]


def bare(n: Node) -> bool:
    """Whether a column stands outside every aggregate."""
    if n.kind == "call" and aggregates(n) == [n]:
        return False
    return n.kind == "ref" or any(bare(a) for a in n.args if isinstance(a, Node))


def unparse(n: Node) -> str:
    """A readable name for an unnamed column."""
    if n.kind == "literal":
        return f"'{n.value}'" if n.args[0] == "text" else str(n.value)
    if n.kind == "ref":
        return ".".join(n.value)
    inner = [unparse(a) for a in n.args]
    if n.kind == "binary":
        return f" {n.value} ".join(inner)
    if n.kind == "call":
        return f"{n.value}({', '.join(inner)})"
    return f"{n.kind}({', '.join(inner)})"


def query(vault: Vault, text: str, now: datetime | None = None, extended: bool = False) -> DataFrame:
    """Run one query over a vault; nothing is read until the result is."""
    return Compiler(vault, now, extended).plan(parse(text, extended))


def query_file(vault: Vault, path: str, now: datetime | None = None, extended: bool = False) -> DataFrame:
    """A query kept in a file."""
    with open(path, encoding="utf-8") as f:
        return query(vault, f.read(), now, extended)

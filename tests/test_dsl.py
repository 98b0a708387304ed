"""The query language against SQLite itself (same rows, hand-written SQL), and its error codes."""

import sqlite3
from datetime import datetime, timezone

import pytest

from lodestrata.dsl import compiler, lexer, parser
from lodestrata.errors import QueryError
from lodestrata.vault import FILES, FRONTMATTER, HEADINGS, LINKS, TAGS, Vault

ROWS = {
    "files": [("a/One.md", 100, 90, 10, "h1", 5), ("a/b/two.md", 200, 200, 20, "h2", 5), ("three.MD", 300, 300, -7, "h3", 5), ("a/album.md", 400, 400, 0, None, 5), ("é x/my_note.md", 500, 500, 33, "h5", 5), ("z/myXnote.md", 600, 600, 21, "h6", 6)],
    "frontmatter": [("a/One.md", "n", "number", "3", None, 3.0), ("a/b/two.md", "n", "string", '"3"', "3", None), ("three.MD", "n", "bool", "true", None, 1.0), ("a/album.md", "n", "list", '["x","y"]', None, None), ("z/myXnote.md", "n", "string", '"abc"', "abc", None), ("a/One.md", "s", "string", '"Hello"', "Hello", None)],
    "tags": [("a/One.md", "red"), ("a/One.md", "blue"), ("a/b/two.md", "red"), ("z/myXnote.md", "One")],
    "links": [("a/One.md", "two", None, "wiki", 1), ("a/One.md", "two", None, "wiki", 2), ("a/b/two.md", "a/One", None, "md", 1), ("three.MD", "a/One.md", None, "wiki", 1), ("z/myXnote.md", "ONE", None, "wiki", 1), ("a/album.md", "my_note", None, "wiki", 3), ("a/album.md", "nowhere", None, "wiki", 4), ("a/album.md", "y_note", None, "wiki", 4)],
    "headings": [("a/One.md", 1, "Intro", 0), ("a/b/two.md", 2, "Intro", 3), ("three.MD", 1, "End", 1)],
}
SCHEMAS = {"files": FILES, "frontmatter": FRONTMATTER, "tags": TAGS, "links": LINKS, "headings": HEADINGS}
FM = "(SELECT CASE type WHEN 'string' THEN value_text WHEN 'number' THEN value_num WHEN 'bool' THEN value_num ELSE value_json END FROM frontmatter m WHERE m.path=files.path AND key='n')"
IN_LINK = "EXISTS(SELECT 1 FROM links l WHERE (l.target_path=files.path OR l.target_path||'.md'=files.path OR files.path LIKE '%/'||l.target_path||'.md') AND l.source_path={})"
NOW = datetime(2024, 3, 31, 12, 30, 15, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def small_vault(spark):
    return Vault(**{n: spark.createDataFrame(ROWS[n], SCHEMAS[n]) for n in ("files", "frontmatter", "tags", "links", "headings")})


@pytest.fixture(scope="module")
def lite():
    db = sqlite3.connect(":memory:")
    for n, rows in ROWS.items():
        cols = SCHEMAS[n].replace("string", "TEXT").replace("long", "INTEGER").replace("int ", "INTEGER ").replace("int,", "INTEGER,").replace("double", "REAL")
        db.execute(f"CREATE TABLE {n} ({cols})")
        db.executemany(f"INSERT INTO {n} VALUES ({','.join('?' * len(rows[0]))})", rows)
    return db


SAME = [
    "path, size WHERE size > 5 ORDER BY size DESC",
    "path WHERE size = '10' OR size >= '21' ORDER BY path",
    "path WHERE mtime > date('2024-01-01') ORDER BY path",
    "path WHERE path LIKE 'A/%' ORDER BY path",
    "path WHERE path LIKE '%y_note%' ORDER BY path",
    "path WHERE path GLOB 'a/**' ORDER BY path",
    "path WHERE path GLOB '[^a]*.[mM]?' ORDER BY path",
    "path WHERE size IN (10, 20, '33') ORDER BY path",
    "path WHERE size NOT IN (10, 20) ORDER BY path",
    "path WHERE NOT size BETWEEN 0 AND 20 ORDER BY path",
    "path WHERE content_hash IS NULL OR size % 2 = 1 ORDER BY path",
    "path, size / 3 AS d, size % 3 AS m, -size AS u, size * 2 - 1 AS e ORDER BY path",
    "path, size / 0 AS z, size / 2.0 AS r, '5' + 1 AS t, 'a' + 1 AS y, 7.9 % 2.1 AS q ORDER BY path",
    "path, path || ':' || size AS p, content_hash || 'x' AS n ORDER BY path",
    "DISTINCT last_scanned AS l ORDER BY last_scanned DESC",
    "path ORDER BY content_hash, path LIMIT 3 OFFSET 1",
    "path ORDER BY content_hash DESC, path LIMIT 2",
    "path ORDER BY content_hash NULLS LAST, path",
    "path, substr(path, 0, 3) AS a, substr(path, -3, 2) AS b, substr(path, -99, 95) AS c, substr(path, 3, -2) AS d, substr(path, 2) AS e ORDER BY path",
    "path, upper(path) AS u, lower(path) AS l, length(path) AS n, length(size) AS m ORDER BY path",
    "path, trim('  x ') AS a, trim('xxaxx', 'x') AS b, ltrim('xxa', 'x') AS c, rtrim('ab.md', '.md') AS d ORDER BY path",
    "path, replace(path, 'a', 'bb') AS r, instr(path, '/') AS i ORDER BY path",
    "path, abs(size) AS a, round(size / 7.0, 2) AS r, round(7) AS s, ceil(1.2) AS c, floor(-1.2) AS f, abs('a') AS t ORDER BY path",
    "path, min(size, 5) AS a, max(size, 5, mtime) AS b, max('a', 'b') AS c, min(size, NULL) AS d ORDER BY path",
    "path, coalesce(content_hash, 'none') AS c, nullif(size, 10) AS n ORDER BY path",
    "path, date(mtime, 'unixepoch') AS d, datetime(mtime * 100000, 'unixepoch', '+1 month', 'start of month', '-1 day') AS e ORDER BY path",
    "path, date('2024-01-31', '+1 month') AS a, julianday('2024-01-01') AS c, time('2024-01-01 10:20:30', '+90 minutes') AS d ORDER BY path",
    "path, strftime('%Y/%m/%d %H-%M-%S %j %w %s', '2024-02-29 23:59:58') AS s, date('2024-05-01', 'weekday 0') AS w, date('nonsense') AS n ORDER BY path",
    "path, printf('%05d|%s|%.2f|%x|%%', size, path, size, 255) AS p ORDER BY path",
    "path, json_array_length('[1,2]') AS a, json_array_length('{}') AS b, json('{\"b\": 1.50, \"a\": [1, 2]}') AS j ORDER BY path",
    "path WHERE 'a' OR size ORDER BY path",
    "path WHERE NOT 'a' ORDER BY path",
    "max(size) AS m",
    "path, min(size) AS m",
    "path WHERE NULL = 1 OR size = 10",
]


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("text", SAME)
def test_equals_sqlite(small_vault, lite, text):
    got = [tuple(_plain(v) for v in r) for r in compiler.query(small_vault, f"SELECT {text}", NOW).collect()]
    body = f"SELECT {text}"
    i = min((body.find(w) for w in (" WHERE ", " ORDER BY ") if w in body), default=len(body))
    want = [tuple(_plain(v) for v in r) for r in lite.execute(f"{body[:i]} FROM files {body[i:]}").fetchall()]
    assert got == want


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("path WHERE fm.n = 3 ORDER BY path", f"path FROM files WHERE {FM} = 3 ORDER BY path"),
        ("path WHERE fm.n = '3' ORDER BY path", f"path FROM files WHERE {FM} = '3' ORDER BY path"),
        ("path WHERE fm['n'] > 1 ORDER BY path", f"path FROM files WHERE {FM} > 1 ORDER BY path"),
        ("path WHERE fm.n BETWEEN 1 AND 'z' ORDER BY path", f"path FROM files WHERE {FM} BETWEEN 1 AND 'z' ORDER BY path"),
        ("path WHERE fm.n IN (3, 'abc') ORDER BY path", f"path FROM files WHERE {FM} IN (3, 'abc') ORDER BY path"),
        ("path ORDER BY fm.n, path", f"path FROM files ORDER BY {FM}, path"),
        ("path ORDER BY fm.n DESC, path", f"path FROM files ORDER BY {FM} DESC, path"),
        ("path WHERE fm.n IS NULL ORDER BY path", f"path FROM files WHERE {FM} IS NULL ORDER BY path"),
        ("path WHERE fm.absent = 1", "path FROM files WHERE 0"),
        ("path, fm.n + 1 AS x ORDER BY path", f"path, {FM} + 1.0 FROM files ORDER BY path"),
        ("path WHERE 'red' IN tags ORDER BY path", "path FROM files WHERE EXISTS(SELECT 1 FROM tags t WHERE t.path=files.path AND tag='red') ORDER BY path"),
        ("path WHERE 'red' NOT IN tags OR size = 10 ORDER BY path", "path FROM files WHERE NOT EXISTS(SELECT 1 FROM tags t WHERE t.path=files.path AND tag='red') OR size=10 ORDER BY path"),
        ("path, name IN tags AS t ORDER BY path", "path, EXISTS(SELECT 1 FROM tags t WHERE t.path=files.path AND tag=CASE files.path WHEN 'a/One.md' THEN 'One' WHEN 'z/myXnote.md' THEN 'myXnote' END) FROM files ORDER BY path"),
        ("path WHERE 'two' IN outlinks", "path FROM files WHERE EXISTS(SELECT 1 FROM links l WHERE source_path=path AND target_path='two')"),
        ("path WHERE 'Intro' IN headings ORDER BY path", "path FROM files WHERE EXISTS(SELECT 1 FROM headings h WHERE h.path=files.path AND text='Intro') ORDER BY path"),
        *((f"path WHERE '{s}' IN inlinks ORDER BY path", f"path FROM files WHERE {IN_LINK.format(repr(s))} ORDER BY path") for s in ("a/One.md", "a/b/two.md", "three.MD", "z/myXnote.md", "a/album.md")),
    ],
)
def test_frontmatter_and_arrays_equal_sqlite(small_vault, lite, text, sql):
    got = [tuple(r) for r in compiler.query(small_vault, f"SELECT {text}", NOW).collect()]
    assert [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in got] == lite.execute(f"SELECT {sql}").fetchall()


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("max(mtime) LIMIT 0", "max(mtime) FROM files LIMIT 0"), ("max(mtime) LIMIT 5 OFFSET 1", "max(mtime) FROM files LIMIT 5 OFFSET 1"), ("max(mtime) + 1", "max(mtime) + 1 FROM files"),
        ("upper(max(path)), size", "upper(max(path)), size FROM files"), ("DISTINCT min(path) || '!', size * 2 WHERE size > 5 ORDER BY path LIMIT 1", "DISTINCT min(path) || '!', size * 2 FROM files WHERE size > 5 ORDER BY path LIMIT 1"),
        ("max(path), size ORDER BY max(path)", "max(path), size FROM files ORDER BY max(path)"), ("max(size) - min(size) WHERE size < 0", "max(size) - min(size) FROM files WHERE size < 0"),
        ("path WHERE path GLOB substr(path, 1, 2) || '*' ORDER BY path", "path FROM files WHERE path GLOB substr(path, 1, 2) || '*' ORDER BY path"),
        ("path ORDER BY path LIMIT 9223372036854775807", "path FROM files ORDER BY path LIMIT 9223372036854775807"), ("path LIMIT 3 OFFSET 9223372036854775807", "path FROM files LIMIT 3 OFFSET 9223372036854775807"),
    ],
)
def test_aggregates_and_cuts_equal_sqlite(small_vault, lite, text, sql):
    assert [tuple(r) for r in compiler.query(small_vault, f"SELECT {text}", NOW).collect()] == lite.execute(f"SELECT {sql}").fetchall()


@pytest.mark.parametrize("call", ["json('{bad')", "json_extract('{bad', '$.a')", "json_array_length('[1')"])
def test_malformed_json_ends_the_query(small_vault, call):
    with pytest.raises(Exception, match="malformed JSON"):
        compiler.query(small_vault, f"SELECT {call}", NOW).collect()


def test_star_derived_columns_and_projected_types(small_vault):
    assert compiler.query(small_vault, "select * from files").columns == ["path", "mtime", "ctime", "size", "content_hash", "last_scanned"]
    rows = compiler.query(small_vault, "SELECT name, folder, fm.n WHERE path LIKE '%e.m%' OR path LIKE 'three%' ORDER BY path").collect()
    assert [tuple(r) for r in rows] == [("One", "a", "3.0"), ("three", "", "true"), ("myXnote", "z", "abc"), ("my_note", "é x", None)]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("path", "parse.expected_select"), ("SELECT path FROM 'x'", "parse.expected_from_table"), ("SELECT path FROM notes", "eval.unsupported_from"),
        ("SELECT path ORDER path", "parse.expected_by_after_order"), ("SELECT path AS 1", "parse.expected_alias"),
        ("SELECT path ORDER BY path NULLS 1", "parse.expected_nulls_first_or_last"), ("SELECT path LIMIT x", "parse.expected_limit_int"),
        ("SELECT path LIMIT 1 OFFSET x", "parse.expected_offset_int"), ("SELECT path WHERE size BETWEEN 1 OR 2", "parse.expected_and_in_between"),
        ("SELECT path WHERE size IS 1", "parse.expected_null_after_is"), ("SELECT path WHERE a = b = c", "parse.unexpected_trailing"),
        ("SELECT path WHERE NOT NOT size", "parse.unexpected_token"), ("SELECT path WHERE path NOT LIKE 'a'", "parse.unexpected_trailing"),
        ("SELECT CAST(size)", "parse.unexpected_token"), ("SELECT fm[1]", "parse.expected_string_in_bracket"), ("SELECT fm['a'", "parse.expected_rbracket"),
        ("SELECT fm.", "parse.expected_ident_after_dot"), ("SELECT length(path", "parse.expected_rparen_in_call"), ("SELECT (1", "parse.expected_comma_or_rparen"),
        ("SELECT (1, 2", "parse.expected_rparen_in_tuple"), ("SELECT 'x", "lex.unterminated_string"), ('SELECT "x', "lex.unterminated_quoted_ident"),
        ("SELECT /* x", "lex.unterminated_block_comment"), ("SELECT ;", "lex.unexpected_char"), ("SELECT tags", "eval.bare_array_ref"), ("SELECT fm", "eval.bare_fm"),
        ("SELECT fm.a.b", "eval.bad_fm_access"), ("SELECT nope", "eval.unknown_column"), ("SELECT a.b", "eval.unsupported_ref"), ("SELECT contains(path)", "eval.unknown_function"),
        ("SELECT path WHERE path IN ('a')", "eval.unknown_expr"), ("SELECT path WHERE path REGEXP 'a'", "eval.unknown_function"),
        ("SELECT path WHERE max(size) = 1", "eval.misused_aggregate"), ("SELECT path ORDER BY max(size)", "eval.misused_aggregate"), ("SELECT path LIMIT 9223372036854775808", "parse.expected_limit_int"),
    ],
)
def test_error_codes(small_vault, text, code):
    with pytest.raises(QueryError) as e:
        compiler.query(small_vault, text)
    assert e.value.code == code


def test_positions_comments_and_keywords():
    toks = lexer.Lexer("select -- c\n  \"order\" /* x\ny */ 'it''s' 1.5 <>").tokens()
    assert [(t.kind, t.value, t.line) for t in toks] == [("KEYWORD", "SELECT", 1), ("IDENT", "order", 2), ("STRING", "it's", 3), ("FLOAT", "1.5", 3), ("OP", "!=", 3), ("END", "", 3)]
    assert parser.parse("SELECT a WHERE 1 + 2 * 3 = 7 AND NOT x OR y").where.value == "OR"


def test_cast_is_an_extension(small_vault, lite):
    text = "CAST('12abc' AS INTEGER) AS a, CAST(' -3.9x' AS REAL) AS b, CAST('x' AS INTEGER) AS c, CAST(7.9 AS INT) AS d, CAST(size AS TEXT) AS e, CAST(NULL AS INTEGER) AS f"
    got = [tuple(r) for r in compiler.query(small_vault, f"SELECT {text} ORDER BY path", NOW, extended=True).collect()]
    assert got == lite.execute(f"SELECT {text} FROM files ORDER BY path").fetchall()
    with pytest.raises(QueryError):
        compiler.query(small_vault, "SELECT CAST(size AS TEXT)")

"""Notes, statements, decision records and streams from text."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import changefeed
from lodestrata.plans import index
from lodestrata.runtime import scratch
from lodestrata.sources import decisions, markdown, sinks, statements
from lodestrata.streaming import refresh
from tests.conftest import rows_of

NOTE = """---
title: "Say <hi> & bye"
n: 3
f: 1.5
on: yes
done: true
when: 2024-01-02
tags: [Red, "#blue", 5]
tag: "a, b #c"
gone: null
octal: 010
---
# One ##

See [[x|The X]] and ![[img.png]] then [text](u.md) #inline/tag-1 not#this
```py
# no [[link]] #no
~~~
```
~~~~
~~~
[[still]]
~~~~
## Two
[[p#h]]"""


def test_one_note():
    got = markdown.extract(NOTE)
    fm = {r["key"]: (r["type"], r["value_json"], r["value_text"], r["value_num"]) for r in got["frontmatter"]}
    assert fm["title"] == ("string", '"Say \\u003chi\\u003e \\u0026 bye"', "Say <hi> & bye", None)
    assert fm["n"] == ("number", "3", None, 3.0)
    assert fm["f"] == ("number", "1.5", None, 1.5)
    assert fm["on"] == ("string", '"yes"', "yes", None)
    assert fm["done"] == ("bool", "true", None, 1.0)
    assert fm["when"] == ("string", '"2024-01-02T00:00:00Z"', "2024-01-02T00:00:00Z", None)
    assert fm["octal"][3] == 8.0
    assert "gone" not in fm
    assert got["tags"] == ["5", "Red", "a", "b", "blue", "c", "inline/tag-1"]
    assert [(x["target_path"], x["alias"], x["link_type"], x["line"]) for x in got["links"]] == [("x", "The X", "wiki", 3), ("img.png", None, "embed", 3), ("u.md", "text", "md", 3), ("p#h", None, "wiki", 13)]
    assert [(h["depth"], h["text"], h["line_offset"]) for h in got["headings"]] == [(1, "One", 0), (2, "Two", NOTE.split("---\n", 2)[2].index("## Two"))]


@pytest.mark.parametrize(
    ("text", "front", "body"),
    [
        ("---\na: 1\n", None, "---\na: 1\n"), ("x\n---\na: 1\n---\n", None, "x\n---\na: 1\n---\n"), ("---\r\na: 1\r\n--- \t\r\nb\r\n", "a: 1\n", "b\r\n"),
        ("---", None, "---"), ("---\n---\nb", "", "b"), ("---x\na\n---\n", None, "---x\na\n---\n"),
    ],
)
def test_frontmatter_borders(text, front, body):
    assert markdown.split_frontmatter(text) == (front, body)


@pytest.mark.parametrize("bad", ["a: [1", "a: 1\na: 2", "\tx: 1"])
def test_unreadable_frontmatter_is_kept_with_an_error(spark, bad):
    df = spark.createDataFrame([("a.md", f"---\n{bad}\n---\n# T"), ("b.md", None), ("c.md", "")], "path string, content string")
    got = {r.path: r for r in markdown.extracted(df).collect()}
    assert got["a.md"].error and len(got["a.md"].headings) == 1
    assert got["b.md"].error is None and got["b.md"].tags == [] and got["c.md"].links == []
    with pytest.raises(Exception, match="a.md"):
        markdown.extracted(df, strict=True).collect()


def test_scan_extract_and_refresh_a_vault(spark, tmp_path):
    for p, t in {"a.md": "# A\n[[b]]", "sub/b.MD": "---\nk: 1\n---\n", "no.txt": "x", ".git/c.md": "x", "skip/d.md": "x", "skip/keep.md": "#tag", "deep/skip/e.md": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    seen = markdown.scan(spark, str(tmp_path), ignore_lines=("skip/*", "!skip/keep.md", "deep/**"))
    assert sorted(r.path for r in seen.select("path").collect()) == ["a.md", "skip/keep.md", "sub/b.MD"]
    v = markdown.relations(seen.select("path", "mtime"), markdown.extracted(seen))
    assert rows_of(v.links) == [("a.md", "b", None, "wiki", 2)]
    assert rows_of(v.tags) == [("skip/keep.md", "tag")]
    assert rows_of(v.frontmatter.select("path", "key", "value_num")) == [("sub/b.MD", "k", 1.0)]
    scanned = seen.select("path", "mtime", "size", index.content_hash().alias("content_hash"))
    stored = index.refreshed(spark.createDataFrame([], "path string, mtime long, ctime long, size long, content_hash string, last_scanned long"), scanned, 7)
    assert {r.action for r in index.classify(stored, scanned).collect()} == {"unchanged"}


def test_statements_round_trip(spark, tmp_path):
    rows = [{"record_id": "A", "title": "it's; a\n'test'", "n": 3, "x": None, "updated_at": "2024-01-01", "deleted_at": None, "hash": "h1", "canonical_version": 2}, {"record_id": "B", "title": "", "n": -1, "x": "ü)", "updated_at": "2024-01-02", "deleted_at": "2024-01-03", "hash": "h2", "canonical_version": 2}]
    text = "\n".join(statements.render("tickets", ["record_id"], r) for r in rows) + "\nVACUUM;\n"
    got = [statements.read(s) for s in statements.split(text)]
    assert [g and g["row"] for g in got] == [*rows, None]
    assert got[0]["keys"] == ["record_id"]
    (tmp_path / "tickets").mkdir()
    (tmp_path / "tickets" / "2024-01.sql").write_text(text)
    log = statements.read_log(spark, str(tmp_path))
    assert [(r.log_file, r.line_no, r.key_columns, r.hash) for r in log.orderBy("line_no").collect()] == [("tickets/2024-01.sql", 1, "record_id", "h1"), ("tickets/2024-01.sql", 2, "record_id", "h2")]
    assert json.loads(log.orderBy("line_no").first().row_json)["title"] == "it's; a\n'test'"
    store = changefeed.MergeStore(spark, scratch(spark, "t"))
    store.append(changefeed.log_versions(log))
    assert [r.row_key for r in store.current().collect()] == ["A"]


def test_decision_records(spark):
    text = (
        "### D-1: First\n- **Date:** 2024-01-01\n- **Superseded by:** D-2\n- **Supersedes:** D-012, D-1\nmay resolve Q-4, T-5 or xD-7\n  - **Resolves:** Q-4 and Q-4\n**Amendment (2024):** D-3\n---\nD-9 outside\n"
        "### Q-03:  \r\n- **Status:** Resolved, partially\n### Q-5: Fifth\n- **Status:** resolved by D-1\n- **Status:** open\n- **Depends on:** D-3\n### Q-6: Sixth\n### R-5: Third\r\n- **Rejected:** 2023-05-06\n- **Superseded by:** D-1\n- see D-1 " + "ü" * 150
    )
    df = spark.createDataFrame([("decisions/arch.md", text), ("decisions/Other One.md", "### D-1: Again"), ("questions/arch-x.md", None), ("questions/arch.md", ""), ("questions/README.md", "### Q-9: no")], "path string, content string")
    got = decisions.decision_records(df).where("path = 'decisions/arch.md'").orderBy("ordinal").collect()
    assert [(r.id, r.type, r.title, r.status, r.date, r.domain) for r in got] == [
        ("D-1", "confirmed", "First", "superseded", "2024-01-01", "arch"), ("Q-03", "question", "", "open", None, "arch"), ("Q-5", "question", "Fifth", "resolved", None, "arch"),
        ("Q-6", "question", "Sixth", "open", None, "arch"), ("R-5", "rejected", "Third", "active", "2023-05-06", "arch"),
    ]
    assert got[2].body == "- **Depends on:** D-3"
    refs = {(r.id, r.target, r.ref_type): r.note for r in decisions.decision_references(df).collect()}
    assert set(refs) == {("D-1", "D-2", "references"), ("D-1", "D-012", "supersedes"), ("D-1", "Q-4", "references"), ("D-1", "Q-4", "resolves"), ("D-1", "D-3", "amends"), ("Q-5", "D-1", "references"), ("Q-5", "D-3", "depends_on"), ("R-5", "D-1", "references")}
    assert refs["D-1", "Q-4", "resolves"] == "**Resolves:** Q-4 and Q-4"
    assert refs["R-5", "D-1", "references"].endswith("ü...") or len(refs["R-5", "D-1", "references"].encode()) <= 200
    bad = {(r.problem, r.subject, r.other) for r in decisions.violations(df).collect()}
    assert bad == {
        ("duplicate_id", "D-1", ""), ("empty_title", "Q-03", ""), ("broken_ref", "D-1", "D-2"), ("broken_ref", "D-1", "D-012"), ("broken_ref", "D-1", "Q-4"), ("broken_ref", "D-1", "D-3"), ("broken_ref", "Q-5", "D-3"),
        ("filename_style", "decisions/Other One.md", ""), ("wrong_folder", "decisions/arch.md", "Q-03"), ("wrong_folder", "decisions/arch.md", "Q-5"), ("wrong_folder", "decisions/arch.md", "Q-6"), ("wrong_folder", "decisions/arch.md", "R-5"),
        ("unpaired", "questions/arch-x.md", ""), ("shared_prefix", "questions/arch.md", "questions/arch-x.md"),
    }


def test_decision_sync(spark):
    old = spark.createDataFrame([("D-1", "a"), ("D-2", "b"), ("D-3", None)], "id string, hash string")
    new = spark.createDataFrame([("D-1", "a"), ("D-2", "c"), ("D-4", "d")], "id string, hash string")
    assert rows_of(decisions.sync(old, new)) == [("D-1", "unchanged"), ("D-2", "changed"), ("D-3", "pruned"), ("D-4", "new")]


def test_log_stream_arrives_in_any_order_and_repeats(spark, small, tmp_path):
    from lodestrata.queries_training import p4_found
    from lodestrata.runtime import table

    log = table(spark, small, "changelog")
    at = str(tmp_path / "log")
    for i in (2, 0, 1, 0):
        log.where(f"pmod(hash(hash, line_no), 3) = {i}").write.mode("append").parquet(at)
    store = changefeed.MergeStore(spark, scratch(spark, "s"), fan_in=3)
    store.append(changefeed.ticket_versions(table(spark, small, "tickets")))
    for _ in range(2):
        refresh.follow_log(spark, at, store).awaitTermination()
    assert len(store.runs) < 3
    assert rows_of(store.current().select("table_name", "row_key", "hash")) == rows_of(p4_found(spark, small))


def test_history_stream_keeps_one_row_per_hash(spark, small, tmp_path):
    from lodestrata.runtime import table

    history = table(spark, small, "ticket_history")
    at = str(tmp_path / "h")
    history.unionByName(history).write.parquet(at)
    stream = refresh.distinct_history(spark.readStream.schema(history.schema).parquet(at))
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("kept").count() == history.select("hash").distinct().count()


def test_polling_applies_changes_and_removals(spark, tmp_path):
    (tmp_path / "a.md").write_text("one")
    state = {"stored": spark.createDataFrame([("gone.md", 1, "h")], "path string, mtime long, content_hash string"), "seen": []}

    def scan():
        return markdown.scan(spark, str(tmp_path)).select("path", "mtime", "size", index.content_hash().alias("content_hash"))

    def apply(seen, acts):
        state["seen"].append({r.path: r.action for r in acts.collect()})
        state["stored"] = seen.select("path", "mtime", "content_hash")

    q = refresh.poll_vault(spark, scan, lambda: state["stored"], apply, "200 milliseconds")
    try:
        import time

        end = time.time() + 60
        while not state["seen"] and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert state["seen"] == [{"a.md": "new", "gone.md": "removed"}]


def test_scanners_of_a_line():
    assert markdown.inline_tags("#one a#no (#no) #two/x-y_z, #3 #é\t#four") == ["one", "two/x-y_z", "four"]
    assert markdown.wiki_links("[[a|b]] ![[c]] [[]] [[x]y]] [[[d]] [[open") == [(False, "a|b"), (True, "c"), (False, "[d")]
    assert markdown.inline_links("[a](b) ![](c d) [x]() [no] (y) [p [q](r) [[w]](z)") == [("a", "b"), ("", "c d"), ("p [q", "r")]
    assert [markdown.heading(x) for x in ("# A #", "####### no", "#no", "###### six ", "##   ", " # no", "## C# ##")] == [(1, "A"), None, None, (6, "six"), None, None, (2, "C#")]
    assert markdown.inline_links("[" * 200_000) == [] and markdown.wiki_links("[[" * 100_000) == []


def test_fences_may_be_indented():
    body = "    ```\n# in\n\t```\n# out\n~~~~\n# in\n~~~\n# in\n~~~~~ x\n# out2"
    assert [t for _, _, t in markdown.open_lines(body)] == ["# out", "# out2"]


def test_anchors_and_slugs(spark):
    body = "# A b\n## A b\n```\n# no\n  ``` x\n###### A  B #\n# é\n####### x\n#\tT\n#no\n# Hello, World -- Foo_Bar é!\r\n```\n# open end"
    df = spark.createDataFrame([("a.md", body), ("b.md", None), ("c.md", ""), ("d.md", "# A b")], "path string, content string")
    got = [(r.path, r.level, r.text, r.slug) for r in markdown.heading_anchors(df).collect()]
    assert sorted(got) == sorted([("a.md", 1, "A b", "a-b"), ("a.md", 2, "A b", "a-b-1"), ("a.md", 6, "A  B", "a-b-2"), ("a.md", 1, "T", "t"), ("a.md", 1, "Hello, World -- Foo_Bar é!", "hello-world-foo_bar"), ("d.md", 1, "A b", "a-b")])


def test_ignore_rules_know_classes_and_folders():
    def gone(rules, path):
        drop = False
        for keep, p in markdown._ignored(rules):
            drop = (not keep) if p.match(path) else drop
        return drop

    assert gone(["[Dd]rafts/"], "Drafts/a.md") and gone(["[Dd]rafts/"], "x/drafts/a.md") and not gone(["[Dd]rafts/"], "drafts") and not gone(["drafts.md/"], "drafts.md")
    assert gone(["n[!0-9].md"], "nx.md") and not gone(["n[!0-9].md"], "n1.md") and not gone(["n[!0-9]md"], "n/md") and gone(["*.md", "!keep.md"], "a/b.md") and not gone(["*.md", "!keep.md"], "keep.md")


def test_rendered_statements_equal_the_single_ones(spark):
    df = spark.createDataFrame([("A", "it's", 3, None, "2024-01-01"), ("B", "", None, "x", None)], "record_id string, title string, n int, x string, updated_at string")
    want = [statements.render("tickets", ["record_id"], r.asDict()) for r in df.collect()]
    assert [r.statement for r in statements.rendered(df, "tickets", ["record_id"]).collect()] == want


def test_unreadable_statements_stop_the_import_or_show(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "2024-01.sql").write_text("INSERT INTO t (a, b) VALUES ('x', 1) ON CONFLICT(a) DO NOTHING;\nUPDATE t SET a = 1;\nINSERT INTO t (a) VALUES ('y', 2);\nVACUUM;\n")
    with pytest.raises(Exception, match="statement 2"):
        statements.read_log(spark, str(tmp_path)).collect()
    rows = statements.read_log(spark, str(tmp_path), strict=False).orderBy("line_no").collect()
    assert [(r.line_no, r.error is None) for r in rows] == [(1, True), (2, False), (3, False)] and rows[1].row_json.startswith("UPDATE")


def test_log_append_writes_each_line_once(spark, tmp_path):
    from lodestrata.plans import planning_log

    rows = spark.createDataFrame([("D-1", "it's", "2024-01-02", "h1"), ("D-2", None, "2024-01-01", "h2"), ("D-2", None, "2024-01-01", "h2"), ("D-3", "x", "2024-02-01", "h3"), ("D-4", "y", None, "h4")], "id string, title string, updated_at string, hash string")
    first = planning_log.append_log(planning_log.export(rows.where("id <> 'D-3'"), "decisions", "2024"), str(tmp_path), "decisions", ["id"])
    assert rows_of(first) == [("decisions/2024-01.sql", 2, 0)]
    again = planning_log.append_log(planning_log.export(rows, "decisions", "2024"), str(tmp_path), "decisions", ["id"])
    assert rows_of(again) == [("decisions/2024-01.sql", 0, 2), ("decisions/2024-02.sql", 1, 0)]
    log = statements.read_log(spark, str(tmp_path))
    assert {(r.log_file, r.hash) for r in log.collect()} == {("decisions/2024-01.sql", "h1"), ("decisions/2024-01.sql", "h2"), ("decisions/2024-02.sql", "h3")}
    assert planning_log.append_log(planning_log.export(rows.limit(0), "decisions", "2024"), str(tmp_path), "decisions", ["id"]).count() == 0


def test_snapshot_puts_keyed_rows_in_and_replaces_the_rest(spark, tmp_path):
    from lodestrata.plans import snapshot

    schema = "record_id string, parent_record_id string, title string"
    now = {"tickets": spark.createDataFrame([("A", "B", None), ("B", None, "b")], schema), "ticket_labels": spark.createDataFrame([("A", "x")], "ticket_record_id string, label string")}
    snapshot.export_snapshot(now, str(tmp_path))
    stored = {"tickets": spark.createDataFrame([("B", None, "old"), ("C", None, "c")], schema), "ticket_labels": spark.createDataFrame([("C", "y")], "ticket_record_id string, label string"), "deps": spark.createDataFrame([("d",)], "a string")}
    got = snapshot.import_snapshot(spark, str(tmp_path), stored)
    assert rows_of(got["tickets"]) == [("A", "B", None), ("B", None, "b"), ("C", None, "c")] and rows_of(got["ticket_labels"]) == [("A", "x")] and rows_of(got["deps"]) == [("d",)]


def test_single_object_and_streamed_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert sinks.single(df) == '{"x": "a", "y": null}' and sinks.single(df.limit(0)) == "null"
    with pytest.raises(ValueError):
        sinks.single(df.unionByName(df))
    assert list(sinks.stream_text(sinks.json_lines(df))) == ['{"x":"a","y":null}']


def test_one_watcher_at_a_time(tmp_path):
    from lodestrata.streaming.lock import WatchLock

    at = str(tmp_path / "lock")
    with WatchLock(at):
        with pytest.raises(RuntimeError):
            WatchLock(at).__enter__()
    (tmp_path / "lock").write_text("999999999")
    with WatchLock(at):
        pass
    assert not (tmp_path / "lock").exists()


def test_upgrade_keeps_files_and_drops_repeats(spark):
    from lodestrata.plans import planning_log

    rows = [("f", 3, "h1", 1), ("f", 1, "h2", 1), ("f", 2, "h2", 1), ("g", 1, "h2", 1), ("f", 4, None, 1)]
    df = spark.createDataFrame([(f, n, "t", "a", "{}", "1", None, h, v) for f, n, h, v in rows], "log_file string, line_no int, table_name string, key_columns string, row_json string, updated_at string, deleted_at string, hash string, canonical_version int")
    assert {(r.log_file, r.line_no, r.hash, r.canonical_version) for r in planning_log.upgraded(df, 2).collect()} == {("f", 1, "h2", 2), ("f", 2, "h1", 2), ("f", 3, None, 2), ("g", 1, "h2", 2)}


def test_unchanged_notes_are_not_read(spark, tmp_path):
    for n in ("a.md", "b.md", "c.md"):
        (tmp_path / n).write_text(n)
    full = markdown.scan(spark, str(tmp_path)).withColumn("content_hash", index.content_hash()).persist()
    stored = full.select("path", F.when(F.col("path") == "b.md", 1).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("path") == "a.md", "kept").otherwise(F.col("content_hash")).alias("content_hash")).where("path <> 'c.md'")
    got = {r.path: (r.content, r.content_hash) for r in markdown.scan_changed(spark, str(tmp_path), stored).collect()}
    hashes = {r.path: r.content_hash for r in full.collect()}
    assert got == {"a.md": (None, "kept"), "b.md": (bytearray(b"b.md"), hashes["b.md"]), "c.md": (bytearray(b"c.md"), hashes["c.md"])}

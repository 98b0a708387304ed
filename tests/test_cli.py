"""The command line over a small folder of notes."""

import json

import pytest

from lodestrata import cli


@pytest.fixture(scope="module")
def notes(tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    (root / ".obsidian").mkdir()
    (root / "a").mkdir()
    (root / "a" / "one.md").write_text("---\nn: 3\ntags: [red]\n---\n# One\n[[two]] #blue")
    (root / "a" / "two.md").write_text("---\nn: '3'\ntags: red\n---\nsee [[a/one]]")
    (root / "draft.md").write_text("x")
    (root / ".gitignore").write_text("draft*\n")
    (root / "V.base").write_text("filters: {and: ['n == 3']}\nviews: [{name: All, order: [path]}]")
    return root


def out(spark, capsys, notes, *argv):
    capsys.readouterr()
    code = cli.main([*argv, "--vault", str(notes)], spark)
    return code, capsys.readouterr().out.strip()


def test_verbs(spark, capsys, notes):
    go = lambda *argv: out(spark, capsys, notes, *argv)
    rows = lambda *argv: json.loads(go(*argv)[1])
    assert [r["path"] for r in rows("files")] == ["a/one.md", "a/two.md"]
    assert rows("query", "SELECT path WHERE fm.n = '3'") == [{"path": "a/two.md"}]
    assert rows("tags", "--sort", "count") == [{"tag": "red", "count": 2}, {"tag": "blue", "count": 1}]
    assert [r["source_path"] for r in rows("backlinks", "a/one.md")] == ["a/two.md"]
    assert [r["target_path"] for r in rows("outlinks", "a/one.md")] == ["two"]
    assert {r["section"] for r in rows("meta", "a/one.md")} == {"file", "frontmatter", "tags", "outlinks", "inlinks", "headings"}
    assert rows("schema")[0] == {"key": "n", "types": ["number", "string"], "count": 2}
    assert rows("base") == [{"name": "V", "path": str(notes / "V.base")}] and rows("base", "V", "--view", "all") == [{"path": "a/one.md"}]
    assert [r["path"] for r in rows("related", "a/one.md")] == ["a/two.md"]
    assert "signals" in rows("context", "a/one.md", "--full")[0]
    assert go("search", "two", "--oneline")[1].startswith("a/two.md\t")
    assert go("files", "--jsonl", "--fields", "path")[1].splitlines() == ['{"path":"a/one.md"}', '{"path":"a/two.md"}']


@pytest.mark.parametrize(
    ("argv", "code"),
    [(["nope"], 64), (["query"], 64), (["files", "--pretty", "--jsonl"], 64), (["backlinks"], 64), (["files", "--fields", "zz"], 64), (["query", "SELECT zz"], 65), (["meta", "no.md"], 66), (["base", "none"], 66), (["query", "SELECT path WHERE FALSE"], 0)],
)
def test_exit_codes(spark, capsys, notes, argv, code):
    assert out(spark, capsys, notes, *argv)[0] == code


def test_discovery(monkeypatch, notes):
    monkeypatch.delenv("LODESTRATA_VAULT", raising=False)
    assert cli.discover(start=str(notes / "a")) == str(notes)
    monkeypatch.setenv("LODESTRATA_VAULT", str(notes / "a"))
    assert cli.discover() == str(notes / "a")
    assert cli.discover(str(notes)) == str(notes)

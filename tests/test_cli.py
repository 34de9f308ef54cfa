"""The command line and the rule book on a small tree."""

import io
import json
import subprocess

import pytest

from tessera import cli
from tessera.sources import rulebook


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    (root / "lib").mkdir()
    (root / "app").mkdir()
    (root / "lib" / "tool.py").write_text('def helper(x):\n    """Helps."""\n    return x\n\n\ndef lonely():\n    return 1\n')
    (root / "app" / "use.py").write_text("from tool import helper\n\n\ndef work(request):\n    q = own.read()\n    own.run(q)\n    return helper(q)\n")
    (root / "requirements.txt").write_text("flask==1.0\n")
    (root / "LICENSE.md").write_text("Permission is hereby granted, free of charge, to any person\n\nMIT License\n")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    return root


def run(spark, *argv):
    out = io.StringIO()
    assert cli.main(list(argv), spark, out) == 0
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_commands(spark, tree):
    root = str(tree)
    names = {r["name"] for r in run(spark, "scan", root)}
    assert {"helper", "lonely", "work"} <= names
    assert {r["what"]: r["n"] for r in run(spark, "status", root)}["files"] == 4
    assert [r["caller_id"] for r in run(spark, "references", root, "helper")].count("app/use.py:function:work") == 1
    assert {r["id"] for r in run(spark, "impact", root, "helper")} >= {"lib/tool.py:function:helper", "app/use.py:function:work"}
    assert [r["name"] for r in run(spark, "dead", root)] == ["work"]  # what stands in an imported file counts as spoken of
    assert [(r["line"], r["code"]) for r in run(spark, "call-sites", root, "helper") if ":function:" in r["caller"]] == [(7, "return helper(q)")]
    assert run(spark, "search", root, "helper")[0]["name"] == "helper"
    assert [r["name"] for r in run(spark, "deps", root)] == ["flask"]
    assert "# Project:" in run(spark, "outline", root)[0]["text"]
    assert {r["command"] for r in run(spark, "tools", root)} == set(cli.COMMANDS)
    assert run(spark, "pr-risk", root) == []
    with pytest.raises(SystemExit):
        run(spark, "pr-risk", root, "--base", "x; rm")


def test_rules_are_kept_and_used(spark, tree):
    root = str(tree)
    assert run(spark, "taint", root) == []
    assert rulebook.add_taint_source(root, "own.read(")["status"] == "added" and rulebook.add_taint_source(root, "own.read(")["status"] == "already_exists"
    assert rulebook.add_taint_sink(root, "own.run(", "command", "critical")["status"] == "added"
    assert [(r["line"], r["category"], r["severity"]) for r in run(spark, "taint", root)] == [(6, "command", "critical")]
    assert rulebook.add_taint_sanitizer(root, "own.clean(")["status"] == "added"
    assert [len(v) for v in rulebook.list_taint_rules(root).values()] == [1, 1, 1, 0]
    assert rulebook.remove_taint_rule(root, "sink", "own.run(")["status"] == "removed" and rulebook.remove_taint_rule(root, "sink", "own.run(")["status"] == "not_found"
    assert "error" in rulebook.remove_taint_rule(root, "what", "x") and run(spark, "taint", root) == []
    assert rulebook.add_rule(root, "style", "no lonely", grep_deny=[{"pattern": "lonely", "glob": "**/*.py"}], glob_deny=["*.md"])["status"] == "added"
    assert sorted((r["path"], r.get("line")) for r in run(spark, "check", root)) == [("LICENSE.md", None), ("lib/tool.py", 6)]
    assert rulebook.remove_rule(root, "style", "no lonely")["status"] == "removed" and run(spark, "check", root) == []
    assert rulebook.add_layer(root, "app", ["app/*"], cannot_import=["lib"])["status"] == rulebook.add_layer(root, "lib", ["lib/*"])["status"] == "added"
    assert [(r["from_file"], r["to_file"], r["kind"]) for r in run(spark, "layers", root)] == [("app/use.py", "lib/tool.py", "cannot_import")]
    assert rulebook.remove_layer(root, "lib")["status"] == "removed" and run(spark, "layers", root) == []
    (tree / rulebook.NAME).write_text("no json")
    assert rulebook.load(root) == {} and run(spark, "check", root) == []

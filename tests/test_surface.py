"""Tools, server, command line, installer and SQL functions."""

import io
import json
from pathlib import Path

import pytest

from graphloom import install
from graphloom.cli import main
from graphloom.plans.graph import CodeGraph
from graphloom.plans.scratch import shared_dir
from graphloom.server import Server
from graphloom.tools import TOOLS, call_tool, register_sql

NAMES = ["search_symbols", "get_symbol", "find_callers", "find_callees", "impact", "context", "find_references", "file_outline", "neighborhood", "affected", "stats"]


@pytest.fixture()
def g(spark):
    f = [(0, "a.ts", "typescript", "h", 1, 0, 0)]
    s = [(0, 0, "loadConfig", "function", None, True, "function loadConfig()", 0, 0, 1, 0), (1, 0, "Config", "interface", None, False, None, 2, 0, 2, 0), (2, 0, "main", "function", None, False, None, 3, 0, 4, 0)]
    return CodeGraph.from_rows(spark, f, s, [(0, 0, "main", "loadConfig", "call", 3, 2), (1, 0, "main", "gone", "call", 3, 4)])


def test_every_tool_answers(g):
    assert list(TOOLS) == NAMES
    args = {"search_symbols": {"query": "config"}, "context": {"query": "config"}, "file_outline": {"path": "a.ts"}, "affected": {"files": ["a.ts"]}, "stats": {}, "find_callees": {"name": "main"}}
    text = {n: call_tool(g, n, args.get(n, {"name": "loadConfig"})) for n in NAMES}
    assert text["search_symbols"] == "interface Config — a.ts:3\nfunction export loadConfig — a.ts:1  ·  function loadConfig()"
    assert text["find_callers"] == "a.ts:4  main" and text["impact"] == "[1 hop] function main — a.ts:4"
    assert text["find_callees"] == "function export loadConfig — a.ts:1  ·  function loadConfig()"
    assert text["neighborhood"] == (
        "neighbourhood of loadConfig:\n\ndefinitions:\n  function export loadConfig — a.ts:1  ·  function loadConfig()\n  function main — a.ts:4\n\ncall edges:\n  main → loadConfig"
        "\n\nunresolved (referenced, not defined in index): gone"
    )
    assert text["context"].startswith('context for "config":\n\nmatches:\n  ') and "related (ranked by call-site centrality):\n  function main" in text["context"]
    assert text["file_outline"].count("\n") == 2 and "symbols: 3" in text["stats"]
    assert call_tool(g, "neighborhood", {"name": "q"}) == "neighbourhood of q:\n\ndefinitions:\n  (none indexed)"


@pytest.mark.parametrize("name,args", [("get_symbol", {}), ("impact", {"name": "x", "depth": 7}), ("neighborhood", {"name": "x", "depth": 6}), ("search_symbols", {"query": "x", "kind": "thing"}), ("search_symbols", {"query": "x", "limit": 501}), ("context", {"query": "x", "maxSymbols": 4}), ("affected", {"files": "a"}), ("impact", {"name": "x", "limit": True}), ("get_symbol", {"name": 3}), ("nothing", {})])
def test_wrong_arguments(name, args):
    with pytest.raises(ValueError):
        call_tool(None, name, args)


def test_server(g):
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_symbol", "arguments": {"name": "main"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get_symbol", "arguments": {}}},
        {"jsonrpc": "2.0", "id": 5, "method": "other"},
        {"jsonrpc": "2.0", "id": 6, "method": "ping"},
    ]
    out = io.StringIO()
    Server(lambda: g).serve(io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nno json\n"), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, 6, None]
    assert answers[0]["result"]["serverInfo"]["name"] == "graphloom"
    assert [t["name"] for t in answers[1]["result"]["tools"]] == NAMES and answers[1]["result"]["tools"][4]["inputSchema"]["required"] == ["name"]
    assert "a.ts:4" in answers[2]["result"]["content"][0]["text"] and answers[3]["result"]["isError"]
    assert answers[4]["error"]["code"] == -32601 and answers[6]["error"]["code"] == -32700


def test_server_keeps_no_tables(spark, g):
    """Edges are resolved once a state; what calls write, and at last the edges, are deleted."""
    folder = Path(shared_dir(spark)) / "graphloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    state = ["a"]
    server = Server(lambda: g.with_options(), lambda: state[0])
    call = lambda n, **a: server.handle({"id": 1, "method": "tools/call", "params": {"name": n, "arguments": a}})["result"]["content"][0]["text"]
    for _ in range(2):
        first = call("impact", name="loadConfig")
        left = set(folder.iterdir()) - before
        assert all(p.name.startswith("edge") for p in left)
        for n, a in (("neighborhood", {"name": "main"}), ("context", {"query": "config"}), ("affected", {"files": ["a.ts"]}), ("impact", {"name": "loadConfig"}), ("find_callees", {"name": "main"})):
            assert call(n, **a)
        assert set(folder.iterdir()) - before == left and call("impact", name="loadConfig") == first
        state[0] = "b"
    server.close()
    assert set(folder.iterdir()) == before


def test_sql_functions(spark, g):
    register_sql(g)
    assert [r["name"] for r in spark.sql("SELECT name FROM search_symbols('CONFIG') ORDER BY name").collect()] == ["Config", "loadConfig"]
    assert spark.sql("SELECT from_symbol FROM find_callers('loadConfig')").first()[0] == "main"
    assert spark.sql("SELECT t.n, s.kind FROM VALUES ('main'), ('Config') t(n), LATERAL get_symbol(t.n) s ORDER BY 1").collect()[0]["kind"] == "interface"
    assert spark.sql("SELECT name FROM find_callees('main')").first()[0] == "loadConfig"
    assert [(r["name"], r["distance"]) for r in spark.sql("SELECT * FROM impact('loadConfig')").collect()] == [("main", 1)]
    assert {(r["name"], r["distance"]) for r in spark.sql("SELECT * FROM neighborhood('main')").collect()} == {("main", 0), ("loadConfig", 1)}
    assert spark.sql("SELECT * FROM graph_stats()").first()["symbols"] == 3 and spark.sql("SELECT * FROM find_importers('x')").count() == 0
    assert [(r["name"], r["is_seed"]) for r in spark.sql("SELECT * FROM context('config') ORDER BY is_seed DESC, name").collect()] == [("Config", True), ("loadConfig", True), ("main", False)]
    assert spark.sql("SELECT * FROM impact('loadConfig', 0)").count() == 0 and spark.sql("SELECT * FROM search_symbols('o', 'function', 1)").count() == 1
    assert [tuple(r) for r in spark.sql("SELECT * FROM affected(array('a.ts'))").collect()] == [("a.ts", True, False)]
    assert spark.sql("SELECT * FROM file_outline('a.ts')").count() == 3 and spark.sql("SELECT * FROM find_references('gone')").count() == 1


def test_command_line(spark, tmp_path):
    (tmp_path / "a.py").write_text("def alpha():\n    beta()\ndef beta():\n    pass\n")
    (tmp_path / "test_a.py").write_text("import a\n")
    said = []
    run = lambda *a: (said.clear(), main([*a], out=said.append, session=spark), "\n".join(said))[2]
    root = str(tmp_path)
    assert "indexed 2, unchanged 0" in run("index", root) and "symbols: 2" in "\n".join(said)
    assert run("search", "ALPH", root) == "function alpha — a.py:1  ·  def alpha():"
    assert run("get", "beta", root).startswith("function beta") and run("callers", "beta", root) == "a.py:2  alpha"
    assert run("callees", "alpha", root).startswith("function beta") and run("impact", "beta", root).startswith("[1 hop] function alpha")
    assert "matches:" in run("context", "beta", root) and "call edges:" in run("neighborhood", "alpha", root, "--depth", "1")
    assert run("affected", "a.py", "--path", root) == "1 test file(s) affected by your changes:\n\n  test_a.py"
    assert "files:   2" in run("stats", "--memory", root)
    with pytest.raises(SystemExit):
        main(["nonsense"])
    assert "added claude" in run("install", root, "--agent", "claude")


def test_installer(tmp_path):
    assert [o.action for o in install.install(tmp_path)] == ["added", "added"]
    path = tmp_path / ".mcp.json"
    path.write_text('{"mcpServers": {"other": {"command": "x"}}, "keep": 1}')
    assert [install.install(tmp_path, ["claude"])[0].action for _ in range(2)] == ["added", "updated"]
    config = json.loads(path.read_text())
    assert config["keep"] == 1 and set(config["mcpServers"]) == {"other", "graphloom"}
    for broken in ("{no json", "[1]", '{"mcpServers": 3}'):
        path.write_text(broken)
        install.install(tmp_path, ["claude"])
        assert set(json.loads(path.read_text())["mcpServers"]) == {"graphloom"}
    assert '"mcp", "."' in install.toml_snippet()
    with pytest.raises(ValueError):
        install.install(tmp_path, ["vim"])

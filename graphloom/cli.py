"""Command line: index a tree, watch it, and ask about it."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from . import __version__, install
from .operators import lookup, render, traverse
from .plans import schema
from .plans.scratch import scratch_path
from .sources.indexer import Indexer
from .sources.store import GraphStore
from .tools import TOOLS


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="A code graph on Spark: index a source tree and ask about it.")
    p.add_argument("-v", "--version", action="version", version=__version__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--path", help="root of the tree, instead of the positional one")
    common.add_argument("--db", help="folder of the stored graph (default: <root>/.graphloom/graph)")
    common.add_argument("--memory", action="store_true", help="a temporary graph")
    common.add_argument("--kind", choices=schema.SYMBOL_KINDS)
    common.add_argument("--limit", type=int, default=None, help="most rows (default 50)")
    common.add_argument("--depth", type=int, default=None, help="hops (default 2; impact 3; affected 4)")
    common.add_argument("--agent", default="all", choices=[*install.AGENTS, "all"])
    common.add_argument("--global", dest="everywhere", action="store_true", help="the user's configuration instead of the project's")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("install", "enter the server into agents' configuration"), ("mcp", "index, watch, and serve the tools on standard input and output"), ("index", "build or refresh the stored graph"), ("watch", "index, then follow changes"), ("stats", "counts of the graph")):
        sub.add_parser(name, help=about, parents=[common]).add_argument("root", nargs="?", default=None)
    for name, about, what in (
        ("search", "find symbols by a part of their name", "query"), ("get", "definitions of an exact name", "name"), ("callers", "callers of a name", "name"), ("callees", "what a symbol calls", "name"),
        ("impact", "transitive callers", "name"), ("context", "relevant symbols for a task", "query"), ("neighborhood", "calls around a symbol", "name"),
    ):
        s = sub.add_parser(name, help=about, parents=[common])
        s.add_argument("what", metavar=what)
        s.add_argument("root", nargs="?", default=None)
    sub.add_parser("affected", help="test files affected by changed files", parents=[common]).add_argument("files", nargs="+")
    return p


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _answer(a: argparse.Namespace, g, root: Path) -> str:
    """Limits and depths are taken as given here; only the tools check them."""
    limit, depth = ({"limit": a.limit} if a.limit else {}), ({"depth": a.depth} if a.depth else {})
    text = lambda df: df.first()["text"]
    if a.command == "stats":
        return text(render.render_stats(lookup.stats(g)))
    if a.command == "search":
        return text(render.render_symbols(lookup.search_symbols(g, a.what, kind=a.kind, **limit)))
    if a.command == "get":
        return text(render.render_symbols(lookup.get_symbol(g, a.what, **limit)))
    if a.command == "callers":
        return text(render.render_callers(lookup.find_callers(g, a.what, **limit)))
    if a.command == "callees":
        return text(render.render_symbols(traverse.find_callees(g, a.what, **limit)))
    if a.command == "impact":
        return text(render.render_impact(traverse.impact(g, a.what, **depth, **limit)))
    if a.command == "context":
        return TOOLS["context"].answer(g, a.what, **({"maxSymbols": a.limit} if a.limit else {}))
    if a.command == "neighborhood":
        return TOOLS["neighborhood"].answer(g, a.what, **depth, **limit)
    files = [p if not (q := Path(p)).is_absolute() else q.relative_to(root).as_posix() for p in (x.replace("\\", "/").removeprefix("./") for x in a.files)]
    return TOOLS["affected"].answer(g, files, **depth)


def main(argv: list[str] | None = None, out: Callable[[str], None] = print, session=None) -> int:
    a = _parser().parse_args(argv)
    root = Path(a.path or getattr(a, "root", None) or ".").resolve()
    if a.command == "install":
        for o in install.install(root, None if a.agent == "all" else [a.agent], a.everywhere):
            out(f"{o.action} {o.agent}: {o.path}")
        out("For agents configured in TOML:\n" + install.toml_snippet())
        return 0
    spark = session or _session()
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        spark.conf.set("graphloom.scratch.dir", str(root / ".graphloom" / "scratch"))  # beside the tree, which executors read
    store = GraphStore(spark, None if a.memory else a.db or root / ".graphloom" / "graph")
    indexer = Indexer(store, root)
    try:
        if a.command in ("index", "watch", "mcp"):
            r = indexer.index_all()
            say = out if a.command != "mcp" else lambda t: print(t, file=sys.stderr)
            say(f"indexed {r.indexed}, unchanged {r.skipped}, removed {r.removed}, errors {len(r.errors)} in {r.duration_ms} ms")
            for e in r.errors:
                say(f"  {e['file']}: {e['error']}")
            if a.command == "index":
                out(_answer(argparse.Namespace(**{**vars(a), "command": "stats"}), store.graph(), root))
                return 0
            return _follow(a, indexer, store, say)
        indexer.ensure_indexed()
        out(_answer(a, store.graph(), root))
        return 0
    finally:
        store.close()


def _follow(a: argparse.Namespace, indexer: Indexer, store: GraphStore, say: Callable[[str], None]) -> int:
    from .server import Server
    from .streaming.changes import watch

    handle = watch(indexer, scratch_path(indexer.spark, "watch"), lambda p, what: say(f"{what} {p}"), lambda e: say(f"error: {e}"))
    try:
        if a.command == "mcp":
            server = Server(store.graph, store.state)
            server.serve(sys.stdin, sys.stdout)
            server.close()
        else:
            handle.query.awaitTermination()
    except KeyboardInterrupt:
        pass
    finally:
        handle.close()
    return 0

"""The eleven questions as tools: names, arguments, checks and answers as text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .functions.text import TEST_PATTERNS
from .operators import context as ctx
from .operators import lookup, render, traverse
from .plans import schema
from .plans.graph import CodeGraph
from .plans.scratch import cut


@dataclass(frozen=True)
class Arg:
    """An argument: its kind, whether it may be left out, the bounds of a number, the values of a choice."""

    kind: str
    about: str = ""
    optional: bool = False
    least: int | None = None
    most: int | None = None
    values: tuple | None = None

    def json_schema(self) -> dict:
        if self.kind == "strings":
            out: dict = {"type": "array", "items": {"type": "string"}}
        else:
            out = {"type": self.kind}
        out |= {k: v for k, v in (("minimum", self.least), ("maximum", self.most), ("enum", list(self.values) if self.values else None), ("description", self.about)) if v}
        return out


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    args: dict[str, Arg]
    answer: Callable[..., str]

    def json_schema(self) -> dict:
        return {"type": "object", "properties": {k: a.json_schema() for k, a in self.args.items()}, "required": [k for k, a in self.args.items() if not a.optional]}

    def checked(self, given: dict) -> dict:
        """The arguments, or a ValueError that names the first wrong one. Unknown ones are passed over."""
        out = {}
        for name, arg in self.args.items():
            v = given.get(name)
            if v is None:
                if not arg.optional:
                    raise ValueError(f"{self.name}: {name} is required")
                continue
            if arg.kind == "string" and not isinstance(v, str):
                raise ValueError(f"{self.name}: {name} must be a string")
            if arg.kind == "strings" and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
                raise ValueError(f"{self.name}: {name} must be a list of strings")
            if arg.kind == "integer" and (isinstance(v, bool) or not isinstance(v, int) or v < (arg.least or 1) or arg.most is not None and v > arg.most):
                raise ValueError(f"{self.name}: {name} must be an integer from {arg.least or 1} to {arg.most}")
            if arg.values and v not in arg.values:
                raise ValueError(f"{self.name}: {name} must be one of {', '.join(arg.values)}")
            out[name] = v
        return out


def _text(df) -> str:
    return df.first()["text"]


def _neighborhood(g: CodeGraph, name: str, depth: int = schema.NEIGHBORHOOD_DEPTH, limit: int = schema.NEIGHBORHOOD_LIMIT) -> str:
    nodes = cut(traverse.neighborhood_nodes(g, name, depth, limit).coalesce(1), "nodes")
    return _text(render.render_neighborhood(name, nodes, traverse.induced_edges(g, nodes), traverse.unresolved_names(g, nodes)))


def _context(g: CodeGraph, query: str, maxSymbols: int = schema.CONTEXT_SYMBOLS) -> str:
    seeds = cut(ctx.seeds(g, query, maxSymbols).coalesce(1), "seeds")
    more = cut(ctx.related(g, seeds, maxSymbols).coalesce(1), "related")
    edges = traverse.induced_edges(g, seeds.select("name").union(more.select("name")))
    return _text(render.render_context(query, seeds, more, edges))


def _affected(g: CodeGraph, files: list[str], depth: int = schema.AFFECTED_DEPTH) -> str:
    changed = g.files.sparkSession.createDataFrame([(f,) for f in files], "path string")
    return _text(render.render_affected(traverse.affected(g, changed, depth)))


def _number(most: int, about: str = "") -> Arg:
    return Arg("integer", about, optional=True, least=1, most=most)


_NAME, _LIMIT = Arg("string", "exact name of a symbol"), _number(500, "most rows")
TOOLS = {
    t.name: t
    for t in (
        Tool("search_symbols", "Find definitions by a part of their name, in any case. Gives kind, place and signature.", {"query": Arg("string", "part of a name"), "kind": Arg("string", "only this kind", True, values=schema.SYMBOL_KINDS), "limit": _LIMIT},
             lambda g, **a: _text(render.render_symbols(lookup.search_symbols(g, a.pop("query"), **a)))),
        Tool("get_symbol", "Definitions of an exact name.", {"name": _NAME, "limit": _LIMIT}, lambda g, **a: _text(render.render_symbols(lookup.get_symbol(g, **a)))),
        Tool("find_callers", "The symbols that call a name, by file.", {"name": _NAME, "limit": _LIMIT}, lambda g, **a: _text(render.render_callers(lookup.find_callers(g, **a)))),
        Tool("find_callees", "The definitions that a symbol's calls mean.", {"name": _NAME, "limit": _LIMIT}, lambda g, **a: _text(render.render_symbols(traverse.find_callees(g, **a)))),
        Tool("impact", "Everything that calls a symbol, directly or through others, with the number of hops.", {"name": _NAME, "depth": _number(6, "hops, 3 by default"), "limit": _number(300)},
             lambda g, **a: _text(render.render_impact(traverse.impact(g, **a)))),
        Tool("context", "What a task is about: matching symbols, and their neighbours by how often they are called.", {"query": Arg("string", "a task, feature or name"), "maxSymbols": Arg("integer", "most symbols, 30 by default", True, 5, 100)}, _context),
        Tool("find_references", "All calls and imports of a name.", {"name": _NAME, "kind": Arg("string", "only this kind", True, values=schema.REF_KINDS), "limit": _LIMIT},
             lambda g, **a: _text(render.render_refs(lookup.find_references(g, **a)))),
        Tool("file_outline", "All symbols of a file in source order.", {"path": Arg("string", "path below the root")}, lambda g, path: _text(render.render_symbols(lookup.file_outline(g, path)))),
        Tool("neighborhood", "Callers and callees of a symbol a few hops around, as a small graph.", {"name": _NAME, "depth": _number(5, "hops, 2 by default"), "limit": _number(200)}, _neighborhood),
        Tool("affected", "Test files that a change of some files may affect.", {"files": Arg("strings", "paths of changed files"), "depth": _number(6)}, _affected),
        Tool("stats", "Counts of files, symbols and references, by kind and language.", {}, lambda g: _text(render.render_stats(lookup.stats(g)))),
    )
}


def call_tool(g: CodeGraph, name: str, args: dict | None = None) -> str:
    """The answer of a tool; ValueError for an unknown tool or a wrong argument, before anything is planned."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    return TOOLS[name].answer(g, **TOOLS[name].checked(args or {}))


def register_sql(g: CodeGraph) -> None:
    """Views cg_files, cg_symbols, cg_refs, cg_edges and cg_imports, and table functions named after the tools.

    Arguments have the tools' defaults. A function cannot cut lineage between
    levels, so walks are written out: impact and affected for up to 3 hops (by
    default), neighborhood for up to 2; the tools and DataFrame operators go further.
    """
    spark = g.files.sparkSession
    for name, df in (
        ("cg_files", g.files), ("cg_symbols", g.definitions), ("cg_refs", g.located_refs), ("cg_resolved", g.resolved_calls),
        ("cg_edges", g.edges), ("cg_edge_files", g.edge_files), ("cg_imports", traverse.import_edges(g)), ("cg_stats", lookup.stats(g)), ("cg_sites", lookup.centrality(g)),
    ):
        df.createOrReplaceTempView(name)
    columns = lambda *given: ", ".join(given)
    sym, ref = columns(*lookup.SYMBOL_COLUMNS), columns(*lookup.REF_COLUMNS)
    of_s = columns(*(f"s.{c}" for c in lookup.SYMBOL_COLUMNS))
    sym_types = "symbol_id BIGINT, path STRING, name STRING, kind STRING, container STRING, exported BOOLEAN, signature STRING, start_row INT, start_col INT, end_row INT, end_col INT"
    ref_types = "path STRING, from_symbol STRING, name STRING, kind STRING, start_row INT, start_col INT"
    fits = "(r.kind = 'call' AND s.kind = 'function' OR r.kind = 'method' AND s.kind = 'method')"

    def levels(root: str, depth: int, step: str) -> str:
        """reached(name, d): names by levels, each without those of the levels before. step joins a level p to the next name."""
        out = [f"l0 AS (SELECT {root} AS name, 0 AS d)"]
        for d in range(1, depth + 1):
            before = " UNION ALL ".join(f"SELECT name FROM l{k}" for k in range(d))
            out.append(f"l{d} AS (SELECT DISTINCT n.name, {d} AS d FROM ({step.format(level=f'l{d - 1}')}) n LEFT ANTI JOIN ({before}) b ON b.name = n.name)")
        return ", ".join([*out, "reached AS (" + " UNION ALL ".join(f"SELECT name, d FROM l{k}" for k in range(depth + 1)) + ")"])

    callers = "SELECT e.src AS name FROM {level} p JOIN cg_edges e ON e.dst = p.name"
    near = callers + " UNION ALL SELECT e.dst AS name FROM {level} p JOIN cg_edges e ON e.src = p.name"

    def first(rows: str, order: str, limit: str, columns: str = sym) -> str:
        return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS nth FROM ({rows})) WHERE nth <= {limit}"

    place = "path, start_row, symbol_id"
    low, q = "lower(name)", "lower(search_symbols.query)"
    found = f"SELECT * FROM cg_symbols WHERE contains({low}, {q}) AND (search_symbols.of_kind IS NULL OR kind = search_symbols.of_kind)"
    match = f"CASE WHEN {low} = {q} THEN 0 WHEN startswith({low}, {q}) THEN 1 ELSE 2 END, length(name), name, {place}"
    reached = lambda root: (
        f"{levels(root, 3, callers)}, hit AS (SELECT DISTINCT a.name, a.d, e.file_id FROM reached a JOIN cg_edge_files e ON e.src = a.name JOIN reached b ON b.name = e.dst AND b.d = a.d - 1)"
    )
    tokens = "array_distinct(filter(split(lower(context.query), '[^a-z0-9_$]+'), t -> length(t) >= 2))"
    related = (
        f"WITH scored AS (SELECT s.*, coalesce(c.sites, 0L) AS sites, size(filter({tokens}, t -> contains(lower(s.name), t))) AS held, array_contains({tokens}, lower(s.name)) AS exact "
        "FROM cg_symbols s LEFT JOIN cg_sites c ON c.name = s.name), "
        f"seeds AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY held DESC, exact DESC, sites DESC, name, {place}) AS nth FROM scored WHERE held > 0) WHERE nth <= ceil(context.most / 2)), "
        "near AS (SELECT e.dst AS name FROM cg_edges e LEFT SEMI JOIN seeds ON seeds.name = e.src UNION SELECT e.src FROM cg_edges e LEFT SEMI JOIN seeds ON seeds.name = e.dst), "
        "beside AS (SELECT s.* FROM scored s LEFT SEMI JOIN near ON near.name = s.name LEFT ANTI JOIN seeds ON seeds.name = s.name), "
        f"ranked AS (SELECT *, row_number() OVER (ORDER BY sites DESC, name, {place}) AS at FROM beside) "
        f"SELECT {sym}, sites, TRUE FROM seeds UNION ALL SELECT {sym}, sites, FALSE FROM ranked WHERE at <= context.most - (SELECT count(*) FROM seeds)"
    )
    # as in traverse.affected_callers(); a step refers to the one before once, since Spark writes out each reference
    def steps(name: str, first: str, keys: str, depth: int) -> str:
        """name0 .. name<depth>: least distances of names, by keys, from those of first on."""
        out = [f"{name}0 AS ({first})"]
        for d in range(1, depth + 1):
            mine, next_ = keys.replace("root", "p.root").replace("name", "p.name"), keys.replace("root", "p.root").replace("name", "e.src")
            rows = f"SELECT stack(2, {mine}, p.d, {next_}, p.d + 1) AS ({keys}, d) FROM {name}{d - 1} p LEFT JOIN cg_edges e ON e.dst = p.name"
            out.append(f"{name}{d} AS (SELECT {keys}, min(d) AS d FROM ({rows}) WHERE name IS NOT NULL GROUP BY {keys})")
        return ", ".join(out)

    own = "cg_symbols s LEFT SEMI JOIN given ON given.path = s.path WHERE s.name IS NOT NULL"
    calls = (
        "FROM cg_edge_files e LEFT SEMI JOIN cg_symbols s ON s.name = e.src AND s.file_id = e.file_id JOIN n3 b ON b.name = e.dst JOIN n3 a ON a.name = e.src "
        "WHERE e.src <> e.dst AND b.d < affected.hops"
    )
    ctes = [
        "given AS (SELECT DISTINCT explode(affected.changed) AS path)",
        steps("n", f"SELECT DISTINCT s.name, 0 AS d FROM {own}", "name", 3),
        steps("r", f"SELECT DISTINCT s.name AS root, s.name, 0 AS d FROM {own}", "root, name", 2),
        f"plain AS (SELECT DISTINCT e.file_id {calls} AND (a.d > b.d OR b.d = 0))",
        f"left_open AS (SELECT o.* FROM (SELECT e.src, e.dst, e.file_id {calls} AND a.d <= b.d AND b.d > 0) o LEFT ANTI JOIN plain ON plain.file_id = o.file_id)",
        "ahead AS (SELECT o.src, o.file_id, r.root, r.d FROM left_open o JOIN r2 r ON r.name = o.dst WHERE r.d < affected.hops)",
        "tight AS (SELECT DISTINCT h.file_id FROM ahead h LEFT ANTI JOIN r2 r ON r.root = h.root AND r.name = h.src AND r.d <= h.d)",
        "called AS (SELECT DISTINCT f.path FROM (SELECT file_id FROM plain UNION ALL SELECT file_id FROM tight) c JOIN cg_files f ON f.file_id = c.file_id)",
        "i0 AS (SELECT path FROM given)",
    ]
    for d in range(1, 4):
        imports = "(SELECT m.* FROM cg_imports m LEFT ANTI JOIN called c ON c.path = m.path WHERE m.basename <> '')"
        importer = f"if(affected.hops >= {d}, m.path, NULL)"
        rows = f"SELECT explode(array(p.path, {importer})) AS path FROM i{d - 1} p LEFT JOIN {imports} m ON m.basename = split_part(substring_index(p.path, '/', -1), '.', 1)"
        ctes.append(f"i{d} AS (SELECT DISTINCT path FROM ({rows}) WHERE path IS NOT NULL)")
    spread = "SELECT path FROM called UNION SELECT path FROM i3"
    is_test = " OR ".join(f"path RLIKE r'{p}'" for p in TEST_PATTERNS)
    affected = f"WITH {', '.join(ctes)} SELECT path, array_contains(affected.changed, path), {is_test} FROM ({spread})"
    for signature, types, body in (
        (f"search_symbols(query STRING, of_kind STRING DEFAULT NULL, most INT DEFAULT {schema.LIMIT})", sym_types, first(found, match, "search_symbols.most")),
        (f"get_symbol(wanted STRING, most INT DEFAULT {schema.LIMIT})", sym_types, first("SELECT * FROM cg_symbols WHERE name = get_symbol.wanted", place, "get_symbol.most")),
        ("file_outline(file STRING)", sym_types, f"SELECT {sym} FROM cg_symbols WHERE path = file_outline.file"),
        (f"find_references(wanted STRING, of_kind STRING DEFAULT NULL, most INT DEFAULT {schema.LIMIT})", ref_types,
         first("SELECT * FROM cg_refs WHERE name = find_references.wanted AND (find_references.of_kind IS NULL OR kind = find_references.of_kind)", "path, start_row, start_col, kind", "find_references.most", ref)),
        (f"find_callers(wanted STRING, most INT DEFAULT {schema.LIMIT})", ref_types,
         first("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, from_symbol ORDER BY start_row, start_col) AS of_caller FROM cg_refs WHERE kind IN ('call', 'method') AND name = find_callers.wanted) WHERE of_caller = 1", "path, start_row, start_col", "find_callers.most", ref)),
        (f"find_callees(caller STRING, most INT DEFAULT {schema.LIMIT})", sym_types, first(f"SELECT DISTINCT {of_s} FROM cg_resolved r JOIN cg_symbols s ON s.name = r.dst AND {fits} WHERE r.src = find_callees.caller", place, "find_callees.most")),
        ("find_importers(module STRING)", "path STRING", "SELECT DISTINCT path FROM cg_imports WHERE basename = find_importers.module AND basename <> ''"),
        ("graph_stats()", "files BIGINT, symbols BIGINT, refs BIGINT, by_kind MAP<STRING, BIGINT>, by_lang MAP<STRING, BIGINT>", "SELECT files, symbols, refs, by_kind, by_lang FROM cg_stats"),
        ("impact(root STRING, hops INT DEFAULT 3)", f"{sym_types}, distance INT",
         f"WITH {reached('impact.root')} SELECT {of_s}, hit.d FROM hit JOIN cg_symbols s ON s.name = hit.name AND s.file_id = hit.file_id WHERE hit.d <= impact.hops"),
        ("neighborhood(root STRING, hops INT DEFAULT 2)", f"{sym_types}, distance INT", f"WITH {levels('neighborhood.root', 2, near)} SELECT {of_s}, r.d FROM reached r JOIN cg_symbols s ON s.name = r.name WHERE r.d <= neighborhood.hops"),
        (f"context(query STRING, most INT DEFAULT {schema.CONTEXT_SYMBOLS})", f"{sym_types}, sites BIGINT, is_seed BOOLEAN", related),
        ("affected(changed ARRAY<STRING>, hops INT DEFAULT 3)", "path STRING, is_changed BOOLEAN, is_test BOOLEAN", affected),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE({types}) RETURN {body}")

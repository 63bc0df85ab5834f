"""The registered queries over the derived code graph, and the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import TEST_PATTERNS, clipped, is_test_file, module_basename, symbol_line, token_estimate
from .operators import context as ctx
from .operators import evaluate, lookup, render, traverse, trigram
from .plans.derive import oracle
from .plans.graph import CodeGraph
from .plans.scratch import cut

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def keep(f, name=name):
        name = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(CodeGraph.from_testdata(spark, sf_dir))

        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def root(g: CodeGraph) -> str:
    """The name with the most callers."""
    top = g.edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return top["dst"] if top else ""


def top_name(g: CodeGraph) -> str:
    """The same without writing the edges, for questions that do not walk."""
    top = g.resolved_calls.select("src", "dst").distinct().groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return top["dst"] if top else ""


def caller_root(g: CodeGraph) -> str:
    """The name that calls the most names."""
    top = g.resolved_calls.select("src", "dst").distinct().groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return top["src"] if top else ""


SYM = "symbol_id, path, name, kind, container, exported, signature, start_row, start_col, end_row, end_col"
REF = "path, from_symbol, name, kind, start_row, start_col"


def _search(query: str, kind: str | None = None, limit: int = 50) -> str:
    q = query.lower()
    only = f" AND kind = '{kind}'" if kind else ""
    return oracle(
        ["defs"],
        f"SELECT {SYM} FROM defs WHERE contains(lower(name), '{q}'){only} "
        f"ORDER BY CASE WHEN lower(name) = '{q}' THEN 0 WHEN starts_with(lower(name), '{q}') THEN 1 ELSE 2 END, length(name), name, path, start_row, symbol_id LIMIT {limit}",
    )


@_query(_search("WIDGET_2"))
def search_substring(g):
    return lookup.search_symbols(g, "WIDGET_2")


@_query(_search("re", "method", 500))
def search_kind(g):
    return lookup.search_symbols(g, "re", kind="method", limit=500)


@_query(_search("_2"))
def search_literal_wildcard(g):
    return lookup.search_symbols(g, "_2")


@_query(_search("Ring_2"))
def search_by_trigrams(g):
    return trigram.search(g, trigram.build(g.symbols), "Ring_2")


@_query(oracle(["cg_symbols"], "SELECT tri, count(*) AS symbols FROM (SELECT DISTINCT symbol_id, substr(lower(name), CAST(i AS BIGINT), 3) AS tri FROM cg_symbols, unnest(range(1, length(name) - 1)) AS r(i)) GROUP BY tri"))
def trigram_frequencies(g):
    return trigram.build(g.symbols).groupBy("tri").agg(F.count("*").alias("symbols"))


@_query(oracle(["defs", "root"], f"SELECT {SYM} FROM defs WHERE name = (SELECT name FROM root) ORDER BY path, start_row, symbol_id LIMIT 50"))
def get_symbol(g):
    return lookup.get_symbol(g, top_name(g))


@_query(oracle(["located", "root"], f"SELECT {REF} FROM located WHERE name = (SELECT name FROM root)"))
def find_references(g):
    return lookup.find_references(g, top_name(g), limit=None)


@_query(oracle(["located"], f"SELECT {REF} FROM located WHERE name = '../src/m1' AND kind = 'import'"))
def find_import_references(g):
    return lookup.find_references(g, "../src/m1", kind="import", limit=None)


@_query(oracle(["defs"], f"SELECT {SYM} FROM defs WHERE path = (SELECT path FROM cg_files WHERE file_id = 3)"))
def file_outline(g):
    return lookup.file_outline(g, g.files.where("file_id = 3").first()["path"])


_CALLERS = """callers AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, from_symbol ORDER BY start_row, start_col, kind) AS nth
                 FROM located WHERE kind IN ('call', 'method') AND name = (SELECT name FROM root)) WHERE nth = 1)"""


@_query(oracle(["located", "root"], f"SELECT {REF} FROM callers", _CALLERS))
def find_callers(g):
    return lookup.find_callers(g, top_name(g), limit=None)


@_query(
    oracle(
        ["located", "root"],
        "SELECT path, min(start_row) + 1 AS line, CAST(count(DISTINCT coalesce(from_symbol, '(top level)')) AS BIGINT) AS callers FROM callers GROUP BY path",
        _CALLERS,
    )
)
def callers_by_file(g):
    rows = lookup.find_callers(g, top_name(g), limit=None)
    who = F.countDistinct(F.coalesce("from_symbol", F.lit("(top level)")))
    return rows.groupBy("path").agg((F.min("start_row") + 1).alias("line"), who.alias("callers"))


@_query(
    oracle(
        ["resolved", "caller_root", "defs"],
        f"SELECT DISTINCT {SYM} FROM (SELECT DISTINCT dst, kind AS ref_kind FROM resolved WHERE src = (SELECT name FROM caller_root)) c "
        "JOIN defs d ON d.name = c.dst AND d.kind = CASE c.ref_kind WHEN 'call' THEN 'function' ELSE 'method' END",
    )
)
def find_callees(g):
    return traverse.find_callees(g, caller_root(g), limit=None)


@_query(oracle(["edges"], "SELECT src, dst FROM edges"))
def resolved_edges(g):
    return g.resolved_calls.select("src", "dst").distinct()


@_query(
    oracle(
        ["cg_symbols"],
        "SELECT name, CASE kind WHEN 'function' THEN 'call' ELSE 'method' END AS ref_kind, count(*) AS n_defs FROM cg_symbols "
        "WHERE kind IN ('function', 'method') GROUP BY 1, 2 HAVING count(*) > 4",
    )
)
def ambiguous_names(g):
    return g.resolvable.where(F.col("n_defs") > g.ambiguity_cap)


@_query(
    oracle(
        ["cg_refs", "cg_symbols"],
        "SELECT DISTINCT r.from_symbol AS src, r.name AS dst FROM cg_refs r JOIN "
        "(SELECT name, ref_kind, count(*) AS n FROM ("
        "SELECT name, 'call' AS ref_kind FROM cg_symbols WHERE kind IN ('function', 'class') UNION ALL "
        "SELECT name, 'method' FROM cg_symbols WHERE kind = 'method' OR (kind = 'function' AND container IS NOT NULL)) GROUP BY 1, 2) d "
        "ON d.name = r.name AND d.ref_kind = r.kind WHERE d.n <= 4 AND r.from_symbol IS NOT NULL",
    )
)
def lenient_edges(g):
    return g.with_options(resolution="lenient").resolved_calls.select("src", "dst").distinct()


@_query(oracle(["cg_refs"], "SELECT name, count(*) AS sites FROM cg_refs WHERE kind IN ('call', 'method') GROUP BY name"))
def centrality(g):
    return lookup.centrality(g)


@_query(
    oracle(
        ["cg_refs", "cg_symbols"],
        "SELECT s.name, count(r.name) AS callers FROM cg_symbols s LEFT JOIN cg_refs r ON r.name = s.name AND r.kind IN ('call', 'method') "
        "WHERE s.kind IN ('function', 'method') AND length(s.name) >= 4 GROUP BY s.name ORDER BY callers DESC, s.name LIMIT 20",
    )
)
def popularity_topk(g):
    return lookup.popularity(g, 20)


@_query(oracle(["cg_symbols"], "SELECT DISTINCT name FROM cg_symbols ORDER BY name LIMIT 5000"))
def distinct_names(g):
    return lookup.distinct_names(g, 5000)


@_query(oracle(["defs"], f"SELECT {SYM} FROM defs"))
def symbols_join_files(g):
    return g.definitions.select(*lookup.SYMBOL_COLUMNS)


def _bfs(depth: int, start: str = "root") -> str:
    return f"""walk(name, d) AS (
  SELECT name, 0 FROM {start} UNION SELECT e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.name WHERE w.d < {depth}),
reached AS (SELECT name, min(d) AS d FROM walk GROUP BY name),
hit AS (SELECT DISTINCT a.name, a.d, r.file_id FROM reached a JOIN resolved r ON r.src = a.name JOIN reached b ON b.name = r.dst AND b.d = a.d - 1 WHERE a.d > 0),
impacted AS (SELECT s.*, CAST(h.d AS INT) AS distance FROM hit h JOIN defs s ON s.name = h.name AND s.file_id = h.file_id)"""


@_query(oracle(["resolved", "edges", "root", "defs"], f"SELECT {SYM}, distance FROM impacted", _bfs(3), recursive=True))
def impact_d3(g):
    return traverse.impact(g, root(g), 3, limit=None)


@_query(oracle(["resolved", "edges", "root", "defs"], f"SELECT {SYM}, distance FROM impacted ORDER BY distance, path, start_row, symbol_id LIMIT 100", _bfs(6), recursive=True))
def impact_d6_limited(g):
    return traverse.impact(g, root(g), 6)


@_query(oracle(["resolved", "edges", "root", "defs"], f"SELECT {SYM}, distance FROM impacted", _bfs(3), recursive=True))
def impact_sql_function(g):
    from .tools import register_sql

    register_sql(g)
    return g.files.sparkSession.sql("SELECT * FROM impact(:root)", {"root": root(g)})


@_query(oracle(["resolved", "edges", "root", "defs"], "SELECT CAST(d AS INT) AS distance, count(*) AS names FROM reached WHERE d > 0 GROUP BY d", _bfs(6), recursive=True))
def impact_by_distance(g):
    found = traverse.bfs(traverse.roots_of(g.symbols.sparkSession, [root(g)]), g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 6)
    return found.where("distance > 0").groupBy("distance").agg(F.count("*").alias("names"))


_MANY = """top_roots AS (SELECT dst AS root FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 25),
walk(root, name, d) AS (
  SELECT root, root, 0 FROM top_roots UNION SELECT w.root, e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.name WHERE w.d < 3),
reached AS (SELECT root, name, min(d) AS d FROM walk GROUP BY root, name)"""


@_query(oracle(["edges"], "SELECT root, CAST(d AS INT) AS distance, count(*) AS names FROM reached WHERE d > 0 GROUP BY root, d", _MANY, recursive=True))
def impact_batched(g):
    roots = g.edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(25).select(F.col("dst").alias("root"))
    found = traverse.bfs(roots, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 3)
    return found.where("distance > 0").groupBy("root", "distance").agg(F.count("*").alias("names"))


_NEAR = """both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
walk(name, d) AS (SELECT name, 0 FROM root UNION SELECT e.dst, w.d + 1 FROM walk w JOIN both_ways e ON e.src = w.name WHERE w.d < 2),
nodes AS (SELECT s.*, CAST(w.d AS INT) AS distance FROM (SELECT name, min(d) AS d FROM walk GROUP BY name) w JOIN defs s ON s.name = w.name
          ORDER BY w.d, s.path, s.start_row, s.symbol_id LIMIT 50)"""


@_query(oracle(["edges", "root", "defs"], f"SELECT {SYM}, distance FROM nodes", _NEAR, recursive=True))
def neighborhood_nodes(g):
    return traverse.neighborhood_nodes(g, root(g))


@_query(oracle(["edges", "root", "defs"], "SELECT src, dst FROM edges WHERE src IN (SELECT name FROM nodes) AND dst IN (SELECT name FROM nodes)", _NEAR, recursive=True))
def neighborhood_edges(g):
    return traverse.induced_edges(g, cut(traverse.neighborhood_nodes(g, root(g)), "nodes"))


@_query(
    oracle(
        ["edges", "root", "defs", "cg_refs"],
        "SELECT DISTINCT name FROM cg_refs WHERE kind IN ('call', 'method') AND from_symbol IN (SELECT name FROM nodes) AND name NOT IN (SELECT name FROM cg_symbols)",
        _NEAR,
        recursive=True,
    )
)
def neighborhood_unresolved(g):
    return traverse.unresolved_names(g, cut(traverse.neighborhood_nodes(g, root(g)), "nodes"))


_IS_TEST = " OR ".join(f"regexp_matches(path, '{p.removeprefix('(?i)')}', 'i')" for p in TEST_PATTERNS)
_BASENAME = "split_part(regexp_extract(path, '[^/]*$'), '.', 1)"


@_query(oracle(["cg_files"], f"SELECT path, {_IS_TEST} AS is_test FROM cg_files"), name="is_test_file")
def _is_test_file(g):
    return g.files.select("path", is_test_file("path").alias("is_test"))


@_query(oracle(["cg_files"], f"SELECT path, {_BASENAME} AS basename FROM cg_files"), name="module_basename")
def _module_basename(g):
    return g.files.select("path", module_basename("path").alias("basename"))


_IMPORTS = "imports AS (SELECT DISTINCT path AS importer, regexp_extract(name, '[^/]*$') AS basename FROM located WHERE kind = 'import')"


@_query(oracle(["located"], "SELECT DISTINCT importer AS path FROM imports WHERE basename = 'm1'", _IMPORTS))
def find_importers(g):
    return traverse.find_importers(g, "m1")


@_query(oracle(["located"], "SELECT basename, count(*) AS importers FROM imports GROUP BY basename", _IMPORTS))
def importers_by_module(g):
    return traverse.import_edges(g).groupBy("basename").agg(F.count("*").alias("importers"))


@_query(oracle(["cg_files"], "SELECT path FROM cg_files WHERE path = 'nothing'"))
def find_importers_of_nothing(g):
    return traverse.find_importers(g, "")


def _changed(g) -> DataFrame:
    return g.files.where("file_id % 50 = 1").select("path")


_AFFECTED = f"""changed AS (SELECT path FROM cg_files WHERE file_id % 50 = 1),
own AS (SELECT DISTINCT name FROM defs WHERE path IN (SELECT path FROM changed)),
walk(root, name, d) AS (SELECT name, name, 0 FROM own UNION SELECT w.root, e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.name WHERE w.d < 4),
reached AS (SELECT root, name, min(d) AS d FROM walk GROUP BY root, name),
callers AS (SELECT DISTINCT f.path FROM reached a JOIN resolved r ON r.src = a.name JOIN reached b ON b.root = a.root AND b.name = r.dst AND b.d = a.d - 1
            JOIN cg_symbols s ON s.name = a.name AND s.file_id = r.file_id JOIN cg_files f ON f.file_id = r.file_id WHERE a.d > 0),
seen AS (SELECT path FROM changed UNION SELECT path FROM callers),
{_IMPORTS},
spread(path, d) AS (SELECT path, 0 FROM changed UNION
                    SELECT i.importer, s.d + 1 FROM spread s JOIN imports i ON i.basename = {_BASENAME.replace("path", "s.path")}
                    WHERE s.d < 4 AND i.importer NOT IN (SELECT path FROM seen)),
affected AS (SELECT path FROM seen UNION SELECT path FROM spread)"""
_AFFECTED_NEEDS = ["defs", "edges", "resolved", "located"]


@_query(oracle(_AFFECTED_NEEDS, f"SELECT path, path IN (SELECT path FROM changed) AS is_changed, {_IS_TEST} AS is_test FROM affected", _AFFECTED, recursive=True))
def affected_files(g):
    return traverse.affected(g, _changed(g))


@_query(oracle(_AFFECTED_NEEDS, f"SELECT path FROM affected WHERE {_IS_TEST}", _AFFECTED, recursive=True))
def affected_tests(g):
    return traverse.affected(g, _changed(g)).where("is_test").select("path")


@_query(
    oracle(
        ["located"],
        "SELECT path, CAST(min(d) AS INT) AS distance FROM spread GROUP BY path",
        "changed AS (SELECT path FROM cg_files WHERE file_id % 50 = 1), " + _IMPORTS + f""",
spread(path, d) AS (SELECT path, 0 FROM changed UNION
                    SELECT i.importer, s.d + 1 FROM spread s JOIN imports i ON i.basename = {_BASENAME.replace("path", "s.path")} WHERE s.d < 4)""",
        recursive=True,
    )
)
def import_bfs(g):
    from_base = traverse.import_edges(g)
    target = g.files.select(F.col("path").alias("src"), module_basename("path").alias("basename"))
    edges = cut(target.join(from_base, "basename").select("src", F.col("path").alias("dst")).distinct(), "imports")
    one = _changed(g).select(F.col("path").alias("root"))
    found = traverse.bfs(one, edges, 4)
    return found.groupBy(F.col("name").alias("path")).agg(F.min("distance").alias("distance"))


_SEEDS = """scored AS (
  SELECT d.*, (CASE WHEN contains(lower(name), 'red') THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), 'late') THEN 1 ELSE 0 END) AS held,
         lower(name) IN ('red', 'late') AS exact, coalesce((SELECT count(*) FROM cg_refs r WHERE r.name = d.name AND r.kind IN ('call', 'method')), 0) AS sites
  FROM defs d),
seeds AS (SELECT * FROM scored WHERE held > 0 ORDER BY held DESC, exact DESC, sites DESC, name, path, start_row, symbol_id LIMIT 15)"""


@_query(oracle(["defs", "cg_refs"], f"SELECT {SYM}, CAST(held AS INT) AS held, CAST(sites AS BIGINT) AS sites FROM seeds", _SEEDS))
def context_seeds(g):
    return ctx.seeds(g, "the red, late!")


@_query(
    oracle(
        ["defs", "cg_refs", "edges"],
        f"SELECT {SYM}, CAST(sites AS BIGINT) AS sites FROM scored WHERE name IN (SELECT dst FROM edges WHERE src IN (SELECT name FROM seeds) UNION "
        "SELECT src FROM edges WHERE dst IN (SELECT name FROM seeds)) AND name NOT IN (SELECT name FROM seeds) "
        "ORDER BY sites DESC, name, path, start_row, symbol_id LIMIT (SELECT 30 - count(*) FROM seeds)",
        _SEEDS,
    )
)
def context_related(g):
    return ctx.related(g, cut(ctx.seeds(g, "red late"), "seeds"))


_RELATED = _SEEDS + """,
related AS (SELECT * FROM scored WHERE name IN (SELECT dst FROM edges WHERE src IN (SELECT name FROM seeds) UNION
              SELECT src FROM edges WHERE dst IN (SELECT name FROM seeds)) AND name NOT IN (SELECT name FROM seeds)
            ORDER BY sites DESC, name, path, start_row, symbol_id LIMIT (SELECT 30 - count(*) FROM seeds)),
chosen AS (SELECT name FROM seeds UNION SELECT name FROM related),
among AS (SELECT src, dst FROM edges WHERE src IN (SELECT name FROM chosen) AND dst IN (SELECT name FROM chosen))"""


@_query(oracle(["defs", "cg_refs", "edges"], "SELECT src, dst FROM among", _RELATED))
def context_edges(g):
    seeds = cut(ctx.seeds(g, "red late"), "seeds")
    return traverse.induced_edges(g, seeds.select("name").union(cut(ctx.related(g, seeds), "related").select("name")))


@_query(oracle(["cg_files", "cg_symbols", "cg_refs"], "SELECT (SELECT count(*) FROM cg_files) AS files, (SELECT count(*) FROM cg_symbols) AS symbols, (SELECT count(*) FROM cg_refs) AS refs"))
def stats_totals(g):
    return lookup.stats(g).select("files", "symbols", "refs")


@_query(oracle(["cg_symbols"], "SELECT kind, count(*) AS n FROM cg_symbols GROUP BY kind"))
def stats_by_kind(g):
    return lookup.stats(g).select(F.explode("by_kind").alias("kind", "n"))


@_query(oracle(["cg_files"], "SELECT lang, count(*) AS n FROM cg_files GROUP BY lang"))
def stats_by_lang(g):
    return lookup.stats(g).select(F.explode("by_lang").alias("lang", "n"))


_LINE = (
    "kind || ' ' || CASE WHEN exported THEN 'export ' ELSE '' END || CASE WHEN coalesce(container, '') = '' THEN '' ELSE container || '.' END || name || ' — ' || path || ':' || "
    "CAST(start_row + 1 AS VARCHAR) || CASE WHEN coalesce(signature, '') = '' THEN '' ELSE '  ·  ' || CASE WHEN length(signature) > 88 THEN substr(signature, 1, 87) || '…' ELSE signature END END"
)


@_query(oracle(["defs"], f"SELECT symbol_id, {_LINE} AS line FROM defs"))
def symbol_lines(g):
    return g.definitions.select("symbol_id", symbol_line().alias("line"))


@_query(oracle(["defs"], f"SELECT coalesce(string_agg(line, chr(10) ORDER BY path, start_row, symbol_id), 'No matching symbols.') AS text FROM (SELECT {_LINE} AS line, * FROM defs WHERE name = 'nothing_at_all')"))
def render_nothing(g):
    return render.render_symbols(lookup.get_symbol(g, "nothing_at_all"))


@_query(oracle(["defs"], f"SELECT string_agg(line, chr(10) ORDER BY start_row, start_col, symbol_id) AS text FROM (SELECT {_LINE} AS line, * FROM defs WHERE path = (SELECT path FROM cg_files WHERE file_id = 3))"))
def render_symbols(g):
    return render.render_symbols(lookup.file_outline(g, g.files.where("file_id = 3").first()["path"]))


@_query(
    oracle(
        ["located", "root"],
        "SELECT string_agg(path || ':' || CAST(line AS VARCHAR) || '  ' || who, chr(10) ORDER BY path) AS text FROM ("
        "SELECT path, min(row) + 1 AS line, string_agg(who, ', ' ORDER BY row, col, kind, who) AS who FROM ("
        "SELECT path, coalesce(from_symbol, '(top level)') AS who, start_row AS row, start_col AS col, kind FROM callers) GROUP BY path)",
        _CALLERS,
    )
)
def render_callers(g):
    return render.render_callers(lookup.find_callers(g, top_name(g), limit=None))


@_query(
    oracle(
        ["located", "root"],
        "SELECT string_agg(path || ':' || CAST(start_row + 1 AS VARCHAR) || '  ' || coalesce(from_symbol, '(top level)'), chr(10) "
        "ORDER BY path, start_row, start_col, name, kind, from_symbol NULLS FIRST) AS text FROM located WHERE name = (SELECT name FROM root)",
    )
)
def render_refs(g):
    return render.render_refs(lookup.find_references(g, top_name(g), limit=None))


@_query(
    oracle(
        ["resolved", "edges", "root", "defs"],
        f"SELECT string_agg('[' || CAST(distance AS VARCHAR) || ' hop] ' || line, chr(10) ORDER BY distance, path, start_row, symbol_id) AS text FROM "
        f"(SELECT {_LINE} AS line, * FROM impacted ORDER BY distance, path, start_row, symbol_id LIMIT 100)",
        _bfs(2),
        recursive=True,
    )
)
def render_impact(g):
    return render.render_impact(traverse.impact(g, root(g), 2))


def _section(title: str, lines: str, order: str, source: str) -> str:
    return f"coalesce((SELECT chr(10) || chr(10) || '{title}' || string_agg({lines}, chr(10) ORDER BY {order}) FROM {source}), '')"


_CALL_EDGES = lambda source: _section("call edges:' || chr(10) || '", "'  ' || src || ' → ' || dst", "src, dst", source)


@_query(
    oracle(
        ["edges", "root", "defs", "cg_refs"],
        "SELECT 'neighbourhood of ' || (SELECT name FROM root) || ':' || "
        + _section("definitions:' || chr(10) || '", "'  ' || line", "distance, path, start_row, symbol_id", f"(SELECT {_LINE} AS line, * FROM nodes)")
        + " || " + _CALL_EDGES("(SELECT * FROM edges WHERE src IN (SELECT name FROM nodes) AND dst IN (SELECT name FROM nodes))")
        + " || coalesce((SELECT chr(10) || chr(10) || 'unresolved (referenced, not defined in index): ' || string_agg(name, ', ' ORDER BY name) FROM "
        "(SELECT DISTINCT name FROM cg_refs WHERE kind IN ('call', 'method') AND from_symbol IN (SELECT name FROM nodes) AND name NOT IN (SELECT name FROM cg_symbols))), '') AS text",
        _NEAR,
        recursive=True,
    )
)
def render_neighborhood(g):
    name = root(g)
    nodes = cut(traverse.neighborhood_nodes(g, name).coalesce(1), "nodes")
    return render.render_neighborhood(name, nodes, traverse.induced_edges(g, nodes), traverse.unresolved_names(g, nodes))


@_query(
    oracle(
        ["defs", "cg_refs", "edges"],
        "SELECT 'context for \"red late\":' || "
        + _section("matches:' || chr(10) || '", "'  ' || line", "held DESC, exact DESC, sites DESC, name, path, start_row, symbol_id", f"(SELECT {_LINE} AS line, * FROM seeds)")
        + " || " + _section("related (ranked by call-site centrality):' || chr(10) || '", "'  ' || line", "sites DESC, name, path, start_row, symbol_id", f"(SELECT {_LINE} AS line, * FROM related)")
        + " || " + _CALL_EDGES("among") + " AS text",
        _RELATED,
    )
)
def render_context(g):
    seeds = cut(ctx.seeds(g, "red late").coalesce(1), "seeds")
    more = cut(ctx.related(g, seeds).coalesce(1), "related")
    return render.render_context("red late", seeds, more, traverse.induced_edges(g, seeds.select("name").union(more.select("name"))))


@_query(
    oracle(
        ["defs", "cg_refs", "edges"],
        f"SELECT {SYM}, CAST(sites AS BIGINT) AS sites, TRUE AS is_seed FROM seeds UNION ALL SELECT {SYM}, CAST(sites AS BIGINT), FALSE FROM related",
        _RELATED,
    )
)
def context_sql_function(g):
    from .tools import register_sql

    register_sql(g)
    return g.files.sparkSession.sql("SELECT * FROM context('the red, late!')")


@_query(oracle(_AFFECTED_NEEDS, f"SELECT path, path IN (SELECT path FROM changed) AS is_changed, {_IS_TEST} AS is_test FROM affected", _AFFECTED.replace("w.d < 4", "w.d < 2").replace("s.d < 4", "s.d < 2"), recursive=True))
def affected_sql_function(g):
    """Two hops, as the function can be asked for fewer than it is written out for."""
    from .tools import register_sql

    register_sql(g)
    _changed(g).createOrReplaceTempView("graphloom_changed")
    return g.files.sparkSession.sql("SELECT * FROM affected((SELECT collect_list(path) FROM graphloom_changed), 2)")


@_query(oracle(["defs", "resolved", "edges", "root"], f"SELECT {SYM}, distance FROM impacted", _bfs(2), recursive=True))
def impact_sql_function_d2(g):
    from .tools import register_sql

    register_sql(g)
    return g.files.sparkSession.sql("SELECT * FROM impact(:root, 2)", {"root": root(g)})


@_query(_search("re", "method", 500))
def search_sql_function(g):
    from .tools import register_sql

    register_sql(g)
    return g.files.sparkSession.sql("SELECT * FROM search_symbols('re', 'method', 500)")


@_query(
    oracle(
        _AFFECTED_NEEDS,
        "SELECT CASE WHEN count(*) = 0 THEN 'No test files appear affected by ' || CAST((SELECT count(*) FROM changed) AS VARCHAR) || ' changed file(s).' "
        "ELSE CAST(count(*) AS VARCHAR) || ' test file(s) affected by your changes:' || chr(10) || chr(10) || string_agg('  ' || path, chr(10) ORDER BY path) END AS text "
        f"FROM affected WHERE {_IS_TEST}",
        _AFFECTED,
        recursive=True,
    )
)
def render_affected(g):
    return render.render_affected(traverse.affected(g, _changed(g)))


@_query(
    oracle(
        ["cg_files", "cg_symbols", "cg_refs"],
        "SELECT 'files:   ' || CAST((SELECT count(*) FROM cg_files) AS VARCHAR) || chr(10) || 'symbols: ' || CAST((SELECT count(*) FROM cg_symbols) AS VARCHAR) || '  (' || "
        "(SELECT string_agg(kind || '=' || CAST(n AS VARCHAR), ' ' ORDER BY n DESC, kind) FROM (SELECT kind, count(*) AS n FROM cg_symbols GROUP BY kind)) || ')' || chr(10) || "
        "'refs:    ' || CAST((SELECT count(*) FROM cg_refs) AS VARCHAR) || chr(10) || 'langs:   ' || "
        "(SELECT string_agg(lang || '=' || CAST(n AS VARCHAR), ' ' ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n FROM cg_files GROUP BY lang)) AS text",
    )
)
def render_stats(g):
    return render.render_stats(lookup.stats(g))


@_query(oracle(["cg_files"], "SELECT path, CASE regexp_extract(path, '[.][^.]*$') WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' END AS lang FROM cg_files"))
def language_of_path(g):
    from .sources.scan import language_of

    return g.files.select("path", language_of("path").alias("lang"))


@_query(
    oracle(
        ["cg_files"],
        "SELECT path, CASE WHEN file_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM cg_files WHERE file_id % 5 <> 2",
    )
)
def latest_version(g):
    """Versions 1 of all files, 2 of every fourth, and tombstones of some: the last version of each file that is not deleted."""
    from .sources.store import latest

    one = g.files.select("path", F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    two = g.files.where("file_id % 4 = 0").select("path", F.lit(2).alias("version"), F.lit(False).alias("deleted"))
    gone = g.files.where("file_id % 5 = 2").select("path", F.lit(3).alias("version"), F.lit(True).alias("deleted"))
    return latest(one.union(two).union(gone)).select("path", "version")


@_query(
    oracle(
        ["resolved", "located"],
        "SELECT t.def, coalesce(b.n, 0) / a.n AS \"precision\", coalesce(b.n, 0) / t.n AS recall, "
        "CASE WHEN coalesce(b.n, 0) = 0 THEN 0 ELSE 2.0 * (b.n / a.n) * (b.n / t.n) / (b.n / a.n + b.n / t.n) END AS f1 "
        "FROM (SELECT def, count(*) AS n FROM truth GROUP BY def) t JOIN (SELECT def, count(*) AS n FROM answer GROUP BY def) a ON a.def = t.def "
        "LEFT JOIN (SELECT def, count(*) AS n FROM truth JOIN answer USING (def, file) GROUP BY def) b ON b.def = t.def",
        "truth AS (SELECT DISTINCT dst AS def, file_id AS file FROM resolved), "
        "answer AS (SELECT DISTINCT name AS def, file_id AS file FROM located WHERE kind IN ('call', 'method'))",
    )
)
def precision_recall_f1(g):
    """Unresolved callers of a name, held against the resolved ones."""
    truth = g.resolved_calls.select(F.col("dst").alias("def"), F.col("file_id").alias("file"))
    answer = g.calls.select(F.col("name").alias("def"), F.col("file_id").alias("file"))
    return evaluate.accuracy(truth, answer)


@_query(
    oracle(
        ["resolved", "located"],
        "SELECT count(*) AS definitions, avg(p) AS \"precision\", avg(r) AS recall, avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) AS f1 FROM ("
        "SELECT coalesce(b.n, 0) / a.n AS p, coalesce(b.n, 0) / t.n AS r "
        "FROM (SELECT def, count(*) AS n FROM truth GROUP BY def) t JOIN (SELECT def, count(*) AS n FROM answer GROUP BY def) a ON a.def = t.def "
        "LEFT JOIN (SELECT def, count(*) AS n FROM truth JOIN answer USING (def, file) GROUP BY def) b ON b.def = t.def)",
        "truth AS (SELECT DISTINCT dst AS def, file_id AS file FROM resolved), "
        "answer AS (SELECT DISTINCT name AS def, file_id AS file FROM located WHERE kind IN ('call', 'method'))",
    )
)
def macro_average(g):
    return evaluate.macro_average(precision_recall_f1(g))


@_query(
    oracle(
        ["defs"],
        "SELECT (SELECT count(*) FROM answers) AS queries, (SELECT CAST(sum(a) AS BIGINT) FROM answers) AS answer_tokens, (SELECT CAST(sum(f) AS BIGINT) FROM answers) AS file_tokens, "
        "100.0 * (1 - (SELECT sum(a) / sum(f) FROM answers)) AS reduction_percent, "
        "(SELECT f / a FROM (SELECT a, f, row_number() OVER (ORDER BY f / a) - 1 AS nth, count(*) OVER () AS n FROM answers WHERE a > 0) WHERE nth = least(n - 1, CAST(floor(50 * n / 100) AS BIGINT))) AS median_factor",
        "per AS (SELECT path, CAST(len(regexp_extract_all(coalesce(signature, ''), '[A-Za-z0-9]{1,4}|[^\\sA-Za-z0-9]')) AS BIGINT) AS t FROM defs), "
        "answers AS (SELECT p.t AS a, w.t AS f FROM per p JOIN (SELECT path, sum(t) AS t FROM per GROUP BY path) w USING (path))",
    )
)
def token_efficiency(g):
    """Each symbol's signature as an answer, held against all signatures of its file."""
    per = g.definitions.select("path", token_estimate(F.coalesce("signature", F.lit(""))).alias("answer_tokens"))
    whole = per.groupBy("path").agg(F.sum("answer_tokens").alias("file_tokens"))
    return evaluate.token_efficiency(per.join(whole, "path"))


@_query(
    oracle(
        ["located"],
        "SELECT p, n AS value FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS nth, count(*) OVER () AS total FROM sites) "
        "JOIN (SELECT unnest([0, 50, 90, 99, 100]) AS p) q ON nth = least(total - 1, CAST(floor(p * total / 100) AS BIGINT))",
        "sites AS (SELECT name, count(*) AS n FROM located WHERE kind IN ('call', 'method') GROUP BY name)",
    )
)
def percentile_floor(g):
    return evaluate.percentile_floor(lookup.centrality(g).select(F.col("sites").alias("value")), "value", (0, 50, 90, 99, 100))


@_query(
    oracle(
        ["cg_symbols"],
        "SELECT name, symbol_id FROM (SELECT name, symbol_id, row_number() OVER (ORDER BY name, symbol_id) - 1 AS nth, count(*) OVER () AS n FROM cg_symbols) "
        "WHERE nth IN (SELECT CAST(floor(i * (SELECT count(*) FROM cg_symbols) / 37) AS BIGINT) FROM (SELECT unnest(range(37)) AS i))",
    )
)
def systematic_sample(g):
    return evaluate.systematic_sample(g.symbols.select("name", "symbol_id"), ["name", "symbol_id"], 37)


@_query(
    oracle(
        ["cg_symbols"],
        "SELECT name, symbol_id FROM (SELECT name, symbol_id, row_number() OVER (ORDER BY name, symbol_id) - 1 AS nth FROM cg_symbols) WHERE nth % 7 = 0 AND nth < 70",
    )
)
def stride_sample(g):
    return evaluate.stride_sample(g.symbols.select("name", "symbol_id"), ["name", "symbol_id"], 7, 10)


@_query(oracle(["cg_symbols"], "SELECT symbol_id, CASE WHEN length(signature) > 40 THEN substr(signature, 1, 39) || '…' ELSE signature END AS signature FROM cg_symbols"))
def clipped_signatures(g):
    return g.symbols.select("symbol_id", clipped("signature", 40).alias("signature"))


@_query(oracle(["cg_symbols"], "SELECT symbol_id, CAST(len(regexp_extract_all(signature, '[A-Za-z0-9]{1,4}|[^\\sA-Za-z0-9]')) AS BIGINT) AS tokens FROM cg_symbols WHERE signature IS NOT NULL"))
def token_estimates(g):
    return g.symbols.where("signature is not null").select("symbol_id", token_estimate("signature").alias("tokens"))

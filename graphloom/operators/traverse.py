"""Bounded breadth-first searches over names, many roots in one job.

A level is one job: the frontier is joined to the edges, what was seen before
is taken out by an anti-join, and the rest is cut from its lineage. The search
ends early when nothing is left. Spark broadcasts a frontier that is small at
run time and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import import_basenames, is_test_file, module_basename
from ..plans.graph import CodeGraph
from ..plans.schema import AFFECTED_DEPTH, IMPACT_DEPTH, IMPACT_LIMIT, LIMIT, NEIGHBORHOOD_DEPTH, NEIGHBORHOOD_LIMIT
from ..plans.scratch import cut
from .lookup import SYMBOL_COLUMNS

#: Up to so many roots are walked from one by one; of more, affected_callers() looks at the nearest first.
FEW = 32


def roots_of(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "root string")


def bfs(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root) and edges (src, dst), walked from src to dst -> (root, name, distance), the root itself at 0; least distances."""
    return _walk(roots.select("root", F.col("root").alias("name")), edges, depth)


def _walk(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The same from the names of (root, name) on: those of one root are at 0 together."""
    seen = cut(start.select("root", "name", F.lit(0).alias("distance")).distinct(), "seen")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier.name == edges.src).select("root", F.col("dst").alias("name")).distinct()
        step = cut(step.join(seen, ["root", "name"], "left_anti").withColumn("distance", F.lit(d)), "level")
        if step.isEmpty():
            break
        seen, frontier = seen.union(step), step
    return seen


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impacted(g: CodeGraph, roots: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """Transitive callers of many roots: root, distance and the definition of each caller in the files it calls from."""
    found = cut(bfs(roots, _reversed(g.edges), depth), "reached")
    callee = found.select("root", F.col("name").alias("dst"), (F.col("distance") + 1).alias("distance"))
    caller = found.where("distance > 0").select("root", F.col("name").alias("src"), "distance")
    sites = caller.join(g.edge_files, "src").join(callee, ["root", "dst", "distance"]).select("root", "distance", F.col("src").alias("name"), "file_id").distinct()
    return sites.join(g.symbols, ["name", "file_id"]).join(g.files.select("file_id", "path"), "file_id").select("root", *SYMBOL_COLUMNS, "distance")


def impact(g: CodeGraph, name: str, depth: int = IMPACT_DEPTH, limit: int | None = IMPACT_LIMIT) -> DataFrame:
    """The transitive callers of a name with their distance, nearest first. The name itself is never among them."""
    out = impacted(g, roots_of(g.symbols.sparkSession, [name]), depth).drop("root").orderBy("distance", "path", "start_row", "symbol_id")
    return out if limit is None else out.limit(limit)


def find_callees(g: CodeGraph, name: str, limit: int | None = LIMIT) -> DataFrame:
    """The definitions that a symbol's calls mean: kinds fit, and names with too many definitions mean nothing."""
    made = g.resolved_calls.where(F.col("src") == name).select(F.col("dst").alias("name"), F.col("kind").alias("ref_kind")).distinct()
    return definitions_of(g, made).orderBy("path", "start_row", "symbol_id").limit(limit or 2**31 - 1)


def definitions_of(g: CodeGraph, called: DataFrame) -> DataFrame:
    """(name, ref_kind) -> the definitions of a kind that fits."""
    d = g.definitions
    fits = (F.col("ref_kind") == "call") & (F.col("kind") == "function") | (F.col("ref_kind") == "method") & (F.col("kind") == "method")
    if g.resolution == "lenient":
        fits = fits | (F.col("ref_kind") == "call") & (F.col("kind") == "class") | (F.col("ref_kind") == "method") & (F.col("kind") == "function") & F.col("container").isNotNull()
    return called.join(d, "name").where(fits).select(*SYMBOL_COLUMNS).distinct()


def neighborhood_nodes(g: CodeGraph, name: str, depth: int = NEIGHBORHOOD_DEPTH, limit: int = NEIGHBORHOOD_LIMIT) -> DataFrame:
    """Definitions within ``depth`` calls of the name, either way, nearest first."""
    both = g.edges.union(_reversed(g.edges)).distinct()
    found = bfs(roots_of(g.symbols.sparkSession, [name]), both, depth)
    nodes = found.select("name", "distance").join(g.definitions, "name")
    return nodes.orderBy("distance", "path", "start_row", "symbol_id").limit(limit).select(*SYMBOL_COLUMNS, "distance")


def induced_edges(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """The call edges with both ends among the names of the nodes."""
    names = nodes.select("name").distinct()
    e = g.edges.join(names.select(F.col("name").alias("src")), "src", "left_semi")
    return e.join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def unresolved_names(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    """What the nodes call and nothing defines."""
    names = nodes.select(F.col("name").alias("from_symbol")).distinct()
    return g.calls.join(names, "from_symbol", "left_semi").select("name").distinct().join(g.symbols.select("name").distinct(), "name", "left_anti")


def affected_callers(g: CodeGraph, own: DataFrame, depth: int) -> DataFrame:
    """(file_id): the files of ``impacted`` for the roots in own (root), without walking from each root by itself.

    A call from a to b counts if some root is k < depth hops from b and k + 1,
    not fewer, from a. With the distance to the nearest of all roots that is
    plain where a is further than b, or b is a root. Only for calls of files
    that have no such call, roots are looked for one by one, from the calls on
    towards the roots, level by level, along names that can still lead to one.
    """
    near = cut(_walk(own.select(F.lit(0).alias("root"), F.col("root").alias("name")), _reversed(g.edge_files), depth).select("name", "distance"), "nearest")
    defined = g.symbols.select(F.col("name").alias("src"), "file_id").distinct()
    sites = g.edge_files.where("src <> dst").join(defined, ["src", "file_id"], "left_semi")
    sites = sites.join(near.where(F.col("distance") < depth).select(F.col("name").alias("dst"), F.col("distance").alias("at")), "dst")
    sites = sites.join(near.select(F.col("name").alias("src"), F.col("distance").alias("up")), "src")
    plain = (F.col("up") > F.col("at")) | (F.col("at") == 0)
    found = cut(sites.where(plain).select("file_id").distinct(), "callers")
    open_ = cut(sites.where(~plain).select("src", "dst", "file_id").join(found, "file_id", "left_anti"), "open-calls")
    ways = seen = frontier = None
    for k in range(1, depth):
        if open_.isEmpty():
            break
        ends = open_.select(F.col("src").alias("root")).union(open_.select(F.col("dst").alias("root"))).distinct()
        if frontier is None:
            ways = cut(g.edge_files.select("src", "dst").join(near.select(F.col("name").alias("dst"), F.col("distance").alias("left")), "dst").where(F.col("left") < depth - 1).distinct(), "ways")
            seen = frontier = cut(ends.select("root", F.col("root").alias("name"), F.lit(False).alias("is_root")), "ends")
        step = frontier.join(ends, "root", "left_semi").join(ways, F.col("name") == F.col("src")).where(F.col("left") < depth - k)
        step = step.select("root", F.col("dst").alias("name"), (F.col("left") == 0).alias("is_root")).distinct()
        frontier = cut(step.join(seen, ["root", "name"], "left_anti"), "level")
        seen = seen.union(frontier)
        ahead = open_.select("src", "dst").distinct().join(frontier.where("is_root").select(F.col("root").alias("dst"), "name"), "dst")
        tight = ahead.join(seen.select(F.col("root").alias("src"), "name"), ["src", "name"], "left_anti").select("src", "dst").distinct()
        more = cut(open_.join(tight, ["src", "dst"], "left_semi").select("file_id").distinct(), "callers")
        found, open_ = found.union(more), cut(open_.join(more, "file_id", "left_anti"), "open-calls")
    return found


def import_edges(g: CodeGraph) -> DataFrame:
    """(basename, importer path) for each file that imports something of that basename."""
    spec = g.located_refs.where(F.col("kind") == "import").select("path", F.explode(import_basenames("name")).alias("basename"))
    return spec.distinct()


def find_importers(g: CodeGraph, basename: str) -> DataFrame:
    hits = import_edges(g).where((F.col("basename") == basename) & (F.col("basename") != ""))
    return hits.select("path").distinct().orderBy("path")


def affected(g: CodeGraph, changed: DataFrame, depth: int = AFFECTED_DEPTH) -> DataFrame:
    """(path) of changed files -> path, is_changed, is_test of all files that the changes may affect.

    First the files of all transitive callers of what the changed files define;
    then, from the changed files alone, importers level by level. An importer
    that is already affected is not followed further.
    """
    changed = cut(changed.select("path").distinct(), "changed")
    own = g.definitions.join(changed, "path", "left_semi").select(F.col("name").alias("root")).distinct()
    own = cut(own, "own")
    if own.limit(FEW + 1).count() <= FEW:
        callers = impacted(g, own, depth).select("path")
    else:
        callers = g.files.join(affected_callers(g, own, depth), "file_id", "left_semi").select("path")
    seen = cut(changed.union(callers).distinct(), "affected")
    imports = cut(import_edges(g).withColumnRenamed("path", "importer"), "imports")
    frontier = changed
    for _ in range(depth):
        step = frontier.select(module_basename("path").alias("basename")).where("basename <> ''").distinct().join(imports, "basename")
        step = cut(step.select(F.col("importer").alias("path")).distinct().join(seen, "path", "left_anti"), "importers")
        if step.isEmpty():
            break
        seen, frontier = seen.union(step), step
    marked = seen.join(changed.withColumn("is_changed", F.lit(True)), "path", "left")
    return marked.select("path", F.coalesce("is_changed", F.lit(False)).alias("is_changed"), is_test_file("path").alias("is_test")).orderBy("path")

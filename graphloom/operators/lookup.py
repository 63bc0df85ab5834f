"""Searches, point lookups, callers, references, outlines and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_literal
from ..plans.graph import CodeGraph
from ..plans.schema import LIMIT

SYMBOL_COLUMNS = ("symbol_id", "path", "name", "kind", "container", "exported", "signature", "start_row", "start_col", "end_row", "end_col")
REF_COLUMNS = ("path", "from_symbol", "name", "kind", "start_row", "start_col")
#: Source order of references, complete for distinct ones.
REF_ORDER = ("path", "start_row", "start_col", "name", "kind", "from_symbol")


def _limited(df: DataFrame, limit: int | None, *order) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def search_symbols(g: CodeGraph, query: str, kind: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Definitions whose name holds the query, ignoring case: exact names first, then prefixes, then others; shorter names first."""
    q = query.lower()
    low = F.lower("name")
    rank = F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2)
    hits = g.symbols.where(contains_literal("name", query))
    if kind is not None:
        hits = hits.where(F.col("kind") == kind)
    hits = hits.join(g.files.select("file_id", "path"), "file_id").withColumn("rank", rank)
    return _limited(hits, limit, "rank", F.length("name"), "name", "path", "start_row", "symbol_id").select(*SYMBOL_COLUMNS)


def get_symbol(g: CodeGraph, name: str, limit: int | None = LIMIT) -> DataFrame:
    return _limited(g.definitions.where(F.col("name") == name), limit, "path", "start_row", "symbol_id").select(*SYMBOL_COLUMNS)


def find_references(g: CodeGraph, name: str, kind: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """All references to a name, calls and imports alike."""
    hits = g.located_refs.where(F.col("name") == name)
    if kind is not None:
        hits = hits.where(F.col("kind") == kind)
    return _limited(hits, limit, *REF_ORDER).select(*REF_COLUMNS)


def find_callers(g: CodeGraph, name: str, limit: int | None = LIMIT) -> DataFrame:
    """One reference, the first, for each file and calling symbol that calls the name; not resolved, so that none is missed."""
    hits = g.calls.where(F.col("name") == name)
    first = F.row_number().over(Window.partitionBy("file_id", "from_symbol").orderBy("start_row", "start_col", "kind", "ref_id"))
    hits = hits.withColumn("nth", first).where("nth = 1").join(g.files.select("file_id", "path"), "file_id")
    return _limited(hits, limit, *REF_ORDER).select(*REF_COLUMNS)


def file_outline(g: CodeGraph, path: str) -> DataFrame:
    own = g.files.where(F.col("path") == path).select("file_id", "path")
    return g.symbols.join(own, "file_id").orderBy("start_row", "start_col", "symbol_id").select(*SYMBOL_COLUMNS)


def centrality(g: CodeGraph) -> DataFrame:
    """(name, sites): how many call sites name it."""
    return g.calls.groupBy("name").agg(F.count("*").alias("sites"))


def popularity(g: CodeGraph, limit: int, kinds: tuple[str, ...] = ("function", "method"), shortest: int = 4) -> DataFrame:
    """Names by the number of (definition, call) pairs: a name with two definitions counts its calls twice. Names without calls count 0."""
    calls = g.calls.groupBy("name").agg(F.count("*").alias("n"))
    names = g.symbols.where(F.col("kind").isin(*kinds) & (F.length("name") >= shortest)).groupBy("name").agg(F.count("*").alias("defs"))
    pairs = F.coalesce(F.col("n"), F.lit(0)) * F.col("defs")
    return names.join(calls, "name", "left").select("name", pairs.alias("callers")).orderBy(F.desc("callers"), "name").limit(limit)


def distinct_names(g: CodeGraph, limit: int = 5000) -> DataFrame:
    return g.symbols.select("name").distinct().orderBy("name").limit(limit)


def stats(g: CodeGraph) -> DataFrame:
    """One row: files, symbols, refs, by_kind, by_lang."""
    counted = lambda df, of, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(of).alias("of"), "key", "n")
    groups = counted(g.files, "files", F.col("lang")).union(counted(g.symbols, "symbols", F.col("kind"))).union(counted(g.refs, "refs", F.lit("")))
    total = lambda of: F.coalesce(F.sum(F.when(F.col("of") == of, F.col("n"))), F.lit(0)).cast("bigint").alias(of)
    by = lambda of, name: F.map_from_entries(F.collect_list(F.when(F.col("of") == of, F.struct("key", "n")))).alias(name)
    return groups.agg(total("files"), total("symbols"), total("refs"), by("symbols", "by_kind"), by("files", "by_lang"))

"""Task context: the symbols a query names, and their call neighbours by centrality."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_literal
from ..plans.graph import CodeGraph
from ..plans.schema import CONTEXT_SYMBOLS
from .lookup import SYMBOL_COLUMNS, centrality
from .traverse import induced_edges


def query_tokens(query: str) -> list[str]:
    """The identifiers of a query that have two characters or more, lower-cased."""
    return list(dict.fromkeys(t.lower() for t in re.split(r"[^A-Za-z0-9_$]+", query) if len(t) >= 2))


def seeds(g: CodeGraph, query: str, max_symbols: int = CONTEXT_SYMBOLS) -> DataFrame:
    """Definitions that hold a token of the query: by tokens held, exact names first, then by call sites."""
    tokens = query_tokens(query)
    held = sum((contains_literal("name", t).cast("int") for t in tokens), F.lit(0))
    exact = F.lower("name").isin(*tokens) if tokens else F.lit(False)
    hits = g.symbols.withColumn("held", held).where("held > 0").withColumn("exact", exact)
    hits = hits.join(centrality(g), "name", "left").join(g.files.select("file_id", "path"), "file_id").withColumn("sites", F.coalesce("sites", F.lit(0)))
    order = (F.desc("held"), F.desc("exact"), F.desc("sites"), "name", "path", "start_row", "symbol_id")
    return hits.orderBy(*order).limit(-(-max_symbols // 2)).select(*SYMBOL_COLUMNS, "held", "sites")


def related(g: CodeGraph, chosen: DataFrame, max_symbols: int = CONTEXT_SYMBOLS) -> DataFrame:
    """Definitions one call from the seeds, either way, by call sites; together with the seeds at most max_symbols."""
    names = chosen.select("name").distinct()
    out = g.edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name"))
    in_ = g.edges.join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select(F.col("src").alias("name"))
    near = out.union(in_).distinct().join(names, "name", "left_anti")
    rows = near.join(centrality(g), "name", "left").join(g.definitions, "name").withColumn("sites", F.coalesce("sites", F.lit(0)))
    room = max_symbols - chosen.count()
    return rows.orderBy(F.desc("sites"), "name", "path", "start_row", "symbol_id").limit(max(0, room)).select(*SYMBOL_COLUMNS, "sites")


def context(g: CodeGraph, query: str, max_symbols: int = CONTEXT_SYMBOLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, related, edges among them)."""
    first = seeds(g, query, max_symbols)
    more = related(g, first, max_symbols)
    return first, more, induced_edges(g, first.select("name").union(more.select("name")))

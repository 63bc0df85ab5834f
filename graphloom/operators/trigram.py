"""An inverted index of three-character pieces of names, for substring searches over very many symbols.

Worth its space where a scan of all names is not: cluster the index by piece
(``repartitionByRange("tri")`` before writing), and a search opens few files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import CodeGraph
from ..plans.schema import LIMIT
from .lookup import search_symbols


def _pieces(name: Column) -> Column:
    low = F.lower(name)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))))


def build(symbols: DataFrame) -> DataFrame:
    """(tri, symbol_id): each piece of each name once."""
    return symbols.select(F.explode(_pieces(F.col("name"))).alias("tri"), "symbol_id")


def candidates(index: DataFrame, query: str) -> DataFrame:
    """(symbol_id) of names that have all pieces of the query; a superset of those that hold it."""
    low = query.lower()
    pieces = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    hits = index.where(F.col("tri").isin(pieces)).groupBy("symbol_id").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(pieces)).select("symbol_id")


def search(g: CodeGraph, index: DataFrame, query: str, kind: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """search_symbols over the candidates; queries below three characters are scanned."""
    if len(query) >= 3:
        g = replace(g, symbols=g.symbols.join(candidates(index, query), "symbol_id", "left_semi"))
    return search_symbols(g, query, kind, limit)

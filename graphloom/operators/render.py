"""Compact text of results. Each renderer gives one row with the column text; rows are in the order of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOP_LEVEL, symbol_line


def _joined(df: DataFrame, line: Column, order: list[Column], empty: str, indent: str = "") -> DataFrame:
    """The lines of a result of limited size in order, or a sentence for no lines."""
    one = df.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.concat(F.lit(indent), line).alias("line")).alias("x"))
    lines = one.agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(F.when(F.size("x") == 0, F.lit(empty)).otherwise(F.array_join(F.transform("x", lambda s: s.line), "\n")).alias("text"))


def _numbered(df: DataFrame) -> DataFrame:
    """Keep the order of a sorted result: its partitions are in order, and so are the rows of each."""
    return df.withColumn("_at", F.monotonically_increasing_id())


def render_symbols(rows: DataFrame, empty: str = "No matching symbols.", indent: str = "") -> DataFrame:
    return _joined(_numbered(rows), symbol_line(), [F.col("_at")], empty, indent)


def render_callers(rows: DataFrame) -> DataFrame:
    """Callers by file: its first line, then its distinct callers in the order they are met; files in that order too."""
    at = _numbered(rows).withColumn("who", F.coalesce("from_symbol", F.lit(TOP_LEVEL)))
    first = at.groupBy("path", "who").agg(F.min("_at").alias("_at"), F.min("start_row").alias("row"))
    files = first.groupBy("path").agg(F.min("row").alias("row"), F.min("_at").alias("_at"), F.array_sort(F.collect_list(F.struct("_at", "who"))).alias("who"))
    line = F.concat("path", F.lit(":"), (F.col("row") + 1).cast("string"), F.lit("  "), F.array_join(F.transform("who", lambda w: w.who), ", "))
    return _joined(files, line, [F.col("_at")], "No callers.")


def render_refs(rows: DataFrame) -> DataFrame:
    line = F.concat("path", F.lit(":"), (F.col("start_row") + 1).cast("string"), F.lit("  "), F.coalesce("from_symbol", F.lit(TOP_LEVEL)))
    return _joined(_numbered(rows), line, [F.col("_at")], "No references.")


def render_impact(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("distance").cast("string"), F.lit(" hop] "), symbol_line())
    return _joined(_numbered(rows), line, [F.col("_at")], "No callers — changing this is low-risk.")


def _edges(edges: DataFrame) -> DataFrame:
    return _joined(edges, F.concat("src", F.lit(" → "), "dst"), [F.col("src"), F.col("dst")], "", "  ")


def _sections(head: str, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Sections of text one after another; those without text are left out."""
    titled = [part.select(F.lit(i).alias("i"), F.concat(F.lit(f"\n\n{title}"), "text").alias("t"), "text") for i, (title, part) in enumerate(parts)]
    rows = reduce(DataFrame.union, titled).where("text <> ''")
    body = F.array_sort(F.collect_list(F.struct("i", "t")))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda x: x.t), "")).alias("text"))


def render_neighborhood(root: str, nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    missing = unresolved.agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("text"))
    return _sections(
        f"neighbourhood of {root}:",
        [("definitions:\n", render_symbols(nodes, "  (none indexed)", "  ")), ("call edges:\n", _edges(edges)), ("unresolved (referenced, not defined in index): ", missing)],
    )


def render_context(query: str, seeds: DataFrame, related: DataFrame, edges: DataFrame) -> DataFrame:
    return _sections(
        f'context for "{query}":',
        [("matches:\n", render_symbols(seeds, "  (no symbols matched)", "  ")), ("related (ranked by call-site centrality):\n", render_symbols(related, "", "  ")), ("call edges:\n", _edges(edges))],
    )


def render_affected(found: DataFrame) -> DataFrame:
    """Of (path, is_changed, is_test): the test files, or how many files were changed without effect on a test."""
    x = found.agg(F.array_sort(F.collect_list(F.when(F.col("is_test"), F.col("path")))).alias("tests"), F.count_if("is_changed").alias("n"))
    none = F.concat(F.lit("No test files appear affected by "), F.col("n").cast("string"), F.lit(" changed file(s)."))
    some = F.concat(F.size("tests").cast("string"), F.lit(" test file(s) affected by your changes:\n\n"), F.array_join(F.transform("tests", lambda t: F.concat(F.lit("  "), t)), "\n"))
    return x.select(F.when(F.size("tests") == 0, none).otherwise(some).alias("text"))


def render_stats(stats: DataFrame) -> DataFrame:
    def listed(m: str) -> Column:
        entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e.value).alias("n"), e.key.alias("k"))))
        text = F.array_join(F.transform(entries, lambda e: F.concat(e.k, F.lit("="), (-e.n).cast("string"))), " ")
        return F.when(F.size(m) == 0, "none").otherwise(text)

    n = lambda c: F.col(c).cast("string")
    return stats.select(
        F.concat(
            F.lit("files:   "), n("files"), F.lit("\nsymbols: "), n("symbols"), F.lit("  ("), listed("by_kind"), F.lit(")\nrefs:    "), n("refs"), F.lit("\nlangs:   "), listed("by_lang")
        ).alias("text")
    )

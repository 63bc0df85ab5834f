"""Registered queries over text: parsing round trips, runs of the indexer, streams."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.derive import oracle
from .plans.graph import CodeGraph
from .plans.scratch import cut, scratch_path
from .sources.indexer import Indexer, parse_files, parse_source_udtf
from .sources.scan import scan
from .sources.store import GraphStore
from .streaming.changes import last_events, watch


#: How a function and its end are written in the languages of the derived graph.
_HEADS = {"python": ("def ", "():\n", "    pass", ""), "typescript": ("function ", "() {\n", "", "\n}"), "go": ("func ", "() {\n", "", "\n}")}


def texts(g: CodeGraph, *langs: str) -> DataFrame:
    """Source text for files of the graph: each symbol a function whose body is its calls."""
    pick = lambda i: F.create_map(*[F.lit(x) for k in langs for x in (k, _HEADS[k][i])])[F.col("lang")]
    files = g.files.where(F.col("lang").isin(*langs)).select("file_id", "path", "lang")
    call = F.when(F.col("r.kind") == "call", F.concat(F.lit("    "), "r.name", F.lit("()"))).otherwise(F.concat(F.lit("    obj."), "r.name", F.lit("()")))
    calls = g.calls.where(F.col("from_symbol").isNotNull()).alias("r").groupBy("r.file_id", "r.from_symbol").agg(F.array_sort(F.collect_set(call)).alias("body"))
    made = g.symbols.select("file_id", "name").distinct().join(files, "file_id")
    made = made.join(calls.withColumnRenamed("from_symbol", "name"), ["file_id", "name"], "left")
    text = F.concat(pick(0), "name", pick(1), F.coalesce(F.array_join("body", "\n"), pick(2)), pick(3))
    return made.groupBy("file_id", "path", "lang").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("text"))


def _facts(texts: DataFrame) -> DataFrame:
    return texts.withColumns({"hash": F.sha1("text"), "size": F.length("text").cast("bigint"), "mtime": F.lit(0).cast("bigint")})


def _parsed(spark: SparkSession, sf_dir: str, *langs: str) -> DataFrame:
    return parse_files(_facts(texts(CodeGraph.from_testdata(spark, sf_dir), *langs)))


def parse_roundtrip_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "python").select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.signature")


def parse_roundtrip_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "python").select("path", F.explode("refs").alias("r")).select("path", "r.from_symbol", "r.name", "r.kind").distinct()


def parse_braces_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "typescript", "go").select("path", "lang", F.explode("symbols").alias("s")).select("path", "lang", "s.name", "s.kind", "s.signature")


def parse_braces_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "typescript", "go").select("path", F.explode("refs").alias("r")).select("path", "r.from_symbol", "r.name", "r.kind").distinct()


def parse_lateral_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parser as a table function of SQL."""
    texts(CodeGraph.from_testdata(spark, sf_dir), "python").createOrReplaceTempView("graphloom_texts")
    spark.udtf.register("parse_source", parse_source_udtf())
    return spark.sql("SELECT t.path, p.what, count(*) AS n FROM graphloom_texts t, LATERAL parse_source(t.lang, t.text) p GROUP BY t.path, p.what")


_PY = """py AS (SELECT DISTINCT f.file_id, f.path, s.name FROM cg_symbols s JOIN cg_files f ON f.file_id = s.file_id WHERE f.lang = 'python'),
py_refs AS (SELECT DISTINCT p.path, r.from_symbol, r.name, r.kind FROM cg_refs r JOIN py p ON p.file_id = r.file_id AND p.name = r.from_symbol WHERE r.kind IN ('call', 'method'))"""


def _change_log(g: CodeGraph) -> DataFrame:
    """Each file saved up to three times and some deleted, as one log."""
    saved = g.files.select("path", F.lit("upsert").alias("op"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("file_id") % 3 + 1)).alias("mtime"))
    gone = g.files.where("file_id % 4 = 1").select("path", F.lit("delete").alias("op"), F.lit(2).cast("bigint").alias("mtime"))
    return saved.union(gone)


def last_event_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_events(_change_log(CodeGraph.from_testdata(spark, sf_dir)))


def stream_upsert_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log replayed in micro-batches through a keyed table; equal to the batch result above."""
    log = _change_log(CodeGraph.from_testdata(spark, sf_dir))
    base = scratch_path(spark, "stream")
    log.repartition(6, "path").write.parquet(f"{base}/log")
    state = f"{base}/state"

    def upsert(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(f"{state}-{n - 1}") if n else batch.limit(0)
        last_events(before.unionByName(batch)).write.mode("overwrite").parquet(f"{state}-{n}")

    stream = spark.readStream.schema("path string, op string, mtime bigint").option("maxFilesPerTrigger", 2).parquet(f"{base}/log")
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    n = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{state}-{n}")


def _saved_again(made: DataFrame) -> DataFrame:
    """The tree a while later: every third file is gone, and of the others every fourth file has one more function."""
    heads = F.create_map(*[F.lit(x) for k, h in _HEADS.items() for x in (k, h[0])])[F.col("lang")]
    tails = F.create_map(*[F.lit(x) for k, h in _HEADS.items() for x in (k, h[1] + h[2] + h[3])])[F.col("lang")]
    more = F.concat("text", F.lit("\n"), heads, F.lit("added_"), F.col("file_id").cast("string"), tails, F.lit("\n"))
    return made.where("file_id % 3 <> 1").withColumn("text", F.when(F.col("file_id") % 4 == 0, more).otherwise(F.col("text")))


def _indexed_twice(spark: SparkSession, sf_dir: str) -> tuple[GraphStore, list]:
    """A store after two runs over the files of the graph; the second meets a file that cannot be parsed besides."""
    store = GraphStore(spark)
    indexer = Indexer(store)
    made = cut(texts(CodeGraph.from_testdata(spark, sf_dir), *_HEADS), "texts")
    odd = spark.createDataFrame([(-1, "src/odd.cbl", "cobol", "MOVE A TO B")], made.schema)
    return store, [indexer.index_table(_facts(t)) for t in (made, _saved_again(made).union(odd))]


def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs of the indexer report."""
    _, runs = _indexed_twice(spark, sf_dir)
    return spark.createDataFrame([(i, r.indexed, r.skipped, r.removed, len(r.errors)) for i, r in enumerate(runs, 1)], "run int, indexed bigint, skipped bigint, removed bigint, errors bigint")


def hash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose rows the second run replaced: those whose content hash had changed."""
    store, _ = _indexed_twice(spark, sf_dir)
    files = store.files()
    first = files.agg(F.min("version")).first()[0]
    return files.where(F.col("version") > first).select("path")


def prune_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are left after the second run did not see every third file."""
    store, _ = _indexed_twice(spark, sf_dir)
    return store.files().select("path")


def indexed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions in the store after both runs."""
    store, _ = _indexed_twice(spark, sf_dir)
    return store.graph().definitions.select("path", "name", "kind").distinct()


def compacted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the tables were rewritten."""
    store, _ = _indexed_twice(spark, sf_dir)
    store.compact()
    return store.graph().definitions.select("path", "name", "kind").distinct()


def _local_folder(spark: SparkSession, name: str) -> Path:
    """A folder in the shared one, by its path on this machine: walks and saves are the driver's."""
    return Path(scratch_path(spark, name).removeprefix("file:"))


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk finds of a tree with hidden, ignored and excluded files, some of which come back."""
    g = CodeGraph.from_testdata(spark, sf_dir)
    root = _local_folder(spark, "walked")
    try:
        for r in g.files.select("file_id", "path").toLocalIterator():
            for path in (r["path"], f"node_modules/n{r['file_id']}.ts", f"src/gen/g{r['file_id']}.py", f".hidden/h{r['file_id']}.py", f"kept/skip{r['file_id']}.js", f"notes/n{r['file_id']}.txt"):
                (root / path).parent.mkdir(parents=True, exist_ok=True)
                (root / path).write_text("x" * (r["file_id"] % 50), "utf-8")
        (root / ".gitignore").write_text("# made files\ngen/\n*.go\n!m1*.go\n")
        return cut(scan(spark, root, ignore=["kept/skip*"]).select("path", "lang", "size"), "scanned")
    finally:
        shutil.rmtree(root, ignore_errors=True)


def stream_follows_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, when files are saved and deleted in a folder that the change stream follows."""
    made = cut(texts(CodeGraph.from_testdata(spark, sf_dir), *_HEADS), "texts")
    base = _local_folder(spark, "followed")
    root = base / "tree"

    def save(rows: DataFrame) -> None:
        for r in rows.select("path", "text").toLocalIterator():
            (root / r["path"]).parent.mkdir(parents=True, exist_ok=True)
            (root / r["path"]).write_text(r["text"], "utf-8")

    save(made)
    store = GraphStore(spark)
    indexer = Indexer(store, root)
    indexer.index_all()
    handle = watch(indexer, f"{base}/checkpoint")
    try:
        handle.process_all()
        save(_saved_again(made).where("file_id % 4 = 0"))
        for r in made.where("file_id % 3 = 1").select("path").toLocalIterator():
            (root / r["path"]).unlink()
        handle.process_all()
    finally:
        handle.close()
        shutil.rmtree(root, ignore_errors=True)
    return store.graph().definitions.select("path", "name", "kind").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (parse_roundtrip_symbols, parse_roundtrip_refs, parse_braces_symbols, parse_braces_refs, parse_lateral_counts, last_event_per_file, stream_upsert_equals_batch,
          index_runs, hash_gate, prune_deleted, indexed_symbols, compacted_symbols, scanned_files, stream_follows_tree)
    return {f.__name__: f for f in fs}


_LAST = """SELECT path, op, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, op) AS nth FROM (
  SELECT path, 'upsert' AS op, CAST(unnest(range(1, CAST(file_id % 3 AS BIGINT) + 2)) AS BIGINT) AS mtime FROM cg_files
  UNION ALL SELECT path, 'delete', CAST(2 AS BIGINT) FROM cg_files WHERE file_id % 4 = 1)) WHERE nth = 1"""


_LATER = """written AS (SELECT DISTINCT f.file_id, f.path, s.name FROM cg_symbols s JOIN cg_files f ON f.file_id = s.file_id),
sources AS (SELECT DISTINCT file_id, path FROM written)"""
_STORED = """SELECT path, name, 'function' AS kind FROM written WHERE file_id % 3 <> 1
UNION ALL SELECT path, 'added_' || CAST(file_id AS VARCHAR), 'function' FROM sources WHERE file_id % 3 <> 1 AND file_id % 4 = 0"""


def oracle_sql() -> dict[str, str]:
    stored = oracle(["cg_symbols", "cg_files"], _STORED, _LATER)
    return {
        "index_runs": oracle(
            ["cg_symbols", "cg_files"],
            "SELECT CAST(1 AS INT) AS run, count(*) AS indexed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS errors FROM sources UNION ALL "
            "SELECT 2, count(*) FILTER (file_id % 3 <> 1 AND file_id % 4 = 0), count(*) FILTER (file_id % 3 <> 1 AND file_id % 4 <> 0), count(*) FILTER (file_id % 3 = 1), 1 FROM sources",
            _LATER,
        ),
        "hash_gate": oracle(["cg_symbols", "cg_files"], "SELECT path FROM sources WHERE file_id % 3 <> 1 AND file_id % 4 = 0", _LATER),
        "prune_deleted": oracle(["cg_symbols", "cg_files"], "SELECT path FROM sources WHERE file_id % 3 <> 1", _LATER),
        "scanned_files": oracle(
            ["cg_files"], "SELECT path, lang, CAST(file_id % 50 AS BIGINT) AS size FROM cg_files WHERE path NOT LIKE '%.go' OR regexp_matches(path, '/m1[^/]*[.]go$')"
        ),
        "indexed_symbols": stored,
        "compacted_symbols": stored,
        "stream_follows_tree": stored,
        "parse_roundtrip_symbols": oracle(["cg_symbols", "cg_files"], "SELECT DISTINCT path, name, 'function' AS kind, 'def ' || name || '():' AS signature FROM py", _PY.split(",\npy_refs")[0]),
        "parse_roundtrip_refs": oracle(["cg_refs", "cg_symbols", "cg_files"], "SELECT path, from_symbol, name, kind FROM py_refs", _PY),
        "parse_braces_symbols": oracle(
            ["cg_symbols", "cg_files"],
            "SELECT DISTINCT path, lang, name, 'function' AS kind, CASE lang WHEN 'go' THEN 'func ' ELSE 'function ' END || name || '()' AS signature FROM braces",
            "braces AS (SELECT f.path, f.lang, s.name FROM cg_symbols s JOIN cg_files f ON f.file_id = s.file_id WHERE f.lang <> 'python')",
        ),
        "parse_braces_refs": oracle(["cg_refs", "cg_symbols", "cg_files"], "SELECT path, from_symbol, name, kind FROM py_refs", _PY.replace("= 'python'", "<> 'python'")),
        "parse_lateral_counts": oracle(
            ["cg_refs", "cg_symbols", "cg_files"],
            "SELECT path, 'symbol' AS what, count(*) AS n FROM py GROUP BY path UNION ALL SELECT path, 'ref', count(*) FROM py_refs GROUP BY path",
            _PY,
        ),
        "last_event_per_file": oracle(["cg_files"], _LAST),
        "stream_upsert_equals_batch": oracle(["cg_files"], _LAST),
    }

from graphloom.operators.evaluate import accuracy, format_bytes, macro_average
from graphloom.plans.graph import CodeGraph
from graphloom.sources.indexer import Indexer
from graphloom.sources.store import GraphStore
from graphloom.sources.truth import module_of, python_callers
from pyspark.sql import functions as F

FILES = {
    "pkg/__init__.py": "from .a import fa\n",
    "pkg/a.py": "def fa():\n    pass\nclass A:\n    def m(self):\n        fa()\n",
    "pkg/b.py": "from .a import fa as other, A\nfrom . import a\nother()\nA().m()\na.fa()\n",
    "main.py": "import pkg.a\nfrom unknown import fa\nfa()\npkg.a.fa()\n",
    "bad.py": "def (:\n",
}


def test_callers_by_import(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    assert {tuple(r) for r in python_callers(files).collect()} == {("pkg.a.fa", "pkg/a.py"), ("pkg.a.fa", "pkg/b.py"), ("pkg.a.fa", "main.py"), ("pkg.a.A", "pkg/b.py")}
    assert module_of("pkg/__init__.py") == "pkg" and module_of("pkg/a.py") == "pkg.a"


def test_accuracy_of_our_own_callers(spark):
    """Callers by name, held against the yardstick, over this package's own source."""
    from pathlib import Path

    import graphloom

    root = Path(graphloom.__file__).parent.parent
    store = GraphStore(spark)
    Indexer(store, root).index_all(ignore=["tests/**", "graphloom/llm/**", "corpus_pipeline.py"])
    g: CodeGraph = store.graph()
    from graphloom.sources.scan import scan

    texts = scan(spark, root, ignore=["tests/**", "graphloom/llm/**", "corpus_pipeline.py"]).where("lang = 'python'")
    truth = python_callers(texts)
    short = F.substring_index("def", ".", -1)
    answer = g.calls.join(g.files, "file_id").select(F.col("name").alias("short"), F.col("path").alias("file")).distinct()
    answer = truth.select("def", short.alias("short")).distinct().join(answer, "short").select("def", "file")
    score = macro_average(accuracy(truth, answer)).first()
    assert score["definitions"] > 60 and score["recall"] > 0.97 and score["f1"] > 0.85
    store.close()


def test_exports():
    import graphloom

    assert all(getattr(graphloom, n) is not None for n in graphloom.__all__)


def test_bytes():
    assert [format_bytes(n) for n in (999, 2500, 2_500_000)] == ["999 B", "3 KB", "2.5 MB"]

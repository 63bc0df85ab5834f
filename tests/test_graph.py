"""Small hand-made graphs: each shows one rule of the query operators."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import clipped, contains_literal, import_basenames, is_test_file, module_basename, short_signature, token_estimate, utf16_length
from graphloom.operators import context as ctx
from graphloom.operators import evaluate, lookup, render, traverse, trigram
from graphloom.plans.graph import CodeGraph
from graphloom.plans.scratch import cut
from graphloom.sources.store import GraphStore
from graphloom.tools import register_sql


def graph(spark, symbols, refs=(), files=None, **options):
    """symbols: (file, name, kind[, container]); refs: (file, from, name, kind)."""
    paths = sorted({*(files or ()), *(s[0] for s in symbols), *(r[0] for r in refs)})
    ids = {p: i for i, p in enumerate(paths)}
    f = [(ids[p], p, "typescript", "h", 1, 0, 0) for p in paths]
    s = [(n, ids[x[0]], x[1], x[2], x[3] if len(x) > 3 else None, False, None, n, 0, n, 0) for n, x in enumerate(symbols)]
    r = [(n, ids[x[0]], x[1], x[2], x[3], n, 0) for n, x in enumerate(refs)]
    return CodeGraph.from_rows(spark, f, s, r).with_options(**options)


def names(df):
    return [r["name"] for r in df.collect()]


def edges(g):
    return {(r["src"], r["dst"]) for r in g.edges.collect()}


def test_search_orders_and_takes_signs_literally(spark):
    g = graph(spark, [("a.ts", n, k) for n, k in (("loadConfig", "function"), ("Config", "interface"), ("configure", "function"), ("a_b", "function"), ("axb", "function"), ("p%q", "class"))])
    assert names(lookup.search_symbols(g, "config")) == ["Config", "configure", "loadConfig"]
    assert names(lookup.search_symbols(g, "config", kind="interface")) == ["Config"]
    assert names(lookup.search_symbols(g, "_")) == ["a_b"] and names(lookup.search_symbols(g, "%")) == ["p%q"]
    assert names(lookup.search_symbols(g, "onfig", limit=1)) == ["Config"] and names(lookup.get_symbol(g, "config")) == []
    assert names(lookup.search_symbols(g, "zz")) == [] and len(names(lookup.search_symbols(g, ""))) == 6


def test_trigram_search_equals_scan(spark):
    g = graph(spark, [("a.ts", n, "function") for n in ("loadConfig", "Config", "conConfig", "fig", "onf", "xx", "ÄÖÜconfig")])
    index = trigram.build(g.symbols)
    for q in ("config", "onf", "ig", "", "nothing", "öüc", "Config"):
        assert names(trigram.search(g, index, q)) == names(lookup.search_symbols(g, q)), q


def test_callers_are_distinct_and_complete(spark):
    uses = [(f"src/{x}.ts", f"use_{x}", "doThing", "call") for x in "abc"]
    g = graph(spark, [("src/util.ts", "doThing", "function")], [*uses, ("src/a.ts", "use_a", "doThing", "method"), ("src/a.ts", None, "doThing", "import"), ("src/b.ts", None, "doThing", "call")])
    rows = lookup.find_callers(g, "doThing").collect()
    assert [(r["path"], r["from_symbol"]) for r in rows] == [("src/a.ts", "use_a"), ("src/b.ts", "use_b"), ("src/b.ts", None), ("src/c.ts", "use_c")]
    assert lookup.find_references(g, "doThing").count() == 6 and lookup.find_references(g, "doThing", kind="import").count() == 1
    assert lookup.find_callers(g, "doThing", limit=2).count() == 2


def test_kinds_decide_what_a_call_means(spark):
    symbols = [("a.ts", "main", "function"), ("a.ts", "helper", "function"), ("a.ts", "push", "function"), ("a.ts", "Thing", "class"), ("a.ts", "inner", "function", "Thing")]
    refs = [("a.ts", "main", "helper", "call"), ("a.ts", "main", "push", "method"), ("a.ts", "main", "Thing", "call"), ("a.ts", "main", "inner", "method")]
    assert edges(graph(spark, symbols, refs)) == {("main", "helper")}
    assert edges(graph(spark, symbols, refs, resolution="lenient")) == {("main", "helper"), ("main", "Thing"), ("main", "inner")}


def test_ambiguous_names_stay_unresolved(spark):
    g = graph(spark, [("a.ts", "map", "function")] * 5 + [("a.ts", "caller", "function"), ("a.ts", "few", "function")], [("a.ts", "caller", "map", "call"), ("a.ts", "caller", "few", "call"), ("a.ts", "caller", "ghost", "call")])
    assert edges(g) == {("caller", "few")}
    assert edges(g.with_options(ambiguity_cap=5)) == {("caller", "few"), ("caller", "map")}
    nodes = traverse.neighborhood_nodes(g, "caller")
    assert names(traverse.unresolved_names(g, nodes)) == ["ghost"]


CHAIN = [("a.ts", "top", "main", "call"), ("a.ts", "main", "helper", "call"), ("a.ts", "helper", "leaf", "call")]


def chain(spark, more=()):
    return graph(spark, [("a.ts", n, "function") for n in ("top", "main", "helper", "leaf")], [*CHAIN, *more])


def test_chain(spark):
    g = chain(spark)
    assert names(traverse.find_callees(g, "main")) == ["helper"]
    assert {r["name"]: r["distance"] for r in traverse.impact(g, "leaf").collect()} == {"helper": 1, "main": 2, "top": 3}
    assert {r["name"] for r in traverse.impact(g, "leaf", depth=1).collect()} == {"helper"} and traverse.impact(g, "nothing").count() == 0
    seeds, more, between = ctx.context(g, "helper", 10)
    assert names(seeds) == ["helper"] and set(names(more)) == {"main", "leaf"} and between.count() == 2
    assert set(names(traverse.neighborhood_nodes(g, "helper", 1))) == {"helper", "main", "leaf"}
    assert ctx.query_tokens("fix the Helper-thing, a b!") == ["fix", "the", "helper", "thing"]
    assert ctx.seeds(g, "!").count() == 0


def test_cycles_end_and_never_hold_the_root(spark):
    g = chain(spark, [("a.ts", "leaf", "top", "call"), ("a.ts", "leaf", "leaf", "call")])
    assert {r["name"]: r["distance"] for r in traverse.impact(g, "leaf", depth=6).collect()} == {"helper": 1, "main": 2, "top": 3}
    by_depth = [{r["name"] for r in traverse.impact(g, "leaf", depth=d).collect()} for d in (1, 2, 3)]
    assert by_depth[0] < by_depth[1] < by_depth[2]


def test_impact_takes_the_definition_in_the_calling_file(spark):
    g = graph(spark, [("a.ts", "leaf", "function"), ("b.ts", "run", "function"), ("c.ts", "run", "function")], [("b.ts", "run", "leaf", "call"), ("b.ts", None, "leaf", "call")])
    assert [r["path"] for r in traverse.impact(g, "leaf").collect()] == ["b.ts"]


def test_limits_cut_after_the_order(spark):
    g = graph(spark, [("a.ts", "leaf", "function")] + [(f"f{i}.ts", f"c{i}", "function") for i in range(9)], [(f"f{i}.ts", f"c{i}", "leaf", "call") for i in range(9)])
    assert [r["path"] for r in traverse.impact(g, "leaf", limit=3).collect()] == ["f0.ts", "f1.ts", "f2.ts"]
    assert names(traverse.neighborhood_nodes(g, "leaf", limit=2)) == ["leaf", "c0"]


def changed(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_affected_tests(spark):
    files = ["src/util.ts", "test/util.test.ts", "test/other.test.ts", "src/lonely.ts"]
    g = graph(spark, [(f, f"s{i}", "function") for i, f in enumerate(files)], [("test/util.test.ts", None, "../src/util", "import"), ("test/other.test.ts", None, "../src/other", "import")])
    found = {r["path"]: (r["is_changed"], r["is_test"]) for r in traverse.affected(g, changed(spark, "src/util.ts")).collect()}
    assert found == {"src/util.ts": (True, False), "test/util.test.ts": (False, True)}
    assert [r["path"] for r in traverse.affected(g, changed(spark, "src/lonely.ts", "gone.ts")).collect()] == ["gone.ts", "src/lonely.ts"]
    assert traverse.affected(g, changed(spark)).count() == 0
    assert [r["path"] for r in traverse.find_importers(g, "util").collect()] == ["test/util.test.ts"] and traverse.find_importers(g, "").count() == 0


def test_an_importer_that_a_caller_reached_is_not_followed(spark):
    symbols = [("src/a.ts", "fa", "function"), ("src/b.ts", "fb", "function"), ("src/c.ts", "fc", "function")]
    imports = [("src/b.ts", None, "./a", "import"), ("src/c.ts", None, "./b", "import")]
    by_import = traverse.affected(graph(spark, symbols, imports), changed(spark, "src/a.ts"))
    assert [r["path"] for r in by_import.collect()] == ["src/a.ts", "src/b.ts", "src/c.ts"]
    also_called = traverse.affected(graph(spark, symbols, [*imports, ("src/b.ts", "fb", "fa", "call")]), changed(spark, "src/a.ts"))
    assert [r["path"] for r in also_called.collect()] == ["src/a.ts", "src/b.ts"]


def test_store_replaces_only_one_file(spark):
    store = GraphStore(spark)
    sym = lambda n: (n, "function", None, False, None, 0, 0, 0, 0, 0, 0)
    ref = lambda n: ("alpha", n, "call", 0, 0)
    store.replace_file("a.ts", "typescript", "h1", [sym("alpha")], [ref("x")])
    store.replace_file("b.ts", "typescript", "h2", [sym("beta")], [])
    store.replace_file("a.ts", "typescript", "h3", [sym("gamma")], [ref("y")])
    g = store.graph()
    assert sorted(names(g.symbols)) == ["beta", "gamma"] and names(g.refs) == ["y"] and store.file_hash("a.ts") == "h3"
    assert lookup.search_symbols(g, "alpha").count() == 0
    assert store.remove_file("a.ts") and not store.remove_file("a.ts") and store.graph().refs.count() == 0
    store.close()


def test_stats(spark):
    g = graph(spark, [("a.ts", "f", "function"), ("a.ts", "C", "class")], [("a.ts", "f", "g", "call")])
    row = lookup.stats(g).first()
    assert (row["files"], row["symbols"], row["refs"], row["by_kind"], row["by_lang"]) == (1, 2, 1, {"function": 1, "class": 1}, {"typescript": 1})
    assert render.render_stats(lookup.stats(g)).first()["text"] == "files:   1\nsymbols: 2  (class=1 function=1)\nrefs:    1\nlangs:   typescript=1"
    empty = graph(spark, [])
    assert render.render_stats(lookup.stats(empty)).first()["text"] == "files:   0\nsymbols: 0  (none)\nrefs:    0\nlangs:   none"


def test_rendering(spark):
    f = [(0, "a.ts", "typescript", "h", 1, 0, 0)]
    s = [(0, 0, "run", "method", "Service", True, "run()", 9, 0, 9, 0), (1, 0, "long", "function", None, False, "x" * 89, 0, 0, 0, 0)]
    r = [(0, 0, "main", "run", "call", 4, 0), (1, 0, "main", "run", "method", 7, 0), (2, 0, None, "run", "call", 6, 0)]
    g = CodeGraph.from_rows(spark, f, s, r)
    text = lambda df: df.first()["text"]
    assert text(render.render_symbols(lookup.get_symbol(g, "run"))) == "method export Service.run — a.ts:10  ·  run()"
    assert text(render.render_symbols(lookup.get_symbol(g, "long"))) == "function long — a.ts:1  ·  " + "x" * 87 + "…"
    assert text(render.render_callers(lookup.find_callers(g, "run"))) == "a.ts:5  main, (top level)"
    assert text(render.render_refs(lookup.find_references(g, "run"))) == "a.ts:5  main\na.ts:7  (top level)\na.ts:8  main"
    for df, empty in ((render.render_callers(lookup.find_callers(g, "q")), "No callers."), (render.render_refs(lookup.find_references(g, "q")), "No references."), (render.render_impact(traverse.impact(g, "q")), "No callers — changing this is low-risk."), (render.render_symbols(lookup.get_symbol(g, "q")), "No matching symbols.")):
        assert text(df) == empty
    c = chain(spark)
    assert text(render.render_impact(traverse.impact(c, "leaf", 2))) == "[1 hop] function helper — a.ts:3\n[2 hop] function main — a.ts:2"
    assert text(render.render_affected(traverse.affected(c, changed(spark, "a.ts")))) == "No test files appear affected by 1 changed file(s)."


@pytest.mark.parametrize("path,want", [("test/a.ts", True), ("a.test.ts", True), ("b_test.go", True), ("x/test_a.py", True), ("FooTest.java", True), ("a_spec.rb", True), ("src/latest.ts", True), ("src/a.ts", False), ("contest/a.ts", False), ("test_a.ts", False)])
def test_test_files(spark, path, want):
    assert spark.range(1).select(is_test_file(F.lit(path))).first()[0] is want


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(module_basename(F.lit("src/store.test.ts"))) == "store" and value(module_basename(F.lit("a/.eslintrc.js"))) == "" and value(module_basename(F.lit("Makefile"))) == "Makefile"
    assert value(utf16_length(F.lit("a\U0001f600"))) == 3
    assert value(clipped(F.lit("\U0001f600" * 5), 6)) == "\U0001f600\U0001f600…" and value(clipped(F.lit("\U0001f600" * 3), 6)) == "\U0001f600" * 3
    assert value(clipped(F.lit("abcdef"), 6)) == "abcdef" and value(clipped(F.lit("abcdefg"), 6)) == "abcde…"
    assert value(short_signature(F.lit(""))) == "" and value(short_signature(F.lit("f()"))) == "  ·  f()"
    assert value(contains_literal(F.lit("A%b"), "a%B")) is True
    assert value(token_estimate(F.lit("foobar(x) + 12"))) == 7
    base = lambda s: set(value(import_basenames(F.lit(s))))
    assert "util" in base("../src/util") and "util" in base("../src/util.js") and "other" not in base("../src/util") and "User" in base("app.models.User") and "HashMap" in base("std::collections::HashMap")


def test_evaluation(spark):
    rows = spark.createDataFrame([(i,) for i in (5, 1, 4, 2, 3, 6, 9, 8, 7, 10)], "v int")
    got = {r["p"]: r["v"] for r in evaluate.percentile_floor(rows, "v", (0, 50, 95, 100)).collect()}
    assert got == {0: 1, 50: 6, 95: 10, 100: 10}
    assert evaluate.percentile_floor(rows.limit(0), "v", (50,)).count() == 0
    assert sorted(r["v"] for r in evaluate.systematic_sample(rows, ["v"], 4).collect()) == [1, 3, 6, 8] and evaluate.systematic_sample(rows, ["v"], 40).count() == 10
    assert sorted(r["v"] for r in evaluate.stride_sample(rows, ["v"], 3, 3).collect()) == [1, 4, 7]
    truth = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a"), ("h", "z")], "def string, file string")
    answer = spark.createDataFrame([("f", "a"), ("f", "c"), ("g", "a"), ("x", "a")], "def string, file string")
    per = {r["def"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.accuracy(truth, answer).collect()}
    assert per == {"f": (0.5, 0.5, 0.5), "g": (1.0, 1.0, 1.0), "h": (0.0, 0.0, 0.0)}
    assert evaluate.macro_average(evaluate.accuracy(truth, answer)).first()["f1"] == 0.5
    e = evaluate.token_efficiency(spark.createDataFrame([(10, 100), (10, 300), (20, 100)], "answer_tokens bigint, file_tokens bigint")).first()
    assert (e["queries"], e["answer_tokens"], e["file_tokens"], round(e["reduction_percent"], 3), e["median_factor"]) == (3, 40, 500, 92.0, 10.0)


def test_truth_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"name": "f", "callerFiles": ["a", "b"]}, {"name": "g", "callerFiles": []}]')
    assert sorted(tuple(r) for r in evaluate.read_truth(spark, str(tmp_path / "t.json")).collect()) == [("f", "a"), ("f", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_affected_callers_of_many_roots(spark, seed):
    """The files are those that a walk from each root by itself finds, also where names are defined and called in several files."""
    r = random.Random(seed)
    names_ = [f"n{i}" for i in range(30)] + ["init", "run"]
    where = [(f"f{r.randrange(24)}.ts", n, "function") for n in names_ for _ in range(r.choice([1, 1, 2, 3]) if n[0] == "n" else 8)]
    where = list(dict.fromkeys(where))
    calls = list(dict.fromkeys((f, n, r.choice(names_[:30]), "call") for f, n, _ in where for _ in range(r.choice([0, 1, 1, 2]))))
    g = graph(spark, where, calls)
    own = traverse.roots_of(spark, [n for f, n, _ in where if f in ("f0.ts", "f1.ts", "f2.ts")])
    for depth in (1, 2, 3, 4):
        want = {x["path"] for x in traverse.impacted(g, own, depth).select("path").collect()}
        got = g.files.join(traverse.affected_callers(g, own, depth), "file_id", "left_semi")
        assert {x["path"] for x in got.collect()} == want and want


def test_affected_does_not_walk_from_each_of_many_roots(spark, monkeypatch):
    changed_files, n = [f"src/c{i}.ts" for i in range(4)], 48
    symbols = [(changed_files[i % 4], f"r{i}", "function") for i in range(n)] + [("src/mid.ts", "mid", "function"), ("test/top.ts", "top", "function")]
    calls = [("src/mid.ts", "mid", f"r{i}", "call") for i in range(n)] + [("test/top.ts", "top", "mid", "call")]
    tables = []
    monkeypatch.setattr(traverse, "cut", lambda df, name, owner=None: tables.append(out := cut(df, name, owner)) or out)
    found = traverse.affected(graph(spark, symbols, calls), changed(spark, *changed_files))
    assert [x["path"] for x in found.collect()] == sorted([*changed_files, "src/mid.ts", "test/top.ts"])
    assert max(t.count() for t in tables) <= n + 2  # a row a name, not one for each root that it leads to


@pytest.mark.parametrize("also", [False, True])
def test_affected_sql_function_keeps_no_pairs_of_three_hops(spark, also):
    """A call between names equally far from the nearest root counts if another root is nearer by the callee alone."""
    symbols = [("c.ts", "r1", "function"), ("c.ts", "r2", "function"), ("one.ts", "a", "function"), ("two.ts", "a", "function"), ("b.ts", "b", "function")]
    calls = [("one.ts", "a", "r1", "call"), ("two.ts", "a", "b", "call"), ("b.ts", "b", "r2", "call")] + ([("one.ts", "a", "r2", "call")] if also else [])
    g = graph(spark, symbols, calls)
    want = {"c.ts", "one.ts", "b.ts"} | (set() if also else {"two.ts"})
    register_sql(g)
    found = spark.sql("SELECT path FROM affected(array('c.ts'), 2)")
    assert {x["path"] for x in found.collect()} == want
    assert {x["path"] for x in traverse.affected(g, changed(spark, "c.ts"), 2).collect()} == want
    many = traverse.affected_callers(g, traverse.roots_of(spark, ["r1", "r2"]), 2)
    assert {x["path"] for x in g.files.join(many, "file_id").collect()} == want - {"c.ts"}
    assert "3 AS d" not in found._jdf.queryExecution().analyzed().toString()

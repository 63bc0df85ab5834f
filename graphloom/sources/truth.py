"""Known callers of Python definitions, from the language's own grammar.

A name is followed from its definition through imports of the same tree, so the
answer does not rest on the name alone. It is the yardstick for caller queries;
texts that do not compile give nothing.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "path string, module string, what string, name string, origin string, target string"


def module_of(path: str) -> str:
    """The dotted module of a file."""
    parts = path.rsplit(".", 1)[0].split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def _base(module: str, path: str, level: int, name: str | None) -> str:
    """The module that an import of some level names."""
    if not level:
        return name or ""
    package = module.split(".") if path.endswith("__init__.py") else module.split(".")[:-1]
    package = package[: len(package) - (level - 1)]
    return ".".join([*package, *([name] if name else [])])


def facts_of(path: str, text: str) -> list[tuple]:
    """Rows of FACTS: definitions at module level, names bound by imports, calls of bare names and of module attributes."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    module, out = module_of(path), []
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append((path, module, "def", n.name, module, n.name))
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom):
            origin = _base(module, path, n.level, n.module)
            out += [(path, module, "import", a.asname or a.name, origin, a.name) for a in n.names]
        elif isinstance(n, ast.Import):
            out += [(path, module, "import", a.asname or a.name, a.name, None) for a in n.names]
        elif isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out.append((path, module, "call", n.func.id, None, None))
            elif isinstance(n.func, ast.Attribute):
                base = ast.unparse(n.func.value) if isinstance(n.func.value, ast.Name | ast.Attribute) else None
                if base:
                    out.append((path, module, "member", n.func.attr, base, None))
    return list(dict.fromkeys(out))


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [r for path, text in zip(b["path"], b["text"]) for r in facts_of(path, text)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])


def python_callers(files: DataFrame) -> DataFrame:
    """(path, text) of Python files -> (def, file): module-level definitions, as module.name, and the files that call them."""
    facts = files.select("path", "text").mapInPandas(_facts, FACTS)
    bound = facts.where("what in ('def', 'import')").select("path", "name", "origin", "target")
    bare = facts.where("what = 'call'").select("path", "name").join(bound.where("target is not null"), ["path", "name"]).select("path", "origin", F.col("target").alias("name"))
    # base.name(): base is a module, bound by `import a.b` or by `from a import b`
    modules = bound.select("path", F.col("name").alias("base"), F.when(F.col("target").isNull(), F.col("origin")).otherwise(F.concat_ws(".", "origin", "target")).alias("origin"))
    member = facts.where("what = 'member'").select("path", "name", F.col("origin").alias("base")).join(modules, ["path", "base"]).select("path", "origin", "name")
    defined = facts.where("what = 'def'").select("origin", "name").distinct()
    hits = bare.union(member).distinct().join(defined, ["origin", "name"])
    return hits.select(F.concat_ws(".", "origin", "name").alias("def"), F.col("path").alias("file")).distinct()

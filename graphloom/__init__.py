"""graphloom: a Spark-native engine for code graphs.

Tables of files, symbol definitions and name-based references are kept as
DataFrames; navigation and impact questions over them are relational plans.
"""

from importlib import import_module

__version__ = "0.1.0"

#: What the library offers, by the module it lives in. Loaded when asked for: Python workers import little.
_EXPORTS = {
    "plans.graph": ("CodeGraph",),
    "sources.store": ("GraphStore",),
    "sources.indexer": ("Indexer", "parse_files", "parse_source_udtf"),
    "sources.languages": ("EXTENSIONS", "LANGUAGES", "language_for_path"),
    "sources.parse": ("parse_source",),
    "streaming.changes": ("watch",),
    "operators.traverse": ("affected", "impact", "find_callees", "find_importers", "neighborhood_nodes"),
    "operators.lookup": ("search_symbols", "get_symbol", "find_callers", "find_references", "file_outline", "stats"),
    "operators.context": ("context",),
    "functions.text": ("is_test_file",),
    "tools": ("TOOLS", "call_tool", "register_sql"),
    "server": ("Server",),
    "install": ("merged", "toml_snippet"),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = ["__version__", *_HOME]


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(name)

"""Schemas of the three graph tables and the values their enumerations take."""

from __future__ import annotations

# Kinds and columns of the data model.
SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "enum", "variable")
REF_KINDS = ("call", "method", "import")

FILES = "file_id bigint, path string, lang string, hash string, size bigint, mtime bigint, indexed_at bigint"
SYMBOLS = (
    "symbol_id bigint, file_id bigint, name string, kind string, container string, exported boolean, signature string, "
    "start_row int, start_col int, end_row int, end_col int"
)
REFS = "ref_id bigint, file_id bigint, from_symbol string, name string, kind string, start_row int, start_col int"

#: Defaults of the query operators.
LIMIT = 50
IMPACT_LIMIT = 100
IMPACT_DEPTH = 3
NEIGHBORHOOD_DEPTH = 2
NEIGHBORHOOD_LIMIT = 50
CONTEXT_SYMBOLS = 30
AFFECTED_DEPTH = 4
AMBIGUITY_CAP = 4

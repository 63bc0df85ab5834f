"""The languages that can be indexed, and which files are theirs."""

from __future__ import annotations

# Extension -> language.
EXTENSIONS = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".cs": "csharp", ".php": "php", ".scala": "scala", ".sc": "scala", ".sol": "solidity", ".zig": "zig",
    ".kt": "kotlin", ".kts": "kotlin", ".m": "objc", ".lua": "lua", ".sh": "bash", ".bash": "bash",
    ".ml": "ocaml", ".mli": "ocaml", ".res": "rescript",
}
LANGUAGES = tuple(dict.fromkeys(EXTENSIONS.values()))


def language_for_path(path: str) -> str | None:
    """By the lower-cased text from the last dot on."""
    dot = path.rfind(".")
    return None if dot < 0 else EXTENSIONS.get(path[dot:].lower())

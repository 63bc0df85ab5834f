"""Scalar functions over paths, names and signatures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a test file.
TEST_PATTERNS = (
    r"(?i)(^|/)(tests?|spec|specs|__tests__|e2e|integration)/",
    r"(?i)\.(test|spec)\.[a-z]+$",
    r"(?i)_test\.[a-z]+$",
    r"(?i)(^|/)test_[^/]+\.(py|rb)$",
    r"(?i)(Test|Tests|Spec)\.[a-z]+$",
    r"(?i)_spec\.rb$",
)
TOP_LEVEL = "(top level)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_test_file(path: Column | str) -> Column:
    out = F.lit(False)
    for p in TEST_PATTERNS:
        out = out | _c(path).rlike(p)
    return out


def module_basename(path: Column | str) -> Column:
    """What a file is imported as: after the last slash, before the first dot."""
    return F.substring_index(F.substring_index(_c(path), "/", -1), ".", 1)


def import_basenames(spec: Column | str) -> Column:
    """The basenames an import specifier may mean: its last path segment without a known extension, and the last part of a dotted or qualified name."""
    from ..sources.languages import EXTENSIONS

    last = F.substring_index(_c(spec), "/", -1)
    known = "|".join(e[1:] for e in sorted(EXTENSIONS, key=len, reverse=True))
    bare = F.regexp_replace(last, rf"(?i)\.({known})$", "")
    part = F.element_at(F.split(last, r"::|\\|\."), -1)
    return F.array_distinct(F.filter(F.array(bare, part), lambda x: x != ""))


def contains_literal(text: Column | str, query: Column | str) -> Column:
    """Substring match without case; no character is a wildcard. A str ``query`` is the text looked for."""
    q = F.lit(query.lower()) if isinstance(query, str) else F.lower(query)
    return F.contains(F.lower(_c(text)), q)


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("bigint")


def clipped(text: Column | str, most: int) -> Column:
    """The text, or its first most - 1 characters and an ellipsis if it has more than ``most`` UTF-16 units."""
    t = _c(text)
    astral = t.rlike(r"[\x{10000}-\x{10FFFF}]")
    short = F.concat(F.substring(t, 1, most - 1), F.lit("…"))
    # astral characters take two units: cut the encoded text, and leave no half of one
    head = F.substring(F.encode(t, "UTF-16BE"), 1, 2 * (most - 1))
    half = F.substring(F.hex(head), -4, 2).between("D8", "DB")
    whole = F.when(half, F.substring(head, 1, 2 * (most - 2))).otherwise(head)
    cut = F.concat(F.decode(whole, "UTF-16BE"), F.lit("…"))
    return F.when(utf16_length(t) <= most, t).when(astral, cut).otherwise(short)


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def token_estimate(text: Column | str) -> Column:
    """Approximate count of model tokens: pieces of up to four letters or digits, and single signs."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(r"[A-Za-z0-9]{1,4}|[^\sA-Za-z0-9]"), 0)).cast("bigint")


def short_signature(sig: Column | str) -> Column:
    s = _c(sig)
    return F.when(s.isNull() | (s == ""), "").otherwise(F.concat(F.lit("  ·  "), clipped(s, 88)))


def symbol_line() -> Column:
    """kind [export ][container.]name — path:line[  ·  signature], of columns of a symbol."""
    container = F.when(F.coalesce(F.col("container"), F.lit("")) == "", "").otherwise(F.concat("container", F.lit(".")))
    return F.concat(
        "kind", F.lit(" "), F.when(F.col("exported"), "export ").otherwise(""), container, "name", F.lit(" — "), "path", F.lit(":"), (F.col("start_row") + 1).cast("string"), short_signature("signature")
    )

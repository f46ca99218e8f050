"""Canonical forms of stream ids and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CANONICAL = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def canonical_id(c: Column) -> Column:
    """Lower case with hyphens if c holds 32 hex digits in any spelling (case, hyphens, braces, blanks, urn:uuid:);
    any other text is trimmed and lower-cased; null stays null. Ids already canonical skip the rewriting."""
    text = F.lower(F.trim(c))
    digits = F.regexp_replace(F.regexp_replace(text, r"^\s*\{?\s*urn:uuid:", ""), r"[\s{}\-]", "")
    joined = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(c.rlike(CANONICAL), c).when(digits.rlike("^[0-9a-f]{32}$"), joined).otherwise(text)


def canonical_file(c: Column) -> Column:
    """Slashes instead of backslashes, no leading ./ or /, lower case; null stays null."""
    return F.lower(F.regexp_replace(F.translate(c, "\\", "/"), r"^(?:\./|/)+", ""))

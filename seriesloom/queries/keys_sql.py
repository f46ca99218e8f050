"""Canonical keys in SQL."""

from __future__ import annotations


def cid(c: str) -> str:
    d = f"regexp_replace(regexp_replace(lower(trim({c})), '^\\s*\\{{?\\s*urn:uuid:', ''), '[\\s{{}}-]', '', 'g')"
    return f"CASE WHEN regexp_full_match({d}, '[0-9a-f]{{32}}') THEN {d}[1:8] || '-' || {d}[9:12] || '-' || {d}[13:16] || '-' || {d}[17:20] || '-' || {d}[21:32] ELSE lower(trim({c})) END"


def cfile(c: str) -> str:
    return f"lower(regexp_replace(replace({c}, '\\', '/'), '^(\\./|/)+', ''))"

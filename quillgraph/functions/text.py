"""Text analysis as column expressions: tokens, weighted terms, normal forms, token estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query language.
STOP_WORDS = ["a", "an", "and", "are", "does", "for", "how", "in", "is", "of", "on", "or", "the", "to", "what", "which", "who", "with"]
SYNONYMS = [["auth", "authentication"]]
FIELD_WEIGHTS = {"id": 0.25, "kind": 0.5, "title": 4.0, "summary": 2.5, "content": 1.0, "repo_path": 0.5, "tag": 3.0, "alias": 3.5}
POSITIVE = [
    ["enabled", "enable", "active", "current", "present", "exists", "supported", "healthy", "ready"],
    ["allow", "allowed", "allows", "available"],
]
NEGATIVE = [
    ["disabled", "disable", "inactive", "deprecated", "legacy", "absent", "missing", "removed", "unsupported", "stale", "broken"],
    ["deny", "denied", "denies", "blocked", "forbidden", "unavailable"],
]

POLAR = sorted({w for group in (*POSITIVE, *NEGATIVE) for w in group})


def strings(values: list[str]) -> Column:
    """A literal array of strings, typed even when empty."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def terms(text: Column) -> Column:
    """Distinct sorted search terms: lower-case runs of a-z and 0-9, without stop words, with synonyms."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.array_except(found, strings(STOP_WORDS))
    for group in SYNONYMS:
        named = F.lower(text).rlike("|".join(group))  # most texts hold none, and their terms are found once
        kept = F.when(named & F.arrays_overlap(kept, strings(group)), F.array_union(kept, strings(group))).otherwise(kept)
    return F.sort_array(kept)  # array_except and array_union leave no term twice


def terms_of(text: str) -> list[str]:
    """terms() of one string on the driver, for query texts."""
    found = {t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS}
    for group in SYNONYMS:
        if found & set(group):
            found |= set(group)
    return sorted(found)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def normal(text: Column) -> Column:
    """Lower case, each run of other characters than letters and numbers one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def tags_normal(tags: Column) -> Column:
    """Trimmed, distinct, sorted tags; null as empty."""
    clean = F.filter(F.transform(F.coalesce(tags, strings([])), trimmed), lambda t: t != "")
    return F.sort_array(F.array_distinct(clean))


def slug(text: Column, most: int = 24) -> Column:
    """Lower-case letters and digits with single hyphens, at most ``most`` characters."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most)
    return F.regexp_replace(cut, "-+$", "")


def excerpt(text: Column, most: int) -> Column:
    """White space collapsed; over ``most`` UTF-8 bytes, cut to most - 3 bytes and marked with dots."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    raw = F.encode(plain, "utf-8")
    head = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - 3 - k).cast("string")) for k in range(4)])  # not inside a character
    return F.when(F.octet_length(plain) <= most, plain).otherwise(F.concat(F.trim(head), F.lit("...")))


def polarity(of: Column, words: list[list[str]]) -> Column:
    """For each word group, whether the terms hold one of its words."""
    return F.array(*[F.arrays_overlap(of, strings(group)) for group in words])


def polar(of: Column, kept: bool) -> Column:
    """The terms without the polarity words, or only those."""
    return F.array_intersect(of, strings(POLAR)) if kept else F.array_except(of, strings(POLAR))

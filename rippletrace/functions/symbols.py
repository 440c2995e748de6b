"""Column expressions over symbol names and accessibility identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippletrace.plans import schema as S


def is_builtin(name: Column, names: frozenset[str] = S.BUILTIN_NAMES) -> Column:
    """Names that are never joined: one byte long, too common, or of the platform. ``names`` is a fixed small table."""
    return (F.octet_length(name) <= 1) | name.isin(*sorted(names))


def begins_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def strip_accessor(path: Column) -> Column:
    """Without one accessor suffix at its end."""
    return F.regexp_replace(path, r"\.(rawValue|id|identifier|value)$", "")


def repository_slug(url: Column) -> Column:
    """owner/name of a hosted remote; null for other remotes."""
    found = F.regexp_extract(url, r"^(?:git@github\.com:|https://github\.com/|ssh://git@github\.com/)(.*)$", 1)
    known = url.rlike(r"^(?:git@github\.com:|https://github\.com/|ssh://git@github\.com/)")
    return F.when(known, F.regexp_replace(found, r"(\.git)+$", ""))

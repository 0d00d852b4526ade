"""Column functions on names, zones and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dns_apex(query: Column | str) -> Column:
    """Parent zone of a DNS name: with three or more labels the first one is dropped.

    Lower-cased, surrounding blanks and trailing dots removed. A name without labels gives ``''``.
    """
    q = F.rtrim(F.lower(F.trim(F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")))), F.lit("."))
    labels = F.filter(F.split(q, "\\."), lambda p: p != "")
    return F.when(
        F.contains(q, F.lit(".")) & (F.size(labels) >= 3),
        F.array_join(F.slice(labels, F.lit(2), F.size(labels)), "."),
    ).otherwise(q)


def host_slug(raw: Column | str) -> Column:
    """Short lower-case host name with every other character run turned into one dash."""
    c = F.col(raw) if isinstance(raw, str) else raw
    base = F.regexp_replace(F.lower(F.split_part(c, F.lit("."), F.lit(1))), "[^a-z0-9_-]+", "-")
    base = F.regexp_replace(base, "^-+|-+$", "")
    return F.when(base == "", "host").otherwise(base)


def safe_id(col: Column | str) -> Column:
    """File-safe form of an id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "[^\\p{L}\\p{N}_-]", "_")

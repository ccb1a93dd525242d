"""Canonical JSON and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import canonical_variant


def canonical_json(**fields: Column) -> Column:
    """Canonical JSON of the fields by name, NULLs kept: numbers alike in value are alike in text (S-12).

    Six decimals at most, whole numbers without a point, not-finite ones null, bytes as size and hash. Parts of the fields
    are written so down to the second level.
    """
    return canonical_variant(F.to_variant_object(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 3)


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON (S-13)."""
    return F.sha2(canonical_json(**fields), 256)


def observation_key(kind: Column, ordinal: Column, path: Column) -> Column:
    """``kind:000001:<hash16>`` (S-24)."""
    return F.format_string("%s:%06d:%s", kind, ordinal.cast("long"), F.substring(F.sha2(path, 256), 1, 16))

"""Strict JSON, one canonical text form, and hashes over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import _col


def strict_json(c) -> Column:
    """Variant, or null when the text is not JSON, repeats a key, or holds NaN or Infinity."""
    return F.try_parse_json(_col(c))


def canonical_json(c) -> Column:
    """Sorted keys, no blanks, unicode kept; null for text that is not strict JSON."""
    return F.to_json(F.try_parse_json(_col(c)))


def canonical_struct(**fields) -> Column:
    """Canonical text of named columns (name order), with nulls written out."""
    cols = [_col(fields[k]).alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def sha256_hex(c) -> Column:
    return F.sha2(_col(c), 256)


def event_id(*cols) -> Column:
    """SHA-256 of the canonical identity array of the given columns."""
    parts = [F.coalesce(F.to_json(F.struct(_col(c).alias("v"))), F.lit("{}")) for c in cols]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def variant(c, path: str, kind: str = "string") -> Column:
    """Field of a variant in a type, null when absent or of another type."""
    return F.try_variant_get(_col(c), path, kind)


def variant_type(c, path: str) -> Column:
    """VOID for a JSON null, null for an absent field, else the stored type name."""
    return F.schema_of_variant(F.variant_get(_col(c), path, "variant"))

"""Hash keys of models: surrogate keys, vault hash keys and change hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins in hashed text (fixed values).
NULL_MARK = "^^"
SEPARATOR = "|"
GHOST_KEY = "0" * 32


def text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_MARK))


def hash_key(*columns: str, algorithm: str = "md5") -> Column:
    """The hash of the columns as text, joined by a bar, nulls marked; algorithm is md5, sha1 or sha256."""
    joined = F.concat_ws(SEPARATOR, *map(text, columns))
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[algorithm](joined)


def hash_diff(*columns: str, algorithm: str = "md5") -> Column:
    """The hash of the descriptive columns in alphabetical order; a change of any of them changes it."""
    return hash_key(*sorted(columns), algorithm=algorithm)


def surrogate_key(*columns: str) -> Column:
    """md5 of the key columns as text, joined by a dash; nulls are marked."""
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("_null_")) for c in columns]))

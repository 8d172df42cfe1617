"""Content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_ID_TEXT_CHARS = 200
CHUNK_ID_LENGTH = 16


def chunk_id(accession: Column, section: Column, index: Column, text: Column) -> Column:
    """Id of a chunk from its filing, section, position and first characters."""
    bar = F.lit("|")
    raw = F.concat(
        accession, bar, section, bar, index.cast("string"), bar,
        F.substring(text, 1, CHUNK_ID_TEXT_CHARS),
    )
    return F.substring(F.sha1(F.encode(raw, "UTF-8")), 1, CHUNK_ID_LENGTH)


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def path_safe(accession: Column) -> Column:
    return F.replace(accession, F.lit("/"), F.lit("_"))


def is_sha256(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit("^[0-9a-f]{64}$")), F.lit(False))

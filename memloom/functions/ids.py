"""Content-derived identities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import normalize_text

_NUL = chr(0)


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a NUL so that boundaries count."""
    pieces = [piece for part in parts for piece in (part, F.lit(_NUL))]
    return F.sha2(F.concat(*pieces), 256)


def short_hash(*parts: Column) -> Column:
    return F.substring(content_hash(*parts), 1, 16)


def item_id(scope_key: Column, hash_: Column) -> Column:
    return F.concat(F.lit("item_"), short_hash(scope_key, hash_))


def entity_id(scope_key: Column, name_norm: Column) -> Column:
    return F.concat(F.lit("ent_"), short_hash(scope_key, name_norm))


def relation_id(from_: Column, to: Column, type_: Column) -> Column:
    return F.concat(F.lit("rel_"), short_hash(from_, to, type_))


def hash_of_content(content: Column) -> Column:
    return content_hash(normalize_text(content))

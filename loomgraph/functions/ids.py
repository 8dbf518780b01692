"""Deterministic identity: every id is a prefix and 32 hex digits of the SHA-256 of a canonical string."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, functions as F

#: Fixed: the characters that count as white space (Java's \\s knows only the ASCII ones).
SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def minted(prefix: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(canonical.cast("binary"), 256), 1, 32))


def falsy(c) -> Column:
    """Text of c, where null, 0 and the empty string are all the empty string."""
    text = col(c).cast("string")
    return F.when(text.isNull() | (text == "0"), "").otherwise(text)


def joined(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_hash(text) -> Column:
    return F.sha2(F.coalesce(col(text), F.lit("")).cast("binary"), 256)


def canonical_key(entity_type, name) -> Column:
    """type:name in lower case, runs of white space as one dash, other characters than a-z 0-9 - dropped.

    The name is stripped before characters are dropped, so what is left may begin or end with a dash.
    """
    flat = F.regexp_replace(strip(F.lower(col(name))), f"{SPACE}+", " ")
    slug = F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9\\- ]", ""), " ", "-")
    return F.concat(F.lower(col(entity_type)), F.lit(":"), slug)


def entity_id(key) -> Column:
    return minted("entity", col(key))


def source_file_id(path, hash_) -> Column:
    return minted("src", joined(col(path), col(hash_)))


def element_id(src, element_type, page, sort, hash_) -> Column:
    return minted("elem", joined(col(src), col(element_type), falsy(page), falsy(sort), F.substring(col(hash_), 1, 16)))


def chunk_id(src, chunk_type, hash_) -> Column:
    return minted("chunk", joined(col(src), col(chunk_type), col(hash_)))


def relationship_id(kind, source, target) -> Column:
    return minted("rel", joined(col(kind), col(source), col(target)))


def evidence_id(src, source_type, context, hash_) -> Column:
    return minted("evid", joined(col(src), col(source_type), col(context), F.substring(col(hash_), 1, 16)))


def image_id(src, hash_) -> Column:
    return minted("img", joined(col(src), col(hash_)))


def region_id(image, region_type, label, index) -> Column:
    return minted("vr", joined(col(image), col(region_type), falsy(label), col(index)))


def big_int(seed) -> Column:
    """The first 64 bits of the SHA-256, modulo 2 ** 62."""
    head = F.conv(F.substring(F.sha2(col(seed).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(2**62).cast("decimal(20,0)")).cast("bigint")


def big_int_of(seed: str) -> int:
    return int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big") % 2**62


def guid_of(seed: str, space: str = "loomgraph") -> str:
    """A name-based UUID; used on the driver, for tens of parts."""
    return str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_DNS, space), seed))

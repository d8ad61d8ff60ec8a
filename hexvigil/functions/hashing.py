"""Digest columns: SHA-256 of text, keyed HMAC, canonical row hash, uuid5."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexvigil.functions.bind import once

BLOCK = 64


def sha256_text(col: Column) -> Column:
    return F.sha2(col, 256)


def indicator_hash(col: Column | str) -> Column:
    """T5: SHA-256 of the trimmed, lower-case indicator."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sha2(F.lower(F.trim(c)), 256)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex under one shared key, in plain expressions (two nested digests)."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def hmac_column_key(key_hex: Column, message: Column) -> Column:
    """HMAC-SHA256 under a per-row key of 32 bytes given in hex (session keys, chain links)."""
    octets = F.transform(
        F.sequence(F.lit(1), F.lit(63), F.lit(2)),
        lambda i: F.conv(F.substr(key_hex, i, F.lit(2)), 16, 10).cast("long"),
    )

    def pad(key: Column, value: int) -> Column:
        mixed = F.transform(key, lambda b: F.lpad(F.hex(b.bitwiseXOR(F.lit(value).cast("long"))), 2, "0"))
        return F.unhex(F.concat(F.array_join(mixed, ""), F.lit(f"{value:02x}" * 32)))

    def digest(key: Column) -> Column:
        first = F.sha2(F.concat(pad(key, 0x36), F.encode(message, "UTF-8")), 256)
        return F.sha2(F.concat(pad(key, 0x5C), F.unhex(first)), 256)

    return once(octets, digest)


def indicator_hmac(key: bytes, col: Column | str) -> Column:
    """T5: keyed indicator hash, equal at every holder of the key."""
    c = F.col(col) if isinstance(col, str) else col
    return hmac_sha256(key, F.lower(F.trim(c)))


def session_key(key: bytes, session: Column) -> Column:
    """T5: key of one session, sha256(key + session id), in hex."""
    return F.sha2(F.concat(F.lit(key), F.encode(session, "UTF-8")), 256)


def row_hash(columns: list[str]) -> Column:
    """H1: SHA-256 of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) of ``name`` within a namespace given as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1),
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def packed(name: Column) -> Column:
    """A name in bytes, trailing hex digits (16 to 128 of them) two a byte and their number last: half a hash's length."""
    digits = F.regexp_extract(name, r"(?:[0-9a-f]{2}){8,64}\z", 0)

    def split(text: Column) -> Column:
        octets = (F.length(text) / 2).cast("int")
        head = F.substring(name.cast("binary"), F.lit(1), F.octet_length(name) - F.length(text))
        return F.concat(head, F.unhex(text), F.unhex(F.lpad(F.hex(octets.cast("long")), 2, "0")))

    return once(digits, split)


def unpacked(name: Column) -> Column:
    """The name that ``packed`` took."""

    def joined(x: Column) -> Column:
        octets = F.conv(F.hex(F.substring(x, F.length(x), F.lit(1))), 16, 10).cast("int")
        return once(F.length(x) - 1 - octets, lambda head: F.concat(F.substring(x, F.lit(1), head).cast("string"), _digits(x, head)))

    return once(name, joined)


def _digits(name: Column, head: Column) -> Column:
    return F.lower(F.hex(F.substring(name, head + 1, F.length(name) - 1 - head)))

"""Keyed hashes, sealed records and integrity checks (optional layer)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 under one key, as a JVM expression (RFC 2104: two nested hashes over padded keys)."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in padded))
    outer = F.lit(bytes(b ^ 0x5C for b in padded))
    return sha256(F.concat(outer, sha256(F.concat(inner, message.cast("binary")))))


def _masked(digits: Column, mask: int) -> Column:
    """A key of 64 hexadecimal digits, XORed with a byte and padded with it to a block: four bytes at a time, as numbers."""
    word = int.from_bytes(bytes([mask]) * 4, "big")
    parts = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(word)) for i in range(8)]
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 8, "0") for p in parts], F.lit(f"{mask:02x}" * (BLOCK - 32))))


def masked_keys(key: Column) -> Column:
    """What a key of 32 bytes begins its two hashes with: made once for a term or centre, used for all its labels.

    The key is bound to a variable, so that it is computed once and not for each part.
    """
    both = lambda h: F.when(F.length(h) == 64, F.struct(_masked(h, 0x36).alias("inner"), _masked(h, 0x5C).alias("outer")))
    return F.element_at(F.transform(F.array(F.hex(key)), both), 1)


def hmac_masked(masked: Column, message: Column) -> Column:
    """HMAC-SHA256 where each row has a key of its own, given as ``masked_keys``; null in, null out."""
    return sha256(F.concat(masked["outer"], sha256(F.concat(masked["inner"], message.cast("binary")))))


def int32_le(n: Column) -> Column:
    """Numbers as four little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def term_key(master: bytes, term: Column) -> Column:
    """Key of a term or centre."""
    return hmac_sha256(master, term)


def centre_key(master: bytes, centre: Column) -> Column:
    """Key of a visual word: over its number as four little-endian bytes."""
    return hmac_sha256(master, int32_le(centre))


def label(key: Column, position: Column) -> Column:
    """Opaque label of a posting: the term's or centre's key over the posting's position."""
    return label_masked(masked_keys(key), position)


def label_masked(masked: Column, position: Column) -> Column:
    """The same, from keys that are masked already."""
    return hmac_masked(masked, int32_le(position))


def seal(payload: Column, key: bytes, label_: Column) -> Column:
    """Authenticated encryption of a record, bound to its label."""
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), label_)


def unseal(sealed: Column, key: bytes, label_: Column) -> Column:
    """The record; the job fails where record and label do not belong together."""
    return F.aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), label_)


def checked(value: Column, found: Column, wanted: Column) -> Column:
    """``value`` where the stored label is the wanted one; the job fails elsewhere."""
    return F.when(found.eqNullSafe(wanted), value).otherwise(F.raise_error(F.lit("label does not match its record")))

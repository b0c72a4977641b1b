"""Binary keys: 16-byte prefix, kind tag at byte 17, 15-byte digest; 16-byte keys name modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XOR_LENGTH, PREFIX, ZERO = 32, 16, b"\0" * 16


def prefix(key: Column) -> Column:
    return F.substring(key, 1, PREFIX)


def byte_at(key: Column, at: int) -> Column:
    """One-based byte as int."""
    return F.conv(F.hex(F.substring(key, at, 1)), 16, 10).cast("int")


def kind_tag(key: Column) -> Column:
    return byte_at(key, PREFIX + 1)


def is_wip(key: Column) -> Column:
    """The owner is not persistent: the first byte is odd."""
    return F.coalesce(byte_at(key, 1) % 2 == 1, F.lit(False))


def is_module(key: Column) -> Column:
    return F.length(key) == PREFIX


def is_xor_keyed(kind: Column) -> Column:
    """Theorems, rules and experiences carry the XOR of their constituents as prefix."""
    return kind.isin(2, 8, 0x12, 0x22, 0x32, 0x42)


def half(hash_: Column, which: int) -> Column:
    """First (0) or second (1) half of a 16-byte hash as a signed bigint; the negative base keeps the sign."""
    return F.conv(F.hex(F.substring(hash_, 1 + 8 * which, 8)), 16, -10).cast("bigint")


def xor_prefix(hashes: Column) -> Column:
    """XOR of 16-byte hashes, order-free; 16 zero bytes for none."""
    part = lambda w: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: s.bitwiseXOR(half(h, w)))
    return F.unhex(F.concat(*(F.lpad(F.hex(part(w)), 16, "0") for w in (0, 1))))


def with_prefix(key: Column, new: Column) -> Column:
    """Re-key: another prefix, the same rest."""
    return F.concat(new, F.substring(key, PREFIX + 1, 1 << 20))


def retag(key: Column, tag: int) -> Column:
    """The same fact under another kind tag (rule faces of a theorem)."""
    return F.concat(prefix(key), F.lit(bytes([tag])), F.substring(key, PREFIX + 2, 1 << 20))


def face(key: Column) -> Column:
    """What faces of one fact share: the key without its tag."""
    return F.concat(prefix(key), F.substring(key, PREFIX + 2, 1 << 20))

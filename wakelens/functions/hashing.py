"""Pseudonyms, sampling order and hash splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(value: Column, length: int) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def speaker_pseudonym(value: Column) -> Column:
    return F.concat(F.lit("spk_"), short_hash(value, 12))


def identity_pseudonym(value: Column) -> Column:
    hashed = F.concat(F.lit("id_"), short_hash(value, 10))
    return F.when(value.isNull(), F.lit("")).otherwise(hashed)


def order_key(seed, *parts: Column) -> Column:
    """Seeded, engine-independent sampling order: sha256 of ``seed:part:…``."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws(":", first.cast("string"), *[p.cast("string") for p in parts]), 256)


def hash_bucket(hex_text: Column, digits: int = 2) -> Column:
    """Leading hex digits as a number: monotone in the hash, evenly filled."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("int")


def eval_split(identity: Column, modulus: int = 5) -> Column:
    head = F.conv(F.substring(F.sha1(identity), 1, 8), 16, 10).cast("long")
    return F.when(head % modulus == 0, F.lit("eval")).otherwise(F.lit("train"))

"""Identities and fingerprints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(rating: Column, title: Column, body: Column, reply: Column) -> Column:
    """SHA-256 of what a review says; votes do not count, and null fields are empty."""
    unit = chr(31)
    return F.sha2(F.concat_ws(unit, rating.cast("string"), *(F.coalesce(x, F.lit("")) for x in (title, body, reply))), 256)


def author_hash(store: Column, author: Column) -> Column:
    return F.when(author.isNotNull(), F.sha2(F.concat(store, F.lit(":"), author), 256))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_position(key: Column) -> Column:
    """A place in [0, 1) from the first 64 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_of(key: Column, source: Column, published: float = 0.1, written: float = 0.35) -> Column:
    """eval for a share of keys that depends on the source, else train."""
    share = F.when(source == "written", written).otherwise(published)
    return F.when(split_position(key) < share, "eval").otherwise("train")


def version_of(model: Column, *parts: Column) -> Column:
    """A generator's version: its model and twelve digits of what it was given."""
    return F.concat_ws("-", model, F.substring(F.sha2(F.concat_ws(chr(31), *parts), 256), 1, 12))


def source_key(store: Column, country: Column, language: Column) -> Column:
    """The feed that a review came from."""
    return F.concat_ws(":", store, F.coalesce(F.when(store == "app_store", country).otherwise(language), F.lit("unknown")))

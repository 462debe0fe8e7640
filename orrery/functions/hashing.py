"""Digests of normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.text import collapse_whitespace, normalize_body, normalize_tac, text


def source_hash(c: Column | str) -> Column:
    return F.sha2(collapse_whitespace(c), 256)


def body_hash(c: Column | str) -> Column:
    return F.md5(normalize_body(c))


def tac_hash(c: Column | str) -> Column:
    return F.md5(normalize_tac(c))


def pair_hash(tac: Column | str, body: Column | str) -> Column:
    return F.md5(F.concat(normalize_tac(tac), F.lit("|"), normalize_body(body)))


def row_hash(prompt: Column | str, completion: Column | str) -> Column:
    """Of the compact JSON object of both texts, keys in order."""
    return F.sha2(F.to_json(F.struct(text(prompt).alias("input"), text(completion).alias("output"))), 256)


def stable_hash(*columns: str) -> Column:
    """Of the JSON object of the columns, in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)

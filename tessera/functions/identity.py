"""Reproducible identity: SHA-256 over length-framed fields, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodes import _col, is_text


def _u32(n: Column) -> Column:
    return F.lpad(F.hex(n), 8, "0")


def _i64(n: Column) -> Column:
    return F.lpad(F.hex(n), 16, "0")  # hex of a negative long is its two's complement


def framed(value: Column) -> Column:
    """The UTF-8 length as four bytes, then the bytes, all in hex."""
    return F.concat(_u32(F.octet_length(value)), F.hex(F.encode(value, "UTF-8")))


def _sha256(hexed: Column) -> Column:
    return F.unhex(F.sha2(F.unhex(hexed), 256))


def atom_id(language: Column | str, content: Column | str) -> Column:
    """What a string says in its language: placeholders count by their places, not by their markup."""
    nodes = F.transform(_col(content), lambda n: F.when(is_text(n), F.concat(F.lit("00"), framed(n["data"]))).otherwise(F.lit("01")))
    return _sha256(F.concat(F.lit("00"), framed(_col(language)), F.array_join(nodes, "")))


def row_digest(language: Column | str, content: Column | str) -> Column:
    """The exact row, markup included."""
    nodes = F.transform(_col(content), lambda n: F.concat(F.when(is_text(n), F.lit("00")).otherwise(F.lit("01")), framed(n["data"])))
    return _sha256(F.concat(F.lit("01"), framed(_col(language)), F.array_join(nodes, "")))


def observation_id(kind: Column | str, subjects: Column | str, recorded_at: Column | str, effective_at: Column | str, canonical_payload: Column | str) -> Column:
    """All five fields of an observation; the payload must be canonical JSON already."""
    who = _col(subjects)
    return _sha256(F.concat(F.lit("00"), framed(_col(kind)), _u32(F.size(who)), F.array_join(F.transform(who, F.hex), ""), _i64(F.unix_micros(_col(recorded_at))), _i64(F.unix_micros(_col(effective_at))), framed(_col(canonical_payload))))

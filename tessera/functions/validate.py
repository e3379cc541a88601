"""Validation that fails loudly: the guarded column is the value itself, so it can't be optimised away while it is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodes import PLACEHOLDER, TEXT, _col

#: Language tags of RFC 5646; group 2 is the script, group 3 the region.
LANGTAG = (
    r"(?i)^([a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(?:-([a-z]{4}))?(?:-([a-z]{2}|[0-9]{3}))?"
    r"(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"
)
#: Tags that are well formed but can't have a region: private use alone, and those registered before the grammar was.
OTHER_TAGS = (
    r"(?i)^(?:x(?:-[a-z0-9]{1,8})+|en-gb-oed|i-(?:ami|bnn|default|enochian|hak|klingon|lux|mingo|navajo|pwn|tao|tay|tsu)"
    r"|sgn-(?:be-fr|be-nl|ch-de)|art-lojban|cel-gaulish|no-(?:bok|nyn)|zh-(?:guoyu|hakka|min|min-nan|xiang))$"
)
_BLANK = r"^\p{IsWhite_Space}*$"


def language_outcome(tag: Column | str) -> Column:
    """ok, missing_region or malformed (which a null tag is too)."""
    t = _col(tag)
    return F.when(t.rlike(OTHER_TAGS), "missing_region").when(t.rlike(LANGTAG), F.when(F.regexp_extract(t, LANGTAG, 3) != "", "ok").otherwise("missing_region")).otherwise("malformed")


def kind_ok(kind: Column | str) -> Column:
    """A kind is any label that isn't blank; it is kept to the letter."""
    return F.coalesce(~_col(kind).rlike(_BLANK), F.lit(False))


def nodes_ok(content: Column | str) -> Column:
    return F.coalesce(F.forall(_col(content), lambda n: n["node_kind"].isin(TEXT, PLACEHOLDER) & n["data"].isNotNull()), F.lit(False))


def subjects_ok(subjects: Column | str) -> Column:
    return F.coalesce(F.forall(_col(subjects), lambda s: F.octet_length(s) == 32), F.lit(False))


def _guard(ok: Column, value: Column, code: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{code}: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string"))


def language_tag(tag: Column | str) -> Column:
    t = _col(tag)
    outcome = language_outcome(t)
    return F.when(outcome == "ok", t).otherwise(F.raise_error(F.concat(F.lit("InvalidLanguageTag "), outcome, F.lit(": "), F.coalesce(t, F.lit("null")))).cast("string"))


def kind(label: Column | str) -> Column:
    return _guard(kind_ok(label), _col(label), "InvalidKind")


def content(nodes: Column | str) -> Column:
    n = _col(nodes)
    return F.when(nodes_ok(n), n).otherwise(F.raise_error(F.lit("UnknownNodeKind")).cast("array<struct<node_kind:string,data:string>>"))


def subjects(who: Column | str) -> Column:
    w = _col(who)
    return F.when(subjects_ok(w), w).otherwise(F.raise_error(F.lit("SchemaMismatch: a subject isn't 32 bytes wide")).cast("array<binary>"))


def timestamp(at: Column | str) -> Column:
    t = _col(at)
    return F.when(t.isNotNull(), t).otherwise(F.raise_error(F.lit("SchemaMismatch: a time is null")).cast("timestamp"))

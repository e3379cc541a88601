"""Schemas of atoms and observations, and the errors that malformed rows and calls raise."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([T.StructField("node_kind", T.StringType()), T.StructField("data", T.StringType())])
CONTENT = T.ArrayType(NODE)
ATOMS = T.StructType(
    [
        T.StructField("atom_id", T.BinaryType()),  # matches by what a string says; markup variants share it
        T.StructField("row_digest", T.BinaryType()),  # tells exact rows apart; never returned
        T.StructField("language", T.StringType()),
        T.StructField("content", CONTENT),
    ]
)
OBSERVATIONS = T.StructType(
    [
        T.StructField("observation_id", T.BinaryType()),
        T.StructField("kind", T.StringType()),
        T.StructField("subjects", T.ArrayType(T.BinaryType())),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("effective_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)
ATOM_INPUT = T.StructType([T.StructField("language", T.StringType()), T.StructField("content", CONTENT)])
OBSERVATION_INPUT = T.StructType(OBSERVATIONS.fields[1:])


class StoreError(Exception):
    """Base of everything that a store or a validation raises on purpose."""


class SchemaMismatch(StoreError):
    """A column is missing, has another type, or holds a null or a digest of the wrong width."""


class InvalidLanguageTag(StoreError):
    """A tag that isn't well formed, or has no region."""


class UnknownNodeKind(StoreError):
    pass


class InvalidKind(StoreError):
    pass


class InvalidPayload(StoreError):
    pass


class BackendError(StoreError):
    """The file system refused: the dataset is there already, isn't there, or another writer was first."""


class ParseError(ValueError):
    """A segment that can't be parsed; code is one of unknown_tag, unsupported_construct, unknown_entity, malformed."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


def require(columns: T.StructType, wanted: T.StructType) -> None:
    """Raise SchemaMismatch unless every wanted column is there with its type; nullability and further columns don't matter."""
    for field in wanted.fields:
        found = next((f for f in columns.fields if f.name == field.name), None)
        if found is None:
            raise SchemaMismatch(f"column {field.name} is missing")
        if found.dataType.simpleString() != field.dataType.simpleString():
            raise SchemaMismatch(f"column {field.name} is {found.dataType.simpleString()}, not {field.dataType.simpleString()}")

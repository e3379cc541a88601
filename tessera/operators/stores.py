"""Stores of atoms and observations: insert-only merges, four read queries, and maintenance that never changes results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import validate as V
from ..functions.canonical import canonical_json
from ..functions.identity import atom_id, observation_id, row_digest
from ..model import ATOM_INPUT, ATOMS, OBSERVATION_INPUT, OBSERVATIONS, SchemaMismatch, require
from ..sources.manifest import Dataset, Manifest, RemovalStats


def encode_atoms(rows: DataFrame) -> DataFrame:
    """Validated atoms with both keys, each exact row once. Input: language, content; further columns are left behind.

    Copies go by hashing where they are read, before keys are made, so a task holds what is distinct and sorts none of
    its input. What remains moves to its digest and is made unique by that: strings that aren't valid UTF-8 may differ
    and have the same one.
    """
    require(rows.schema, ATOM_INPUT)
    valid = rows.select(V.language_tag("language").alias("language"), V.content("content").alias("content")).distinct()
    keyed = valid.select(atom_id("language", "content").alias("atom_id"), row_digest("language", "content").alias("row_digest"), "language", "content")
    return keyed.repartition("row_digest").dropDuplicates(["row_digest"])


def decode_atoms(stored: DataFrame) -> DataFrame:
    """language and content of stored atoms. One invalid row fails the whole read, whichever columns are used of it."""
    require(stored.schema, ATOM_INPUT)
    # The check is a filter, which column pruning can't remove.
    return stored.where(V.language_tag("language").isNotNull() & V.content("content").isNotNull()).select("language", "content")


def encode_observations(rows: DataFrame) -> DataFrame:
    """Validated observations with their key, each once. A null effective time means the time of recording, a null payload JSON null; the payload is stored in canonical form. Copies go as those of atoms do."""
    require(rows.schema, OBSERVATION_INPUT)
    valid = rows.select(
        V.kind("kind").alias("kind"),
        V.subjects("subjects").alias("subjects"),
        V.timestamp("recorded_at").alias("recorded_at"),
        F.coalesce("effective_at", V.timestamp("recorded_at")).alias("effective_at"),
        canonical_json("payload").alias("payload"),
    ).distinct()
    key = observation_id("kind", "subjects", "recorded_at", "effective_at", "payload")
    return valid.select(key.alias("observation_id"), *valid.columns).repartition("observation_id").dropDuplicates(["observation_id"])


def decode_observations(stored: DataFrame) -> DataFrame:
    """The five fields of stored observations. One invalid row fails the whole read, whichever columns are used of it."""
    require(stored.schema, OBSERVATION_INPUT)
    checked = [V.kind("kind"), V.subjects("subjects"), V.timestamp("recorded_at"), V.timestamp("effective_at"), _payload("payload")]
    return stored.where(reduce(lambda a, b: a & b, (c.isNotNull() for c in checked))).select("kind", "subjects", "recorded_at", "effective_at", "payload")


def _payload(c: str) -> Column:
    """Stored payloads are canonical, so a well-formed one is its own canonical form and nothing has to be parsed twice."""
    well_formed = F.try_parse_json(c).isNotNull()
    return F.when(well_formed, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("InvalidPayload: "), F.coalesce(F.substring(c, 1, 200), F.lit("null")))).cast("string"))


class Store:
    """One dataset at a pinned version. Writes and maintenance move this handle to the version they made; other handles stay."""

    schema: T.StructType
    key: str
    cluster: tuple[str, ...]  # order of indexed fragments: what is looked up first, then what else finds few rows
    blooms: tuple[str, ...]
    index_names: tuple[str, ...]
    #: Fragments below this size are merged by `compact`; larger ones stay as they are.
    COMPACT_BYTES = 1 << 30

    def __init__(self, data: Dataset, manifest: Manifest) -> None:
        self.data, self.manifest = data, manifest

    @classmethod
    def open(cls, spark: SparkSession, uri: str, version: int | None = None):  # noqa: ANN206
        """The latest version, or an older one that hasn't been cleaned up; fails if there is no dataset."""
        data = Dataset(spark, uri)
        manifest = data.read(version)
        for fragment in manifest.fragments:
            require(spark.read.parquet(data.location(fragment)).schema, cls.schema)
        return cls(data, manifest)

    @classmethod
    def create(cls, spark: SparkSession, uri: str):  # noqa: ANN206
        """An empty dataset; fails if there is one."""
        data = Dataset(spark, uri)
        return cls(data, data.create())

    @property
    def version(self) -> int:
        return self.manifest.version

    def stored(self) -> DataFrame:
        """All rows with their keys, unchecked."""
        return self.data.scan(self.manifest.fragments, self.schema)

    def _put(self, encoded: DataFrame) -> int:
        """Insert what isn't stored by key. One call is one version, and none if there is nothing to insert; returns rows inserted.

        Only keys of the stored rows are read. Both sides hash on the key unless the new rows are few enough for the
        optimiser to broadcast what remains of them.
        """
        known = self.stored().select(self.key)
        fresh = encoded.join(known, self.key, "left_anti") if self.manifest.fragments else encoded
        fragment = self.data.write(fresh, *self.blooms)
        n = self.data.scan((fragment,), self.schema).count()
        if not n:
            self.data.remove(fragment)
            return 0
        self.manifest = self.data.commit(self.manifest, fragments=(*self.manifest.fragments, fragment))
        return n

    def _clustered(self, rows: DataFrame) -> str:
        """Write rows in order of what is looked up, so that row group statistics and bloom filters prune."""
        return self.data.write(rows.repartitionByRange(*self.cluster).sortWithinPartitions(*self.cluster), *self.blooms)

    def _index(self, rows: DataFrame, fragment: str) -> dict[str, object]:
        """Side tables of the rows of a new indexed fragment, as changes of the manifest."""
        return {}

    def ensure_indexes(self) -> bool:
        """Build the indexes that are missing over everything stored; False, and no new version, if all are there."""
        if self.manifest.indexes == self.index_names:
            return False
        self._reindex(self.manifest.fragments, ())
        return True

    def optimize_indexes(self) -> bool:
        """Extend the indexes to fragments written since; results never depend on it."""
        behind = tuple(f for f in self.manifest.fragments if f not in self.manifest.indexed)
        if self.manifest.indexes != self.index_names or not behind:
            return False
        self._reindex(behind, self.manifest.indexed)
        return True

    def _reindex(self, fragments: tuple[str, ...], rest: tuple[str, ...]) -> None:
        changes: dict[str, object] = {"indexes": self.index_names, "side": self.manifest.side if rest else ()}
        if fragments:
            rows = self.data.scan(fragments, self.schema)
            new = self._clustered(rows)
            changes |= {"fragments": (*rest, new), "indexed": (*rest, new)} | self._index(self.data.scan((new,), self.schema), new)
            if rest and "side" in changes:
                changes["side"] = (*self.manifest.side, *changes["side"])  # type: ignore[misc]
        self.manifest = self.data.commit(self.manifest, **changes)

    def compact(self) -> bool:
        """Merge the small fragments into one, indexes included if there are any; False, and no new version, if there is at most one."""
        small = tuple(f for f in self.manifest.fragments if self.data.size(f) < self.COMPACT_BYTES)
        if len(small) < 2:
            return False
        new = self._clustered(self.data.scan(small, self.schema))
        keep = lambda names: (*(f for f in names if f not in small), new)
        changes: dict[str, object] = {"fragments": keep(self.manifest.fragments)}
        if self.manifest.indexes:
            changes["indexed"] = keep(self.manifest.indexed)
            behind = tuple(f for f in small if f not in self.manifest.indexed)
            if behind:
                side = self._index(self.data.scan(behind, self.schema), new).get("side", ())
                changes["side"] = (*self.manifest.side, *side)  # type: ignore[misc]
        self.manifest = self.data.commit(self.manifest, **changes)
        return True

    def expose(self, name: str) -> DataFrame:
        """Make this version's rows a temporary view for SQL."""
        rows = self.stored()
        rows.createOrReplaceTempView(name)
        return rows

    def cleanup_versions(self, retain: int, unlisted_s: float = 7 * 86_400) -> RemovalStats:
        """Drop all versions but the newest `retain`, which can't be opened again afterwards, and what failed writes left longer than unlisted_s ago."""
        return self.data.cleanup(retain, unlisted_s)

    def verify(self) -> DataFrame:
        """Stored rows whose key doesn't follow from their content, or that aren't valid: normally none."""
        raise NotImplementedError


class AtomStore(Store):
    """Content-addressed strings. Rows are unique by row digest; an atom id may have several, one for each markup."""

    schema, key, cluster, index_names = ATOMS, "row_digest", ("atom_id",), ("atom_id_idx",)
    blooms = ("atom_id",)

    def put_atoms(self, atoms: DataFrame) -> int:
        return self._put(encode_atoms(atoms))

    def get_atoms(self, digest: bytes) -> DataFrame:
        """All markup variants of an atom id, in no order; none if it is unknown."""
        return decode_atoms(self.stored().where(F.col("atom_id") == F.lit(bytearray(check_digest(digest)))))

    def verify(self) -> DataFrame:
        right = (F.col("atom_id") == atom_id("language", "content")) & (F.col("row_digest") == row_digest("language", "content"))
        valid = (V.language_outcome("language") == "ok") & V.nodes_ok("content")
        return self.stored().where(~F.coalesce(right & valid, F.lit(False)))


class ObservationStore(Store):
    """Append-only facts with two times: when recorded, and from when they hold."""

    schema, key, cluster = OBSERVATIONS, "observation_id", ("kind", "observation_id")
    blooms = ("observation_id", "kind")
    index_names = ("observation_id_idx", "kind_idx", "subjects_idx")
    SIDE = T.StructType([T.StructField("subject", T.BinaryType()), T.StructField("observation_id", T.BinaryType())])

    def put_observations(self, observations: DataFrame) -> int:
        return self._put(encode_observations(observations))

    def get_observation(self, digest: bytes) -> DataFrame:
        """The observation with this id, or no row."""
        return decode_observations(self.stored().where(F.col("observation_id") == F.lit(bytearray(check_digest(digest))))).limit(1)

    def get_observations_of_kind(self, kind: str) -> DataFrame:
        """All observations of exactly this kind, in no order. Indexed fragments lie in order of kind, so only their files and row groups of this kind are read."""
        return decode_observations(self.stored().where(F.col("kind") == F.lit(kind)))

    def get_observations_by_subject(self, digest: bytes) -> DataFrame:
        """All observations with the atom among their subjects, each once.

        Indexed fragments are reached through the inverted table, which is clustered by subject; the rest is scanned.
        """
        subject = F.lit(bytearray(check_digest(digest)))
        has = lambda df: df.where(F.array_contains("subjects", subject))
        if not self.manifest.side:
            return decode_observations(has(self.stored()))
        ids = self.data.scan(self.manifest.side, self.SIDE).where(F.col("subject") == subject).select("observation_id")
        found = self.data.scan(self.manifest.indexed, self.schema).join(ids, "observation_id", "left_semi")
        behind = tuple(f for f in self.manifest.fragments if f not in self.manifest.indexed)
        return decode_observations(found.union(has(self.data.scan(behind, self.schema))) if behind else found)

    def _index(self, rows: DataFrame, fragment: str) -> dict[str, object]:
        pairs = rows.select(F.explode(F.array_distinct("subjects")).alias("subject"), "observation_id")
        return {"side": (self.data.write(pairs.repartitionByRange("subject").sortWithinPartitions("subject"), "subject"),)}

    def verify(self) -> DataFrame:
        right = F.col("observation_id") == observation_id("kind", "subjects", "recorded_at", "effective_at", "payload")
        valid = V.kind_ok("kind") & V.subjects_ok("subjects") & F.try_parse_json("payload").isNotNull()
        return self.stored().where(~F.coalesce(right & valid, F.lit(False)))


def check_digest(digest: bytes) -> bytes:
    if len(digest) != 32:
        raise SchemaMismatch("a digest has 32 bytes")
    return digest

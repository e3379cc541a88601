import dataclasses
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import nodes as N
from tessera.model import ATOM_INPUT, OBSERVATION_INPUT, BackendError, SchemaMismatch
from tessera.operators.stores import AtomStore, ObservationStore, decode_atoms, decode_observations, encode_atoms, encode_observations
from tessera.streaming import sink

UTC = dt.timezone.utc
A, B, C = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))


def atoms(spark, *rows):
    return spark.createDataFrame([(lang, [{"node_kind": k, "data": d} for k, d in nodes]) for lang, nodes in rows], ATOM_INPUT)


def said(df):
    return sorted((r["language"], tuple((n["node_kind"], n["data"]) for n in r["content"])) for r in df.collect())


def facts(spark, *rows):
    at = lambda s: dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=s)
    return spark.createDataFrame([(k, subj, at(r), None if e is None else at(e), p) for k, subj, r, e, p in rows], OBSERVATION_INPUT)


@pytest.fixture
def uri(tmp_path):
    return str(tmp_path / "store")


def test_lifecycle(spark, uri):
    with pytest.raises(BackendError):
        AtomStore.open(spark, uri)
    store = AtomStore.create(spark, uri)
    with pytest.raises(BackendError):
        AtomStore.create(spark, uri)
    assert store.stored().count() == 0
    hello = atoms(spark, ("en-US", [("text", "Hello")]))
    assert store.put_atoms(hello) == 1
    v = store.version
    assert store.put_atoms(hello) == 0
    assert store.put_atoms(hello.limit(0)) == 0
    assert store.version == v
    again = AtomStore.open(spark, uri)
    assert said(decode_atoms(again.stored())) == [("en-US", (("text", "Hello"),))]
    assert store.verify().count() == 0


def test_snapshots_and_lost_races(spark, uri):
    one = AtomStore.create(spark, uri)
    two = AtomStore.open(spark, uri)
    one.put_atoms(atoms(spark, ("en-US", [("text", "x")])))
    assert two.stored().count() == 0
    with pytest.raises(BackendError):
        two.put_atoms(atoms(spark, ("en-US", [("text", "y")])))
    assert AtomStore.open(spark, uri).stored().count() == 1


def test_many_copies_in_one_put(spark, uri):
    store = AtomStore.create(spark, uri)
    row = atoms(spark, ("en-US", [("text", "same")]))
    assert store.put_atoms(spark.range(1500).crossJoin(row)) == 1
    assert store.stored().count() == 1


def test_markup_variants(spark, uri):
    store = AtomStore.create(spark, uri)
    rows = [("en-US", [("placeholder", "<ph/>")]), ("en-US", [("placeholder", "<bpt/>")])]
    store.put_atoms(atoms(spark, *rows))
    key = store.stored().first()["atom_id"]
    assert len(said(store.get_atoms(key))) == 2
    assert store.get_atoms(b"\0" * 32).count() == 0


@pytest.mark.parametrize("bad", [("en", [("text", "x")]), ("", []), ("en-US", [("bogus", "x")]), ("en-US", [("text", None)]), (None, [])])
def test_invalid_atoms_fail_the_put(spark, uri, bad):
    store = AtomStore.create(spark, uri)
    with pytest.raises(Exception, match="InvalidLanguageTag|UnknownNodeKind"):
        store.put_atoms(atoms(spark, bad))
    assert store.version == 1


def test_schema_is_checked(spark):
    with pytest.raises(SchemaMismatch):
        decode_atoms(spark.createDataFrame([("en-US", "x")], "language string, content string"))
    with pytest.raises(SchemaMismatch):
        decode_observations(spark.createDataFrame([("k",)], "kind string"))
    extra = atoms(spark, ("en-US", [])).withColumn("atom_id", F.lit(1)).withColumn("row_digest", F.lit("x"))
    assert decode_atoms(extra).columns == ["language", "content"]


def test_atom_maintenance(spark, uri):
    store = AtomStore.create(spark, uri)
    for i in range(3):
        store.put_atoms(atoms(spark, ("en-US", [("text", f"t{i}")]), ("en-US", [("text", "shared")])))
    before, old = said(decode_atoms(store.stored())), store.version
    assert store.ensure_indexes() and not store.ensure_indexes() and not store.optimize_indexes()
    store.put_atoms(atoms(spark, ("fr-FR", [("text", "late")])))
    assert store.optimize_indexes() and not store.optimize_indexes()
    assert store.compact() and not store.compact()
    now = said(decode_atoms(store.stored()))
    assert now == sorted([*before, ("fr-FR", (("text", "late"),))])
    for key in [r["atom_id"] for r in store.stored().collect()]:
        assert store.get_atoms(key).count() == 1
    assert said(decode_atoms(AtomStore.open(spark, uri, old).stored())) == before
    stats = store.cleanup_versions(1)
    assert stats.old_versions == store.version - 1 and stats.fragments_removed > 0 and stats.bytes_removed > 0
    assert said(decode_atoms(AtomStore.open(spark, uri).stored())) == now
    with pytest.raises(BackendError):
        AtomStore.open(spark, uri, old)
    with pytest.raises(ValueError):
        store.cleanup_versions(0)


ROWS = [
    ("translation_of", [A, B], 1000, None, '{"b": 1, "a": 0.91}'),
    ("translation_of", [B, A], 1000, None, '{"a":0.91,"b":1}'),
    ("approved_by", [A], 86400, -365 * 86400, '{"reviewer":"alice"}'),
    ("O'Brien", [A, A, C], 0, 0, None),
    ("empty", [], 0, 0, "[]"),
]


def flat(df):
    return sorted((r["kind"], tuple(map(bytes, r["subjects"])), r["recorded_at"], r["effective_at"], r["payload"]) for r in df.collect())


@pytest.fixture
def observations(spark, uri):
    store = ObservationStore.create(spark, uri)
    assert store.put_observations(facts(spark, *ROWS, ROWS[0])) == 5
    assert store.put_observations(facts(spark, ("translation_of", [A, B], 1000, 1000, '{"a":0.91,"b":1}'))) == 0
    return store


def by_subject(store, subject):
    return flat(store.get_observations_by_subject(subject))


def test_observation_queries(observations):
    store = observations
    everything = flat(decode_observations(store.stored()))
    assert [r[4] for r in everything] == ["null", '{"reviewer":"alice"}', "[]", '{"a":0.91,"b":1}', '{"a":0.91,"b":1}']
    assert len(flat(store.get_observations_of_kind("O'Brien"))) == 1
    assert flat(store.get_observations_of_kind("Translation_of")) == []
    for s, n in ((A, 4), (B, 2), (C, 1), (b"\0" * 32, 0)):
        assert len(by_subject(store, s)) == n
    for r in store.stored().collect():
        assert store.get_observation(r["observation_id"]).count() == 1
    assert store.get_observation(b"\0" * 32).count() == 0
    assert store.verify().count() == 0


def test_observation_maintenance_changes_no_result(spark, observations):
    store = observations
    before = {s: by_subject(store, s) for s in (A, B, C)}
    assert store.ensure_indexes() and not store.ensure_indexes()
    assert {s: by_subject(store, s) for s in (A, B, C)} == before
    store.put_observations(facts(spark, ("late", [C, B], 5, None, "1")))
    late = {s: by_subject(store, s) for s in (A, B, C)}
    assert [len(late[s]) - len(before[s]) for s in (A, B, C)] == [0, 1, 1]
    assert store.optimize_indexes()
    assert {s: by_subject(store, s) for s in (A, B, C)} == late
    assert store.compact() and not store.compact()
    store.cleanup_versions(1)
    assert {s: by_subject(store, s) for s in (A, B, C)} == late


@pytest.mark.parametrize("bad", [("", [A], 0, 0, "1"), (" ", [A], 0, 0, "1"), ("k", [b"short"], 0, 0, "1"), ("k", None, 0, 0, "1"), ("k", [A], 0, 0, "not json")])
def test_invalid_observations_fail_the_put(spark, uri, bad):
    with pytest.raises(Exception, match="InvalidKind|SchemaMismatch|InvalidPayload"):
        ObservationStore.create(spark, uri).put_observations(facts(spark, bad))


def test_corrupt_rows_fail_the_read_and_show_in_verify(spark, observations):
    broken = observations.stored().limit(1).withColumn("payload", F.lit("not json"))
    observations.manifest = observations.data.commit(observations.manifest, fragments=(*observations.manifest.fragments, observations.data.write(broken)))
    assert observations.verify().count() == 1
    with pytest.raises(Exception, match="InvalidPayload"):
        decode_observations(observations.stored()).collect()


def test_streaming_replay_inserts_nothing(spark, uri, tmp_path):
    source = str(tmp_path / "in")
    atoms(spark, *[("en-US", [("text", f"w{i % 7}")]) for i in range(30)]).write.parquet(source)
    store = AtomStore.create(spark, uri)
    for n in (1, 2):
        sink.start(spark.readStream.schema(ATOM_INPUT).parquet(source), store, str(tmp_path / f"cp{n}")).awaitTermination()
        assert store.stored().count() == 7
    assert store.version == 2


def test_constructors(spark):
    at = F.timestamp_seconds(F.lit(7))
    row = spark.range(1).select(*N.property_of(F.lit("k"), F.lit(bytearray(A)), at, None, F.lit("1"))).first()
    assert row["effective_at"] == row["recorded_at"] and len(row["subjects"]) == 1
    plain = spark.range(1).select(*N.observation(F.lit("k"), F.array(), at, F.lit(None).cast("timestamp"), F.lit("1"))).first()
    assert plain["effective_at"] is None
    assert list(map(bytes, spark.range(1).select(N.sorted_subjects(F.array(F.lit(bytearray(B)), F.lit(bytearray(A))))).first()[0])) == sorted([A, B])


def test_what_failed_writes_leave_is_cleaned_up(spark, uri):
    store = AtomStore.create(spark, uri)
    store.put_atoms(atoms(spark, ("en-US", [("text", "x")])))
    lost = store.data.write(store.stored())
    draft = store.data._path(f"{uri}/_versions/.dead.draft")
    store.data._fs.create(draft, False).close()
    assert store.cleanup_versions(9).fragments_removed == 0  # young ones may belong to a write that is under way
    assert store.cleanup_versions(9, unlisted_s=0).fragments_removed == 1
    assert not store.data._fs.exists(draft) and not store.data._fs.exists(store.data._path(store.data.location(lost)))
    assert said(decode_atoms(AtomStore.open(spark, uri).stored())) == [("en-US", (("text", "x"),))]


def test_a_lost_race_leaves_no_draft(spark, uri):
    one = AtomStore.create(spark, uri)
    with pytest.raises(BackendError):
        one.data.commit(dataclasses.replace(one.manifest, version=0))
    assert [s.getPath().getName() for s in one.data._fs.listStatus(one.data._path(f"{uri}/_versions"))] == ["00000001.json"]
    assert AtomStore.open(spark, uri).version == 1


def test_indexed_fragments_lie_in_order_of_kind(spark, uri):
    store = ObservationStore.create(spark, uri)
    store.put_observations(facts(spark, *((k, [A], i, None, "{}") for i in range(50) for k in ("a", "b", "c"))))
    store.ensure_indexes()
    kinds = [r["kind"] for r in store.stored().coalesce(1).collect()]
    assert kinds == sorted(kinds) and store.get_observations_of_kind("b").count() == 50
    store.put_observations(facts(spark, ("b", [B], 99, None, "{}")))
    assert store.get_observations_of_kind("b").count() == 51
    plan = store.get_observations_of_kind("b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,b)" in plan


def test_compaction_leaves_large_fragments(spark, uri):
    store = ObservationStore.create(spark, uri)
    store.put_observations(facts(spark, *(("a", [A], i, None, "{}") for i in range(2000))))
    store.ensure_indexes()
    (large,) = store.manifest.fragments
    for i in range(3):
        store.put_observations(facts(spark, ("b", [B], i, None, "{}")))
    store.COMPACT_BYTES, store.data.size = 5, lambda f: 9 if f == large else 1
    assert store.compact() and store.manifest.fragments[0] == large and len(store.manifest.fragments) == 2
    assert store.manifest.indexed == store.manifest.fragments and not store.compact()
    assert store.get_observations_by_subject(B).count() == 3 and store.get_observations_by_subject(A).count() == 2000


def test_one_bad_row_fails_every_read(spark):
    bad = atoms(spark, ("en-US", [("text", "x")]), ("en-US", [("bogus", "x")]))
    with pytest.raises(Exception, match="UnknownNodeKind"):
        decode_atoms(bad).select("language").collect()
    with pytest.raises(Exception, match="InvalidKind"):
        decode_observations(facts(spark, (" ", [A], 1, 1, "{}"))).select("payload").collect()


def test_exposed_rows(spark, uri):
    store = AtomStore.create(spark, uri)
    store.put_atoms(atoms(spark, ("en-US", [("text", "x")]), ("fr-FR", [("text", "y")])))
    store.expose("atoms_of_test")
    assert spark.sql("SELECT language FROM atoms_of_test WHERE content[0].data = 'y'").collect() == [("fr-FR",)]


def test_copies_of_atoms_go_before_anything_is_sorted(spark, uri):
    """A task that reads many copies holds one of each: its stage hashes, and has no sort."""
    rows = atoms(spark, ("en-US", [("text", "a"), ("placeholder", "<b>")]), ("en-US", [("text", "b")])).crossJoin(spark.range(500)).drop("id")
    plan = encode_atoms(rows)._jdf.queryExecution().executedPlan().toString()
    reads = plan[plan.rindex("Exchange hashpartitioning") :]  # the plan is printed from its end to its beginning
    assert "HashAggregate" in reads and "Sort" not in reads
    store = AtomStore.create(spark, uri)
    assert store.put_atoms(rows) == 2 and store.put_atoms(rows) == 0
    assert said(store.stored()) == [("en-US", (("text", "a"), ("placeholder", "<b>"))), ("en-US", (("text", "b"),))]


def test_atoms_of_one_digest_are_one(spark, uri):
    """Bytes that aren't UTF-8 are replaced when they are hashed, so different rows may have the same digest."""
    rows = spark.sql("SELECT 'en-US' AS language, array(struct('text' AS node_kind, CAST(data AS STRING) AS data)) AS content FROM VALUES (X'FF'), (X'FE') AS t(data)")
    store = AtomStore.create(spark, uri)
    assert store.put_atoms(rows) == 1 and store.put_atoms(rows) == 0


def test_copies_of_observations_go_before_anything_is_sorted(spark, uri):
    rows = facts(spark, ("k", [A], 1, None, '{"b": 1, "a": 2}'), ("k", [A], 1, 1, '{"a":2,"b":1}'), ("k", [B], 1, 2, None)).crossJoin(spark.range(500)).drop("id")
    plan = encode_observations(rows)._jdf.queryExecution().executedPlan().toString()
    reads = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "HashAggregate" in reads and "Sort" not in reads
    store = ObservationStore.create(spark, uri)
    assert store.put_observations(rows) == 2 and store.put_observations(rows) == 0

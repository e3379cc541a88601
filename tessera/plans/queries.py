"""Registered queries: each applies an operator to whole driver tables, and has its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I  # noqa: E741
from ..functions import nodes as N
from ..functions import normalize as Z
from ..functions import validate as V
from ..functions import xliff as X
from ..functions.canonical import canonical_json
from ..model import BackendError
from ..operators.stores import AtomStore, ObservationStore, encode_atoms, encode_observations
from ..sources import tmx
from ..streaming import sink
from . import readmodels as R

INSTANT = dt.datetime(2024, 1, 15, 12)
ORDERS_INSTANT = dt.datetime(1997, 6, 17)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new dataset's place: below the cluster's shared folder; only a session on one machine may have none set, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(?!-cluster)", spark.sparkContext.master):
            raise BackendError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _tag(lang: str) -> Column:
    """The caller's policy for tables whose languages have no region."""
    return F.concat(F.col(lang), F.lit("-"), F.when(F.col(lang) == "en", "US").otherwise(F.upper(F.col(lang))))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", _tag("lang").alias("language"), N.content(N.text(F.col("text"))).alias("content"))


def _shown(content: Column) -> Column:
    return F.array_join(F.transform(content, lambda n: F.concat(n["node_kind"], F.lit(":"), n["data"])), "|")


def _en(text: Column) -> Column:
    return I.atom_id(F.lit("en-US"), N.content(N.text(text)))


# identity


def atom_identity(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", N.digest(I.atom_id("language", "content")).alias("atom_id"))


def row_digest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _documents(spark, sf).select("doc_id", N.digest(I.row_digest("language", "content")).alias("row_digest"))
    return keyed.groupBy("row_digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def encode_atoms_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return encode_atoms(_documents(spark, sf)).select(N.digest("atom_id").alias("atom_id"), N.digest("row_digest").alias("row_digest"), "language")


def _markup(open_: str, close: str) -> Column:
    return N.content(N.text(F.lit("Click ")), N.placeholder(F.lit(open_)), N.text(F.col("p_name")), N.placeholder(F.lit(close)))


def atom_markup_variants(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "part").select("p_partkey", F.explode(F.array(_markup("<b>", "</b>"), _markup("{0}", "{1}"))).alias("content"))
    keyed = both.select("p_partkey", N.digest(I.atom_id(F.lit("en-US"), "content")).alias("atom_id"), I.row_digest(F.lit("en-US"), "content").alias("d"))
    return keyed.groupBy("p_partkey", "atom_id").agg(F.countDistinct("d").alias("row_digests"))


def _event_observations(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", *N.property_of(F.col("event_type"), _en(F.col("user_id").cast("string")), ts, None, F.col("props")))


def observation_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _event_observations(spark, sf).withColumn("payload", canonical_json("payload"))
    return rows.select("event_id", N.digest(I.observation_id("kind", "subjects", "recorded_at", "effective_at", "payload")).alias("observation_id"))


def canonical_payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", canonical_json("props").alias("payload"))


def canonical_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Keys in order at every depth, repeated keys, floats, minus zero, escapes and large numbers."""
    k = F.col("user_id").cast("string")
    text = F.concat(F.lit('{ "z" : {"b": -0.0, "a": [1.50, true, null, {"y": 1e2, "x": '), k, F.lit('}]},\n "k":'), k, F.lit(', "é": "\\u00e9\\n", "B": 12345678901234567890123, "a": 1, "a": 2, "": 0.00001}'))
    return table(spark, sf, "events").select("event_id", canonical_json(text).alias("payload"))


# projections and normalisation


def reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", N.reconstruct(_markup("<b>", "</b>")).alias("text"))


def display_atom(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", N.display(F.lit("en-US"), _markup("<b>", "</b>")).alias("shown"))


def collapse_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_name")
    content = N.content(N.text(F.col("p_type")), N.text(F.lit("")), N.text(p), N.placeholder(F.lit("<x/>")), N.text(F.lit("")), N.placeholder(F.lit("")), N.text(F.col("p_brand")), N.text(F.lit("!")))
    return table(spark, sf, "part").select("p_partkey", _shown(Z.collapse_adjacent(content)).alias("nodes"))


def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    content = F.transform(F.split("text", "\\."), lambda s: N.text(F.trim(s)))
    kept = Z.drop_empty(content)
    return table(spark, sf, "documents").select("doc_id", F.size(kept).alias("nodes"), F.md5(_shown(kept)).alias("digest"))


def trim_modes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_name")
    content = N.content(N.text(F.concat(F.lit(" .x"), p, F.lit("x. "))), N.placeholder(F.lit(" <x/> ")), N.text(F.concat(F.lit("x "), F.col("p_brand"), F.lit(" .x"))))
    return table(spark, sf, "part").select("p_partkey", *(_shown(Z.trim_nodes(content, m, " x.")).alias(m) for m in Z.TRIM_MODES))


def unicode_nfc(spark: SparkSession, sf: str) -> DataFrame:
    decomposed = F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301"))
    normal = Z.normalize_unicode(N.content(N.text(decomposed)), "nfc")
    return table(spark, sf, "documents").select("doc_id", F.md5(N.reconstruct(normal)).alias("digest"))


def unicode_forms(spark: SparkSession, sf: str) -> DataFrame:
    content = N.content(N.text(F.concat(F.col("text"), F.lit(" \ufb01le \ufa10"))), N.placeholder(F.lit("\ufb01")))
    return table(spark, sf, "documents").select("doc_id", *(F.md5(N.reconstruct(Z.normalize_unicode(content, f))).alias(f) for f in Z.UNICODE_FORMS))


def display_escapes(spark: SparkSession, sf: str) -> DataFrame:
    data = F.concat(F.lit('a"b\\c\n\t\r\0\x01\x7f'), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", N.display(F.lit("en-US"), N.content(N.text(data))).alias("shown"))


def language_case(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", Z.normalize_language("language", "lower").alias("lower"), Z.normalize_language("language", "upper").alias("upper"))


def language_validation(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.col("lang"), _tag("lang"), F.concat("lang", F.lit("-Latn-"), F.upper("lang")), F.concat("lang", F.lit("-419-x-a1")), F.concat("lang", F.lit("_US")), F.lit(""), F.lit("not a tag"), F.lit("qaa-QM"), F.lit("x-private"))
    rows = table(spark, sf, "documents").select(F.explode(tags).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n")).select("tag", "n", V.language_outcome("tag").alias("outcome"))


def kind_validation(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(F.col("event_type"), F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")), F.lit(""), F.lit("   "), F.lit("\t\n"))
    return table(spark, sf, "events").select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", V.kind_ok("kind").alias("valid"))


def region_script(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(_tag("lang"), F.concat("lang", F.lit("-Latn-"), F.upper("lang")), F.concat("lang", F.lit("-419-x-a1")), F.col("lang"))
    rows = table(spark, sf, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return rows.select("tag", "n", N.region("tag").alias("region"), N.script("tag").alias("script"))


def row_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Node kinds, null data, the width of subjects, and payloads."""
    node = lambda k, d: F.struct(k.alias("node_kind"), d.alias("data"))
    kind = F.element_at(F.array(F.lit("text"), F.lit("placeholder"), F.lit("bogus"), F.lit("Text"), F.lit(None).cast("string")), (F.col("p_partkey") % 5).cast("int") + 1)
    data = F.when(F.col("p_partkey") % 7 > 0, F.col("p_name"))
    width = (F.col("p_partkey") % 3).cast("int") + 31
    subject = F.substring(F.sha2(F.col("p_name"), 512).cast("binary"), F.lit(1), width)
    payload = F.element_at(F.array(F.lit('{"a":1}'), F.lit("not json"), F.lit("null"), F.lit("")), (F.col("p_partkey") % 4).cast("int") + 1)
    return table(spark, sf, "part").select("p_partkey", V.nodes_ok(F.array(node(kind, data))).alias("nodes"), V.subjects_ok(F.array(subject)).alias("subjects"), F.try_parse_json(payload).isNotNull().alias("payload"))


# segments


def _segment() -> Column:
    return F.concat(F.lit('Click <g id="1">'), F.col("p_name"), F.lit("</g> &amp; <![CDATA[<"), F.col("p_brand"), F.lit('>]]><ph id="2">{0}&lt;</ph>&#65;<x id="3"/>'))


def xliff_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", _shown(X.parse_segment(_segment(), "logical")).alias("logical"), _shown(X.parse_segment(_segment(), "verbatim")).alias("verbatim"))


def xliff_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", _segment().alias("segment"))
    rows = rows.select("p_partkey", "segment", X.parse_segment("segment", "verbatim").alias("v"), X.parse_segment("segment", "logical").alias("l"))
    again = rows.select("p_partkey", (X.emit_segment("v", "verbatim") == F.col("segment")).alias("bytes_same"), "l", X.parse_segment(X.emit_segment("l", "logical"), "logical").alias("l2"))
    return again.select("p_partkey", "bytes_same", (F.col("l") == F.col("l2")).alias("content_same"))


def xliff_rejects(spark: SparkSession, sf: str) -> DataFrame:
    result = X.try_parse_segment("html", "logical")
    return table(spark, sf, "pages").select("page_id", F.substring_index(result["error"], ":", 1).alias("error"))


def emit_logical(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.md5(X.emit_segment("content", "logical")).alias("digest"))


def emit_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.md5(X.emit_segment("content", "verbatim")).alias("digest"))


def tmx_import(spark: SparkSession, sf: str) -> DataFrame:
    """A translation memory written from the parts, read back as segments and parsed."""
    lines = table(spark, sf, "part").select(
        F.concat(F.lit('<tu tuid="'), F.col("p_partkey"), F.lit('">\n <tuv xml:lang="en-US"><seg>Click <ph x="1">{0}</ph> &amp; '), F.col("p_name"), F.lit('</seg></tuv>\n <tuv lang="de-DE" changeid=\'a\'><prop type="x">y</prop><seg>'), F.col("p_brand"), F.lit("\nneu</seg></tuv>\n</tu>")).alias("value")
    )
    path = _scratch(spark)
    lines.write.text(path)
    rows = tmx.read(spark, path)
    return rows.select("tuid", "nth", "language", _shown(X.parse_segment("segment", "logical")).alias("nodes"))


# stores


def atoms_by_id(spark: SparkSession, sf: str) -> DataFrame:
    store = AtomStore.create(spark, _scratch(spark))
    store.put_atoms(table(spark, sf, "part").select(F.lit("en-US").alias("language"), F.explode(F.array(_markup("<b>", "</b>"), _markup("{0}", "{1}"))).alias("content")))
    name = table(spark, sf, "part").where("p_partkey = 1").select("p_name").first()["p_name"]
    wanted = spark.range(1).select(I.atom_id(F.lit("en-US"), N.content(N.text(F.lit("Click ")), N.placeholder(F.lit("")), N.text(F.lit(name)), N.placeholder(F.lit("")))).alias("i")).first()["i"]
    return store.get_atoms(wanted).select("language", N.reconstruct("content").alias("text"))


def _observation_store(spark: SparkSession, sf: str) -> ObservationStore:
    store = ObservationStore.create(spark, _scratch(spark))
    store.put_observations(_event_observations(spark, sf).drop("event_id"))
    return store


def observations_of_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _observation_store(spark, sf).get_observations_of_kind("click").select("kind", F.unix_micros("recorded_at").alias("recorded_us"), "payload")


def observations_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    store = _observation_store(spark, sf)
    store.ensure_indexes()
    wanted = spark.range(1).select(_en(F.lit("7")).alias("i")).first()["i"]
    return store.get_observations_by_subject(wanted).select("kind", F.unix_micros("recorded_at").alias("recorded_us"), "payload")


def observation_by_id(spark: SparkSession, sf: str) -> DataFrame:
    store = _observation_store(spark, sf)
    wanted = store.stored().agg(F.min("observation_id").alias("i")).first()["i"]
    return store.get_observation(wanted).select("kind", F.unix_micros("recorded_at").alias("recorded_us"), "payload")


def put_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    store = AtomStore.create(spark, _scratch(spark))
    store.put_atoms(_documents(spark, sf))
    store.put_atoms(_documents(spark, sf))
    return store.stored().agg(F.count("*").alias("stored"), F.countDistinct("row_digest").alias("digests"), F.lit(store.version).cast("long").alias("version"))


def put_merge(spark: SparkSession, sf: str) -> DataFrame:
    store = AtomStore.create(spark, _scratch(spark))
    docs = _documents(spark, sf)
    first = store.put_atoms(docs.where("language = 'en-US'"))
    second = store.put_atoms(docs)
    return spark.createDataFrame([(first, second, store.version)], "first long, second long, version long")


def maintenance_invariance(spark: SparkSession, sf: str) -> DataFrame:
    store = AtomStore.create(spark, _scratch(spark))
    docs = _documents(spark, sf)
    store.put_atoms(docs.where("language = 'en-US'"))
    store.ensure_indexes()
    store.put_atoms(docs)
    store.optimize_indexes()
    store.compact()
    store.cleanup_versions(1)
    return store.stored().select(N.digest("row_digest").alias("row_digest"), N.digest("atom_id").alias("atom_id"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    store = AtomStore.create(spark, _scratch(spark))
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    rows = stream.select(_tag("lang").alias("language"), N.content(N.text(F.col("text"))).alias("content"))
    sink.start(rows, store, _scratch(spark)).awaitTermination()
    return store.stored().groupBy("language").agg(F.count("*").alias("atoms"))


def open_at_version(spark: SparkSession, sf: str) -> DataFrame:
    """Reopened at each version, after the writer is gone: rows stored then."""
    uri, docs = _scratch(spark), _documents(spark, sf)
    store = AtomStore.create(spark, uri)
    for lang in ("en-US", "fr-FR", "de-DE"):
        store.put_atoms(docs.where(F.col("language") == lang))
    seen = [(v, AtomStore.open(spark, uri, v).stored().count()) for v in (1, 2, 3, 4)] + [(0, AtomStore.open(spark, uri).stored().count())]
    return spark.createDataFrame(seen, "version long, stored long")


def kind_after_index(spark: SparkSession, sf: str) -> DataFrame:
    """A kind from fragments that the index covers and one that it doesn't cover yet."""
    store, facts = ObservationStore.create(spark, _scratch(spark)), _event_observations(spark, sf)
    store.put_observations(facts.where("event_id % 2 = 0").drop("event_id"))
    store.ensure_indexes()
    store.put_observations(facts.drop("event_id"))
    return store.get_observations_of_kind("click").select("kind", F.unix_micros("recorded_at").alias("recorded_us"), "payload")


def subject_after_compact(spark: SparkSession, sf: str) -> DataFrame:
    """A subject's observations after indexed and other fragments were merged."""
    store, facts = ObservationStore.create(spark, _scratch(spark)), _event_observations(spark, sf)
    store.put_observations(facts.where("event_id % 2 = 0").drop("event_id"))
    store.ensure_indexes()
    store.put_observations(facts.drop("event_id"))
    store.compact()
    wanted = spark.range(1).select(_en(F.lit("7")).alias("i")).first()["i"]
    return store.get_observations_by_subject(wanted).select("kind", F.unix_micros("recorded_at").alias("recorded_us"), "payload")


def lifecycle_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What opening, creating and reading refuse: the kind of error of each case."""
    docs, uri, absent = _documents(spark, sf), _scratch(spark), _scratch(spark)
    store = AtomStore.create(spark, uri)
    store.put_atoms(docs)
    bad = AtomStore.create(spark, _scratch(spark))
    rows = store.stored()
    first = rows.agg(F.min("row_digest").alias("d")).first()["d"]
    broken = rows.withColumn("content", F.when(F.col("row_digest") == F.lit(first), F.array(F.struct(F.lit("bogus").alias("node_kind"), F.lit("x").alias("data")))).otherwise(F.col("content")))
    bad.manifest = bad.data.commit(bad.manifest, fragments=(bad.data.write(broken),))
    from ..operators.stores import decode_atoms

    cases = {
        "open absent": lambda: AtomStore.open(spark, absent),
        "create twice": lambda: AtomStore.create(spark, uri),
        "open later version": lambda: AtomStore.open(spark, uri, 9),
        "wrong columns": lambda: ObservationStore.open(spark, uri),
        "put wrong columns": lambda: store.put_atoms(docs.select("doc_id")),
        "corrupt row": lambda: decode_atoms(bad.stored()).select("language").count(),
        "short digest": lambda: store.get_atoms(b"31 bytes"),
        "bad language": lambda: store.put_atoms(docs.withColumn("language", F.lit("en"))),
        "stored as before": lambda: store.stored().count(),
    }
    seen = []
    for case, act in cases.items():
        try:
            act()
            seen.append((case, "none"))
        except Exception as e:
            codes = ("UnknownNodeKind", "InvalidLanguageTag")
            seen.append((case, next((c for c in codes if c in str(e)), type(e).__name__)))
    return spark.createDataFrame(seen, "case string, error string")


def sql_view(spark: SparkSession, sf: str) -> DataFrame:
    """A store's rows in SQL."""
    store = AtomStore.create(spark, _scratch(spark))
    store.put_atoms(_documents(spark, sf))
    store.expose("tessera_atoms")
    return spark.sql("SELECT language, count(*) AS atoms, max(length(content[0].data)) AS longest FROM tessera_atoms GROUP BY language")


# planned read models


def _label_observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    atoms = encode_atoms(_documents(spark, sf))
    named = _documents(spark, sf).select("doc_id", I.atom_id("language", "content").alias("subject"))
    at = F.timestamp_seconds(F.lit(0))
    facts = table(spark, sf, "labels").join(named, "doc_id")
    rows = facts.select(F.explode(F.filter(F.array(F.when(F.col("quality") == 1, "approved_by"), F.when(F.col("toxic") == 1, "blacklisted")), lambda k: k.isNotNull())).alias("k"), "subject")
    return atoms, encode_observations(rows.select(*N.property_of(F.col("k"), F.col("subject"), at, None, F.lit("{}"))))


def approved_not_blacklisted(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: strings that were approved and never blacklisted."""
    atoms, facts = _label_observations(spark, sf)
    return R.atoms_without(R.atoms_with(atoms, facts, "approved_by"), facts, "blacklisted").select(N.digest("atom_id").alias("atom_id"), "language")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", _en(F.col("text")).alias("atom"), "text")


def _turn_observations(spark: SparkSession, sf: str) -> DataFrame:
    a = _turns(spark, sf)
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("atom").alias("next"), F.col("role").alias("next_role"))
    pairs = a.join(b, ["conv_id", "turn"])
    at = F.timestamp_seconds(F.col("turn"))
    return encode_observations(pairs.select(*N.relationship(F.lit("translation_of"), F.array("next", "atom"), at, None, F.lit(None).cast("string"))))


def translations_of(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: two hops from a string over the observations that relate it to others."""
    return R.neighbours(_turn_observations(spark, sf), "translation_of").groupBy("subject").agg(F.countDistinct("other").alias("others")).select(N.digest("subject").alias("subject"), "others")


def tm_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: source and target texts of related strings."""
    atoms = encode_atoms(table(spark, sf, "conversations").select(F.lit("en-US").alias("language"), N.content(N.text(F.col("text"))).alias("content")))
    memory = R.translation_memory(atoms, _turn_observations(spark, sf), "translation_of")
    return memory.select(F.md5("source").alias("source"), F.md5("target").alias("target")).distinct()


def as_of_state(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: the latest fact of each subject and kind at an instant."""
    state = R.as_of(encode_observations(_event_observations(spark, sf).drop("event_id")), INSTANT)
    return state.select(N.digest("subject").alias("subject"), "kind", N.digest("observation_id").alias("observation_id"))


def within_3_months(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: a range of time, its end given by the caller."""
    return R.within_months(table(spark, sf, "orders"), "o_orderdate", ORDERS_INSTANT, 3).select("o_orderkey", "o_orderstatus")


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: what a conversation's turns lead to within three steps."""
    t = _turns(spark, sf)
    edges = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("atom").alias("dst")), ["conv_id", "turn"]).select(F.col("atom").alias("src"), "dst")
    return R.reachable(edges, 3).groupBy("hops").agg(F.count("*").alias("pairs"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: nearest vectors, exactly, with every row as a query."""
    v = table(spark, sf, "embeddings")
    return R.vector_topk(v, v, 5).select("query_id", "rank", "vec_id", "similarity")


def payload_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Planned: a field of the payload."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        atom_identity, row_digest_dedup, encode_atoms_distinct, atom_markup_variants, observation_identity, canonical_payload, canonical_nested, reconstruct, display_atom, display_escapes,
        collapse_adjacent, drop_empty, trim_modes, unicode_nfc, unicode_forms, language_case, language_validation, kind_validation, region_script, row_validation, xliff_parse,
        xliff_roundtrip, xliff_rejects, emit_logical, emit_verbatim, tmx_import, atoms_by_id, observations_of_kind, observations_by_subject, observation_by_id,
        put_idempotent, put_merge, open_at_version, kind_after_index, subject_after_compact, lifecycle_errors, sql_view, maintenance_invariance, stream_ingest, approved_not_blacklisted, translations_of, tm_projection, as_of_state,
        within_3_months, reachability, vector_topk, payload_extract,
    )
}

"""SQL of the registered queries, for an engine that has the same tables as views. Queries without an entry can't be expressed in SQL."""

from __future__ import annotations

from .queries import INSTANT, ORDERS_INSTANT


def _framed(e: str) -> str:
    return f"(lpad(hex(octet_length(encode({e}))), 8, '0') || hex(encode({e})))"


def _text_id(language: str, text: str) -> str:
    """Key of an atom of one text node."""
    return f"sha256(unhex('00' || {_framed(language)} || '00' || {_framed(text)}))"


def _text_digest(language: str, text: str) -> str:
    return f"sha256(unhex('01' || {_framed(language)} || '00' || {_framed(text)}))"


def _i64(e: str) -> str:
    return f"lpad(hex({e}), 16, '0')"


_DOCS = "docs AS (SELECT *, lang || '-' || CASE lang WHEN 'en' THEN 'US' ELSE upper(lang) END AS language FROM documents)"
_MARKED = f"sha256(unhex('00' || {_framed(chr(39) + 'en-US' + chr(39))} || '00' || {_framed(chr(39) + 'Click ' + chr(39))} || '01' || '00' || {_framed('p_name')} || '01'))"
_PROPS = "replace(props, ': ', ':')"


def _observation(kind: str, subjects: list[str], micros: str, payload: str) -> str:
    """Key of an observation whose two times are the same; subjects are hex."""
    who = " || ".join(f"upper({s})" for s in subjects)
    return f"sha256(unhex('00' || {_framed(kind)} || '{len(subjects):08x}' || {who} || {_i64(micros)} || {_i64(micros)} || {_framed(payload)}))"


_USER = _text_id("'en-US'", "CAST(user_id AS VARCHAR)")
_EVENT = _observation("event_type", [_USER], "epoch_us(ts)", _PROPS)
_TURN = _text_id("'en-US'", "text")
_EDGES = f"t AS (SELECT conv_id, turn, text, {_TURN} AS atom FROM conversations), edges AS (SELECT DISTINCT a.atom AS src, b.atom AS dst, a.text AS source, b.text AS target FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"
_LANGTAG = r"^([a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(?:-([a-z]{4}))?(?:-([a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"


def _trim(mode: str) -> str:
    a, b = "' .x' || p_name || 'x. '", "'x ' || p_brand || ' .x'"
    c = "' x.'"
    both = lambda e: f"trim({e}, {c})"
    first, last = {
        "outer_leading": (f"ltrim({a}, {c})", b),
        "outer_trailing": (a, f"rtrim({b}, {c})"),
        "outer_both": (f"ltrim({a}, {c})", f"rtrim({b}, {c})"),
        "all_leading": (f"ltrim({a}, {c})", f"ltrim({b}, {c})"),
        "all_trailing": (f"rtrim({a}, {c})", f"rtrim({b}, {c})"),
        "all_both": (both(a), both(b)),
    }[mode]
    return f"'text:' || {first} || '|placeholder: <x/> |text:' || {last} AS {mode}"


#: Accented letters with the letter and mark that they decompose into: all that the documents have.
_LETTERS = {"à": "a\u0300", "á": "a\u0301", "â": "a\u0302", "ä": "a\u0308", "ç": "c\u0327", "è": "e\u0300", "é": "e\u0301", "ê": "e\u0302", "ë": "e\u0308", "í": "i\u0301", "î": "i\u0302", "ï": "i\u0308", "ñ": "n\u0303", "ó": "o\u0301", "ô": "o\u0302", "ö": "o\u0308", "ú": "u\u0301", "ù": "u\u0300", "û": "u\u0302", "ü": "u\u0308"}
_LETTERS |= {"À": "A\u0300", "Á": "A\u0301", "Â": "A\u0302", "Ä": "A\u0308", "Ç": "C\u0327", "È": "E\u0300", "É": "E\u0301", "Ê": "E\u0302", "Ë": "E\u0308", "Í": "I\u0301", "Î": "I\u0302", "Ï": "I\u0308", "Ñ": "N\u0303", "Ó": "O\u0301", "Ô": "O\u0302", "Ö": "O\u0308", "Ú": "U\u0301", "Ù": "U\u0300", "Û": "U\u0302", "Ü": "U\u0308"}


def _decomposed(e: str) -> str:
    for letter, parts in _LETTERS.items():
        e = f"replace({e}, '{letter}', '{parts}')"
    return e


_UNICODE = {
    "nfc": "nfc_normalize(text) || ' \ufb01le \u585a\ufb01'",
    "nfd": _decomposed("nfc_normalize(text)") + " || ' \ufb01le \u585a\ufb01'",
    "nfkc": "nfc_normalize(text) || ' file \u585a\ufb01'",
    "nfkd": _decomposed("nfc_normalize(text)") + " || ' file \u585a\ufb01'",
    "cjk_compat_variants": "text || ' \ufb01le \u585a\ufe00\ufb01'",
}
_KEPT = "list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, ' ')), lambda s: s <> '')"

SQL = {
    "atom_identity": f"WITH {_DOCS} SELECT doc_id, {_text_id('language', 'text')} AS atom_id FROM docs",
    "row_digest_dedup": f"WITH {_DOCS} SELECT {_text_digest('language', 'text')} AS row_digest, count(*) AS copies, min(doc_id) AS first_doc FROM docs GROUP BY 1",
    "encode_atoms_distinct": f"WITH {_DOCS} SELECT DISTINCT {_text_id('language', 'text')} AS atom_id, {_text_digest('language', 'text')} AS row_digest, language FROM docs",
    "atom_markup_variants": f"SELECT p_partkey, {_MARKED} AS atom_id, CAST(2 AS BIGINT) AS row_digests FROM part",
    "observation_identity": f"SELECT event_id, {_EVENT} AS observation_id FROM events",
    "canonical_payload": f"SELECT event_id, {_PROPS} AS payload FROM events",
    "canonical_nested": """SELECT event_id, '{"":0.00001,"B":1.2345678901234568e22,"a":2,"k":' || user_id || ',"z":{"a":[1.5,true,null,{"x":' || user_id || ',"y":100.0}],"b":-0.0},"é":"é\\n"}' AS payload FROM events""",
    "reconstruct": "SELECT p_partkey, 'Click <b>' || p_name || '</b>' AS text FROM part",
    "display_atom": """SELECT p_partkey, 'Atom(language=en-US, content=[Text("Click "), Placeholder("<b>"), Text("' || p_name || '"), Placeholder("</b>")])' AS shown FROM part""",
    "display_escapes": """SELECT p_partkey, 'Atom(language=en-US, content=[Text("a\\"b\\\\c\\n\\t\\r\\0\\u{1}\\u{7f}' || p_name || '")])' AS shown FROM part""",
    "unicode_forms": f"SELECT doc_id, {', '.join(f'md5({e}) AS {form}' for form, e in _UNICODE.items())} FROM documents",
    "region_script": f"""WITH {_DOCS}, tags AS (SELECT unnest([language, lang || '-Latn-' || upper(lang), lang || '-419-x-a1', lang]) AS tag FROM docs)
        SELECT tag, count(*) AS n, nullif(regexp_extract(tag, '{_LANGTAG}', 3, 'i'), '') AS region, nullif(regexp_extract(tag, '{_LANGTAG}', 2, 'i'), '') AS script FROM tags GROUP BY tag""",
    "row_validation": "SELECT p_partkey, p_partkey % 5 < 2 AND p_partkey % 7 > 0 AS nodes, p_partkey % 3 = 1 AS subjects, p_partkey % 4 IN (0, 2) AS payload FROM part",
    "open_at_version": """WITH n AS (SELECT count(DISTINCT text) FILTER (lang = 'en') AS en, count(DISTINCT text) FILTER (lang = 'fr') AS fr, count(DISTINCT text) FILTER (lang = 'de') AS de FROM documents)
        SELECT unnest([1, 2, 3, 4, 0])::BIGINT AS version, unnest([0, en, en + fr, en + fr + de, en + fr + de])::BIGINT AS stored FROM n""",
    "kind_after_index": f"SELECT DISTINCT event_type AS kind, epoch_us(ts) AS recorded_us, {_PROPS} AS payload FROM events WHERE event_type = 'click'",
    "subject_after_compact": f"SELECT DISTINCT event_type AS kind, epoch_us(ts) AS recorded_us, {_PROPS} AS payload FROM events WHERE user_id = 7",
    "lifecycle_errors": """SELECT unnest(['open absent', 'create twice', 'open later version', 'wrong columns', 'put wrong columns', 'corrupt row', 'short digest', 'bad language', 'stored as before']) AS "case",
        unnest(['BackendError', 'BackendError', 'BackendError', 'SchemaMismatch', 'SchemaMismatch', 'UnknownNodeKind', 'SchemaMismatch', 'InvalidLanguageTag', 'none']) AS error""",
    "sql_view": f"WITH {_DOCS} SELECT language, count(DISTINCT text) AS atoms, CAST(max(length(text)) AS INTEGER) AS longest FROM docs GROUP BY language",
    "collapse_adjacent": "SELECT p_partkey, 'text:' || p_type || p_name || '|placeholder:<x/>|placeholder:|text:' || p_brand || '!' AS nodes FROM part",
    "drop_empty": f"SELECT doc_id, CAST(len({_KEPT}) AS INTEGER) AS nodes, md5(array_to_string(list_transform({_KEPT}, lambda s: 'text:' || s), '|')) AS digest FROM documents",
    "trim_modes": f"SELECT p_partkey, {', '.join(map(_trim, ('outer_leading', 'outer_trailing', 'outer_both', 'all_leading', 'all_trailing', 'all_both')))} FROM part",
    "unicode_nfc": "SELECT doc_id, md5(nfc_normalize(replace(text, chr(233), 'e' || chr(769)))) AS digest FROM documents",
    "language_case": f"WITH {_DOCS} SELECT doc_id, lower(language) AS lower, upper(language) AS upper FROM docs",
    "language_validation": f"""WITH {_DOCS}, tags AS (SELECT unnest([lang, language, lang || '-Latn-' || upper(lang), lang || '-419-x-a1', lang || '_US', '', 'not a tag', 'qaa-QM', 'x-private']) AS tag FROM docs)
        SELECT tag, count(*) AS n, CASE WHEN tag = 'x-private' THEN 'missing_region' WHEN NOT regexp_matches(tag, '{_LANGTAG}', 'i') THEN 'malformed' WHEN regexp_extract(tag, '{_LANGTAG}', 3, 'i') = '' THEN 'missing_region' ELSE 'ok' END AS outcome FROM tags GROUP BY tag""",
    "kind_validation": "WITH k AS (SELECT unnest([event_type, ' ' || upper(event_type) || ' ', '', '   ', chr(9) || chr(10)]) AS kind FROM events) SELECT kind, count(*) AS n, trim(kind, ' ' || chr(9) || chr(10)) <> '' AS valid FROM k GROUP BY kind",
    "xliff_parse": """SELECT p_partkey,
        'text:Click |placeholder:<g id="1">|text:' || p_name || '|placeholder:</g>|text: & <' || p_brand || '>|placeholder:<ph id="2">{0}&lt;</ph>|text:A|placeholder:<x id="3"/>' AS logical,
        'text:Click |placeholder:<g id="1">|text:' || p_name || '|placeholder:</g>|text: &amp; <![CDATA[<' || p_brand || '>]]>|placeholder:<ph id="2">{0}&lt;</ph>|text:&#65;|placeholder:<x id="3"/>' AS verbatim FROM part""",
    "xliff_roundtrip": "SELECT p_partkey, true AS bytes_same, true AS content_same FROM part",
    "xliff_rejects": "SELECT page_id, CASE WHEN html LIKE '<!DOCTYPE%' THEN 'unsupported_construct' ELSE 'unknown_tag' END AS error FROM pages",
    "emit_logical": "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents",
    "emit_verbatim": "SELECT doc_id, md5(text) AS digest FROM documents",
    "tmx_import": """SELECT CAST(p_partkey AS VARCHAR) AS tuid, unnest([0, 1])::INTEGER AS nth, unnest(['en-US', 'de-DE']) AS language,
        unnest(['text:Click |placeholder:<ph x="1">{0}</ph>|text: & ' || p_name, 'text:' || p_brand || chr(10) || 'neu']) AS nodes FROM part""",
    "atoms_by_id": "SELECT 'en-US' AS language, unnest(['Click <b>' || p_name || '</b>', 'Click {0}' || p_name || '{1}']) AS text FROM part WHERE p_partkey = 1",
    "observations_of_kind": f"SELECT DISTINCT event_type AS kind, epoch_us(ts) AS recorded_us, {_PROPS} AS payload FROM events WHERE event_type = 'click'",
    "observations_by_subject": f"SELECT DISTINCT event_type AS kind, epoch_us(ts) AS recorded_us, {_PROPS} AS payload FROM events WHERE user_id = 7",
    "observation_by_id": f"SELECT event_type AS kind, epoch_us(ts) AS recorded_us, {_PROPS} AS payload FROM events ORDER BY {_EVENT} LIMIT 1",
    "put_idempotent": "SELECT count(DISTINCT (lang, text)) AS stored, count(DISTINCT (lang, text)) AS digests, CAST(2 AS BIGINT) AS version FROM documents",
    "put_merge": "SELECT count(DISTINCT text) FILTER (lang = 'en') AS first, count(DISTINCT (lang, text)) FILTER (lang <> 'en') AS second, CAST(3 AS BIGINT) AS version FROM documents",
    "maintenance_invariance": f"WITH {_DOCS} SELECT DISTINCT {_text_digest('language', 'text')} AS row_digest, {_text_id('language', 'text')} AS atom_id FROM docs",
    "stream_ingest": f"WITH {_DOCS} SELECT language, count(DISTINCT text) AS atoms FROM docs GROUP BY language",
    "approved_not_blacklisted": f"""WITH {_DOCS}, a AS (SELECT doc_id, {_text_id('language', 'text')} AS atom_id, language FROM docs), f AS (SELECT atom_id, quality, toxic FROM a JOIN labels USING (doc_id))
        SELECT DISTINCT atom_id, language FROM a WHERE EXISTS (SELECT 1 FROM f WHERE f.atom_id = a.atom_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM f WHERE f.atom_id = a.atom_id AND toxic = 1)""",
    "translations_of": f"WITH {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) SELECT src AS subject, count(*) AS others FROM both_ways WHERE src <> dst GROUP BY src",
    "tm_projection": f"WITH {_EDGES} SELECT DISTINCT md5(source) AS source, md5(target) AS target FROM edges",
    "as_of_state": f"""WITH o AS (SELECT {_USER} AS subject, event_type AS kind, ts, {_EVENT} AS observation_id FROM events WHERE ts <= TIMESTAMP '{INSTANT}')
        SELECT subject, kind, observation_id FROM o QUALIFY row_number() OVER (PARTITION BY subject, kind ORDER BY ts DESC, observation_id DESC) = 1""",
    "within_3_months": f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate > TIMESTAMP '{ORDERS_INSTANT}' - INTERVAL 3 MONTH AND o_orderdate <= TIMESTAMP '{ORDERS_INSTANT}'",
    "reachability": f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT src, dst, 1 AS hops FROM edges UNION SELECT walk.src, edges.dst, hops + 1 FROM walk JOIN edges ON walk.dst = edges.src WHERE hops < 3),
        least AS (SELECT src, dst, min(hops) AS hops FROM walk GROUP BY src, dst) SELECT CAST(hops AS INTEGER) AS hops, count(*) AS pairs FROM least GROUP BY hops""",
    "vector_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank, vec_id, similarity FROM s QUALIFY rank <= 5""",
    "payload_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}

"""Registered queries: each operator over whole tables, with its SQL where SQL can express it.

The tables hold no translation memory, so both sides derive the same one from documents (see operators.memory).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.config import STATUS_NAMES, EngineConfig
from glossaloom.functions import plurals as PL
from glossaloom.functions import predicates as P
from glossaloom.functions import text as T
from glossaloom.functions import urls as U
from glossaloom.operators import dom as D
from glossaloom.operators import html as H
from glossaloom.operators import memory as M
from glossaloom.operators import precedence as PR
from glossaloom.operators import rewrite as RW
from glossaloom.operators import search as SE
from glossaloom.operators import selectors as S
from glossaloom.operators import stats as ST
from glossaloom.session import stored
from glossaloom.streaming import lookups as SL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONFIG = EngineConfig()
LANGS = CONFIG.languages
HOST = "blog.tionble.example.com"

STRINGS_SQL = """
strings AS (SELECT doc_id, source, lang, pos, trim(line) AS text
            FROM (SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)
            WHERE length(trim(line)) >= 2)"""
TM_SQL = (
    STRINGS_SQL
    + """,
langs(lang_no, language_code) AS (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es')),
tm AS (SELECT (doc_id * 1000000 + pos) * 4 + lang_no AS id, text AS original_text, md5(text) AS original_text_hash,
              CASE WHEN (doc_id + pos + lang_no) % 4 <> 0 THEN reverse(text) END AS translated_text, language_code,
              'post_' || doc_id || '_content_blocks' AS context, CASE WHEN doc_id % 5 = 0 THEN 'gettext' ELSE 'custom' END AS kind,
              CASE WHEN doc_id % 5 = 0 THEN source END AS gettext_domain, CAST((doc_id + pos + lang_no) % 4 AS INTEGER) AS status,
              TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS updated_at, doc_id, pos
       FROM strings JOIN langs ON lang <> language_code)"""
)
#: SQL of usable(), without and with the contexts.
USABLE_SQL = "translated_text <> '' AND translated_text <> original_text AND status >= 1"
CONTEXTS_SQL = " AND ".join(f"context NOT LIKE '{p}'" for p in CONFIG.excluded_contexts)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _strings(spark: SparkSession, sf: str) -> DataFrame:
    return M.strings(_t(spark, sf, "documents"))


def _tm(spark: SparkSession, sf: str) -> DataFrame:
    return M.build_memory(_t(spark, sf, "documents"), CONFIG)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Counts.


@query("coverage_by_language", f"WITH {TM_SQL} SELECT language_code, status, count(*) AS n, count(DISTINCT original_text_hash) AS n_strings FROM tm GROUP BY 1, 2")
def coverage_by_language(spark, sf):
    return ST.coverage(_tm(spark, sf))


@query("coverage_sets", f"WITH {TM_SQL} SELECT language_code, status, count(*) AS n FROM tm GROUP BY GROUPING SETS ((language_code), (status), ())")
def coverage_sets(spark, sf):
    return ST.coverage_sets(_tm(spark, sf))


@query("posts_by_kind", f"WITH {TM_SQL} SELECT d.source AS kind, CAST(count(*) AS BIGINT) AS n FROM tm JOIN documents d USING (doc_id) GROUP BY 1")
def posts_by_kind(spark, sf):
    return ST.by_kind(_tm(spark, sf), _t(spark, sf, "documents"))


@query("domain_counts", f"WITH {TM_SQL} SELECT gettext_domain, count(DISTINCT original_text_hash) AS n_strings, CAST(sum(CASE WHEN coalesce(translated_text, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_translated FROM tm WHERE kind = 'gettext' AND gettext_domain IS NOT NULL GROUP BY 1")
def domain_counts(spark, sf):
    return ST.domains(_tm(spark, sf))


@query("distinct_contexts", f"WITH {TM_SQL} SELECT DISTINCT context, gettext_domain FROM tm")
def distinct_contexts(spark, sf):
    return _tm(spark, sf).select("context", "gettext_domain").distinct()


@query("duplicate_strings", f"WITH {TM_SQL} SELECT original_text_hash, language_code, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM tm GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_strings(spark, sf):
    return ST.duplicate_groups(_tm(spark, sf))


@query("status_labels", f"WITH {TM_SQL} SELECT CASE status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATUS_NAMES.items()) + " END AS label, kind, count(*) AS n FROM tm GROUP BY 1, 2")
def status_labels(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv])
    return _tm(spark, sf).groupBy(names[F.col("status")].alias("label"), F.col("source").alias("kind")).agg(F.count("*").alias("n"))


# Filters and preferences.


@query("usable_translations", f"WITH {TM_SQL} SELECT id, language_code, md5(translated_text) AS translated_hash FROM tm WHERE {USABLE_SQL} AND {CONTEXTS_SQL}")
def usable_translations(spark, sf):
    return _tm(spark, sf).where(M.usable(CONFIG)).select("id", "language_code", F.md5("translated_text").alias("translated_hash"))


@query("reviewed_translations", f"WITH {TM_SQL} SELECT id, status FROM tm WHERE status IN (1, 2)")
def reviewed_translations(spark, sf):
    return _tm(spark, sf).where(M.reviewed()).select("id", "status")


@query("latest_translation", f"WITH {TM_SQL} SELECT original_text_hash, language_code, id, status FROM (SELECT *, row_number() OVER (PARTITION BY original_text_hash, language_code ORDER BY updated_at DESC, id) AS r FROM tm) WHERE r = 1")
def latest_translation(spark, sf):
    return M.latest(_tm(spark, sf).select("original_text_hash", "language_code", "id", "status", "updated_at")).select("original_text_hash", "language_code", "id", "status")


@query("most_trusted_translation", f"WITH {TM_SQL} SELECT original_text_hash, language_code, id, status FROM (SELECT *, row_number() OVER (PARTITION BY original_text_hash, language_code ORDER BY status DESC, updated_at DESC, id) AS r FROM tm) WHERE r = 1")
def most_trusted_translation(spark, sf):
    return M.most_trusted(_tm(spark, sf).select("original_text_hash", "language_code", "id", "status", "updated_at")).select("original_text_hash", "language_code", "id", "status")


_MIXED_SQL = f"WITH {TM_SQL}, mixed AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'general' WHEN doc_id % 3 = 1 THEN 'group.' || pos ELSE context END AS context) FROM tm)"


def _mixed(spark, sf):
    doc, pos = F.expr("id div 4000000"), F.expr("id div 4 % 1000000")
    return _tm(spark, sf).withColumn("context", F.when(doc % 3 == 0, "general").when(doc % 3 == 1, F.concat(F.lit("group."), pos)).otherwise(F.col("context")))


@query("context_preference", _MIXED_SQL + " SELECT original_text_hash, language_code, id, md5(coalesce(translated_text, original_text)) AS shown_hash FROM (SELECT *, row_number() OVER (PARTITION BY original_text_hash, language_code ORDER BY CASE WHEN context = 'general' THEN 1 WHEN context LIKE 'group%' THEN 2 ELSE 3 END, status DESC, id) AS r FROM mixed) WHERE r = 1")
def context_preference(spark, sf):
    # the texts go by their hashes, as the result shows them
    rows = _mixed(spark, sf).select("original_text_hash", "language_code", "context", F.md5("original_text").alias("original_text"), F.md5("translated_text").alias("translated_text"), "status", "id")
    return M.preferred_context(rows).select("original_text_hash", "language_code", "id", F.col("translated_text").alias("shown_hash"))


@query("paged_strings", f"WITH {TM_SQL} SELECT id, original_text_hash FROM tm WHERE language_code = 'de' AND kind = 'gettext' AND (contains(original_text, 'th') OR coalesce(contains(translated_text, 'th'), false)) ORDER BY updated_at DESC, id LIMIT 100 OFFSET 100")
def paged_strings(spark, sf):
    rows = _tm(spark, sf).where(M.admin_filter(source="gettext", language="de", search="th") & M.first_form())
    return rows.orderBy(F.desc("updated_at"), "id").offset(100).limit(100).select("id", "original_text_hash")


@query("longest_strings", f"WITH {STRINGS_SQL} SELECT text, octet_length(encode(text)) AS n_bytes FROM (SELECT DISTINCT text FROM strings) ORDER BY n_bytes DESC, text LIMIT 100")
def longest_strings(spark, sf):
    return _strings(spark, sf).select("text").distinct().select("text", F.octet_length("text").cast("long").alias("n_bytes")).orderBy(F.desc("n_bytes"), "text").limit(100)


# Lookups.

_ASKED_SQL = "asked AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '  ') ELSE text END AS text FROM strings)"


def _asked_text():
    return F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))


def _asked(spark, sf):
    return _strings(spark, sf).select(_asked_text().alias("text")).distinct()


def _decode_sql(x: str) -> str:
    for ref, char in T.ENTITIES.items():
        x = f"replace({x}, {_q(ref)}, {_q(char)})"
    return x


def _plain_sql(x: str, frm: str, to: str) -> str:
    return f"translate({x}, {_q(frm)}, {_q(to * len(frm))})"


def _n4_sql(x: str) -> str:
    x = f"regexp_replace(translate({_decode_sql(x)}, chr(160), ' '), '\\s{{2,}}', ' ', 'g')"
    x = f"translate({_plain_sql(x, T.DASHES, '-')}, 'ёЁ', 'еЕ')"
    return "trim(" + _plain_sql(_plain_sql(x, "“”„«»", '"'), "‘’‹›", "'") + ")"


def _n1_sql(x: str) -> str:
    x = f"translate({_decode_sql(x)}, chr(160), ' ')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?\\s*>', '<br />', 'g'), '<br\\s*/>\\s+', '<br /> ', 'g')"
    x = f"translate({_plain_sql(f'regexp_replace({x}, {_q(chr(92) + 's{2,}')}, {_q(' ')}, {_q('g')})', T.DASHES, '-')}, 'ёЁ', 'еЕ')"
    return f"trim(replace({_plain_sql(_plain_sql(x, T.DOUBLE_QUOTES, chr(34)), T.SINGLE_QUOTES, chr(39))}, '…', '...'))"


@query(
    "exact_then_normalized_lookup",
    f"""WITH {TM_SQL}, {_ASKED_SQL},
own AS (SELECT * FROM tm WHERE {USABLE_SQL} AND language_code = 'de'),
e AS (SELECT k1, t1 FROM (SELECT trim(original_text) AS k1, translated_text AS t1, row_number() OVER (PARTITION BY trim(original_text) ORDER BY status DESC, updated_at DESC, id) AS r FROM own) WHERE r = 1),
f AS (SELECT k2, t2 FROM (SELECT k2, translated_text AS t2, row_number() OVER (PARTITION BY k2 ORDER BY status DESC, updated_at DESC, id) AS r FROM (SELECT *, {_n4_sql('original_text')} AS k2 FROM own)) WHERE r = 1)
SELECT text, md5(coalesce(t1, t2)) AS translated_hash, CAST(CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS phase
FROM asked LEFT JOIN e ON trim(text) = k1 LEFT JOIN f ON {_n4_sql('text')} = k2""",
)
def exact_then_normalized_lookup(spark, sf):
    # the translations go by their hashes, as the result shows them
    own = _tm(spark, sf).where(M.usable(CONFIG, contexts=False) & (F.col("language_code") == "de")).withColumn("translated_text", F.md5("translated_text"))
    return M.lookup(_asked(spark, sf), own).select("text", F.col("translated_text").alias("translated_hash"), "phase")


@query(
    "dynamic_lookup_by_hash",
    f"""WITH {TM_SQL},
own AS (SELECT md5(trim(regexp_replace(original_text, '\\s{{2,}}', ' ', 'g'))) AS h, * FROM tm WHERE language_code = 'en' AND status >= 1),
b AS (SELECT h, id FROM (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY status DESC, updated_at DESC, id) AS r FROM own) WHERE r = 1),
asked AS (SELECT DISTINCT text FROM strings)
SELECT md5(text) AS text_hash, id FROM asked JOIN b ON md5(trim(regexp_replace(text, '\\s{{2,}}', ' ', 'g'))) = h""",
)
def dynamic_lookup_by_hash(spark, sf):
    own = _tm(spark, sf).where("language_code = 'en' and status >= 1").withColumn("translated_text", F.col("id").cast("string"))
    asked = _strings(spark, sf).select("text").distinct()
    return M.dynamic_lookup(asked, own).select(F.md5("text").alias("text_hash"), F.col("translated_text").cast("long").alias("id"))


@query(
    "reverse_lookup",
    f"""WITH {TM_SQL},
b AS (SELECT key, original_text FROM (SELECT translated_text AS key, original_text, row_number() OVER (PARTITION BY translated_text ORDER BY id) AS r FROM tm WHERE {USABLE_SQL} AND {CONTEXTS_SQL}) WHERE r = 1),
g AS (SELECT original_text, gettext_domain FROM (SELECT original_text, gettext_domain, row_number() OVER (PARTITION BY original_text ORDER BY id) AS r FROM tm WHERE kind = 'gettext') WHERE r = 1),
asked AS (SELECT DISTINCT reverse(text) AS text FROM strings)
SELECT md5(asked.text) AS text_hash, md5(b.original_text) AS original_hash, gettext_domain FROM asked JOIN b ON asked.text = key LEFT JOIN g ON b.original_text = g.original_text""",
)
def reverse_lookup(spark, sf):
    asked = _strings(spark, sf).select(F.reverse("text").alias("text")).distinct()
    return M.reverse_lookup(asked, _tm(spark, sf)).select(F.md5("text").alias("text_hash"), F.md5("original_text").alias("original_hash"), "gettext_domain")


@query("contained_keys_all", f"WITH {STRINGS_SQL}, t AS (SELECT DISTINCT text FROM strings) SELECT t.text, k.text AS key, octet_length(encode(t.text)) <= 500 AS node FROM t JOIN t k ON contains(t.text, k.text) AND length(t.text) > length(k.text)")
def contained_keys_all(spark, sf):
    """J16 to J18 over all lines; J16 takes the rows with node, as only nodes have a limit."""
    rows = stored(_strings(spark, sf).select("text").distinct(), "lines")
    return M.contained_keys(rows, rows.select(F.col("text").alias("key")), distinct=True).withColumn("node", F.octet_length("text") <= 500)


@query(
    "prefix_match_all",
    f"""WITH {STRINGS_SQL}, t AS (SELECT DISTINCT text FROM strings),
p AS (SELECT text, trim(substring(text, 1, k - 1)) AS key FROM (SELECT text, unnest(generate_series(1, length(text))) AS k FROM t) WHERE regexp_matches(substring(text, k, 1), '[|:–—-]'))
SELECT p.text, max_by(key, (length(key), key)) AS key FROM p JOIN t w ON key = w.text WHERE key <> '' GROUP BY p.text""",
)
def prefix_match_all(spark, sf):
    """J19 over all lines, each up to any separator, among all originals of the memory."""
    texts = _strings(spark, sf).select("text").distinct()
    return M.prefix_match(texts, _tm(spark, sf).select(F.col("original_text").alias("key")))


@query("normalized_groups", f"WITH {STRINGS_SQL}, {_ASKED_SQL}, n AS (SELECT DISTINCT {_n4_sql('text')} AS norm, text FROM (SELECT text FROM strings UNION ALL SELECT text FROM asked)) SELECT md5(norm) AS norm_hash, count(*) AS n_originals, md5(min(text)) AS first_hash FROM n GROUP BY norm")
def normalized_groups(spark, sf):
    # a group takes each original once, so lines needn't be distinct before; lines that are asked as they are give one row
    text, asked = F.col("text"), _asked_text()
    both = F.when(text == asked, F.array(text)).otherwise(F.array(text, asked))
    groups = M.normalized_groups(_strings(spark, sf).select(F.explode(both).alias("text")))
    return groups.select("norm_hash", F.size("originals").cast("long").alias("n_originals"), F.md5(F.col("originals")[0]).alias("first_hash"))


@query("text_fingerprints", f"WITH {STRINGS_SQL} SELECT doc_id, pos, md5({_n1_sql('text')}) AS n1, md5(lower({_n1_sql('text')})) AS n2, md5(lower(trim(regexp_replace(translate({_decode_sql('text')}, chr(160), ' '), '\\s+', ' ', 'g')))) AS n6 FROM strings")
def text_fingerprints(spark, sf):
    c = F.col("text")
    return _strings(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(T.normalize_once(c)).alias("n1"), F.md5(T.normalize_lookup(c)).alias("n2"), F.md5(T.normalize_seo(c)).alias("n6"))


@query("word_counts", f"WITH {STRINGS_SQL} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '[A-Za-z''-]+'))) AS BIGINT) AS words, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM strings GROUP BY doc_id")
def word_counts(spark, sf):
    return _strings(spark, sf).groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).cast("long").alias("words"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


# Translatable or not.


def _any_sql(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_q(p)})" for p in patterns) + ")"


_VALID_SQL = r"regexp_matches(text, '\p{L}') AND len(regexp_extract_all(text, '\p{L}')) / length(text) >= 0.3 AND NOT regexp_matches(text, '<[^>]*>') AND NOT regexp_matches(text, '[&%;][a-zA-Z0-9]{2,8};')"


@query("translatable_lines", f"WITH {STRINGS_SQL} SELECT doc_id, pos FROM strings WHERE length(text) BETWEEN 2 AND 500 AND NOT {_any_sql('text', P.SKIP_PATTERNS)} AND {_VALID_SQL}")
def translatable_lines(spark, sf):
    c = F.col("text")
    return _strings(spark, sf).where(P.length_ok(c) & ~P.skip_pattern(c) & P.valid_content(c)).select("doc_id", F.col("pos").cast("long").alias("pos"))


_USER_SQL = "((regexp_matches(text, '^[a-zA-Z0-9._-]+$') AND octet_length(encode(text)) < 30) OR (regexp_matches(text, '^[A-Z][a-z]+$') AND octet_length(encode(text)) < 15))"
_TECH_SQL = r"((regexp_matches(text, '^[a-z-]+(-[a-z0-9]+)*$') AND octet_length(encode(text)) > 5) OR (regexp_matches(text, '^[a-zA-Z][a-zA-Z0-9_-]*$') AND octet_length(encode(text)) > 8) OR (regexp_matches(text, '[/\\.]') AND NOT regexp_matches(text, '\s')))"
_ADMIN_SQL = f"(lower(trim(text)) IN ({', '.join(_q(s.lower()) for s in P.ADMIN_STRINGS)}) OR {' OR '.join(f'contains(lower(text), {_q(s.lower())})' for s in P.ADMIN_STRINGS if len(s.encode()) > 3)} OR {_USER_SQL} OR {_TECH_SQL})"


@query("processable_lines", f"WITH {STRINGS_SQL} SELECT doc_id, pos FROM strings WHERE length(text) BETWEEN 2 AND 500 AND NOT {_any_sql('text', P.SKIP_PATTERNS)} AND NOT {_ADMIN_SQL} AND {_VALID_SQL}")
def processable_lines(spark, sf):
    return _strings(spark, sf).where(P.should_process(F.col("text"), F.lit("text_node"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("capture_lines", f"WITH {STRINGS_SQL} SELECT doc_id, pos, octet_length(encode(text)) BETWEEN 2 AND 500 AS captured, {_any_sql('text', P.CAPTURE_SKIP_PATTERNS)} AS skipped FROM strings")
def capture_lines(spark, sf):
    c = F.col("text")
    return _strings(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), P.capture_ok(c, F.lit("text_node")).alias("captured"), P.capture_skip(c).alias("skipped"))


@query(
    "technical_lines",
    f"""WITH {STRINGS_SQL} SELECT doc_id, pos FROM strings WHERE text = '0' OR json_valid(text) OR regexp_matches(text, {_q(P.JSON_LIKE)}) OR regexp_matches(text, {_q(P.ESCAPED_TAGS)}) OR regexp_matches(text, {_q(P.VARIATION)})
OR regexp_matches(text, {_q(P.URL)}) OR regexp_matches(text, {_q(P.EMAIL)}) OR (regexp_matches(text, {_q(P.SLUG)}) AND regexp_matches(text, '[-_]')) OR regexp_matches(text, {_q(P.FILE_NAME)})""",
)
def technical_lines(spark, sf):
    return _strings(spark, sf).where(P.any_of(P.technical_memory(F.col("text")))).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("technical_reasons")
def technical_reasons(spark, sf):
    c = F.col("text")
    rows = _strings(spark, sf).select("doc_id", "pos", P.reasons(P.technical_memory(c)).alias("memory"), P.reasons(P.technical_render(c)).alias("render"), P.reasons(P.technical_item(c)).alias("item"), P.reasons(P.content_filter(c)).alias("filter"))
    return rows.where("size(memory) + size(render) + size(item) + size(filter) > 0")


@query("filtered_lines", f"WITH {STRINGS_SQL} SELECT doc_id, pos, octet_length(encode(text)) > 2000 AS too_long, {_any_sql('text', P.FILTER_PATTERNS)} AS pattern, {_any_sql('text', P.METADATA)} AS metadata FROM strings")
def filtered_lines(spark, sf):
    c = F.col("text")
    return _strings(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.octet_length(c) > 2000).alias("too_long"), P.matches_any(c, P.FILTER_PATTERNS).alias("pattern"), P.metadata_like(c).alias("metadata"))


@query("repetitive_text", f"WITH {STRINGS_SQL} SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id, pos) AS r FROM strings WHERE octet_length(encode(text)) >= 3) WHERE r > 5")
def repetitive_text(spark, sf):
    rows = M.repetitive(_strings(spark, sf).select(F.col("doc_id").alias("page_id"), "pos", "text"))
    return rows.select(F.col("page_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"))


# Several sources.


@query(
    "page_source_precedence",
    f"""WITH {TM_SQL}, c AS (SELECT doc_id AS post_id, language_code, translated_text, 0 AS prio, id FROM tm WHERE doc_id % 3 = 0 AND coalesce(translated_text, '') <> ''
UNION ALL SELECT doc_id, 'de', 'meta ' || source, 1, 0 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'de', 'legacy', 2, 0 FROM documents)
SELECT post_id, language_code, md5(translated_text) AS translated_hash, prio FROM (SELECT *, row_number() OVER (PARTITION BY post_id, language_code ORDER BY prio, id, translated_text DESC) AS r FROM c) WHERE r = 1""",
)
def page_source_precedence(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("post_id"), F.lit("de").alias("language_code"), F.concat(F.lit("meta "), "source").alias("translated_text"))
    tm = _tm(spark, sf).where("id div 4000000 % 3 = 0")
    found = PR.page_translation(tm, docs.where("post_id % 2 = 0"), docs.withColumn("translated_text", F.lit("legacy")))
    return found.select("post_id", "language_code", F.md5("translated_text").alias("translated_hash"), "prio")


@query(
    "string_source_precedence",
    f"""WITH {TM_SQL}, c AS (SELECT trim(original_text) AS k, translated_text, updated_at, id, 0 AS prio FROM tm WHERE language_code = 'de' AND status IN (1, 2) UNION ALL SELECT trim(original_text), translated_text, updated_at, id, 1 FROM tm WHERE language_code = 'de' AND status >= 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio, updated_at DESC, id) AS r FROM c WHERE translated_text <> '') WHERE r = 1)
SELECT md5(text) AS text_hash, md5(translated_text) AS translated_hash, prio FROM (SELECT DISTINCT text FROM strings) LEFT JOIN b ON trim(text) = k""",
)
def string_source_precedence(spark, sf):
    found = PR.string_translation(_strings(spark, sf).select("text"), _tm(spark, sf).where("language_code = 'de'"))
    return found.select(F.md5("text").alias("text_hash"), F.md5("translated_text").alias("translated_hash"), "prio")


@query(
    "attach_translations",
    f"""WITH {TM_SQL}, items AS (SELECT doc_id * 1000000 + pos AS item_id, CASE WHEN pos % 5 = 0 THEN 'seo_fields' ELSE 'content_blocks' END AS field_group, 'post_' || (doc_id + pos % 2) || '_content_blocks' AS context, text AS original FROM strings WHERE lang <> 'fr'),
c AS (SELECT context, translated_text FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY status DESC, id) AS r FROM tm WHERE language_code = 'fr' AND translated_text <> '') WHERE r = 1),
t AS (SELECT original_text, translated_text FROM (SELECT *, row_number() OVER (PARTITION BY original_text ORDER BY status DESC, id) AS r FROM tm WHERE language_code = 'fr' AND translated_text <> '') WHERE r = 1)
SELECT item_id, md5(CASE WHEN field_group = 'seo_fields' THEN c.translated_text ELSE t.translated_text END) AS translated_hash, CASE WHEN (CASE WHEN field_group = 'seo_fields' THEN c.translated_text ELSE t.translated_text END) IS NULL THEN 'pending' ELSE 'translated' END AS state
FROM items LEFT JOIN c USING (context) LEFT JOIN t ON original = original_text""",
)
def attach_translations(spark, sf):
    doc, pos = F.col("doc_id"), F.col("pos")
    items = _strings(spark, sf).where("lang != 'fr'").select((doc * 1_000_000 + pos).alias("item_id"), F.when(pos % 5 == 0, "seo_fields").otherwise("content_blocks").alias("field_group"), F.concat(F.lit("post_"), (doc + pos % 2), F.lit("_content_blocks")).alias("context"), F.col("text").alias("original"), F.lit(None).cast("int").alias("plural_form"), F.lit("fr").alias("language_code"))
    return PR.attach(items, _tm(spark, sf)).select("item_id", F.md5("translated_text").alias("translated_hash"), "state")


@query("already_translated", f"WITH {TM_SQL}, own AS (SELECT * FROM tm WHERE language_code = 'de' AND status >= 1 AND translated_text <> ''), known AS (SELECT original_text AS t FROM own UNION SELECT translated_text FROM own) SELECT md5(text) AS text_hash FROM (SELECT text FROM strings UNION SELECT reverse(text) FROM strings) WHERE text IN (SELECT t FROM known)")
def already_translated(spark, sf):
    rows = _strings(spark, sf)
    asked = rows.select("text").union(rows.select(F.reverse("text"))).distinct()
    return PR.already_translated(asked, _tm(spark, sf), "de").select(F.md5("text").alias("text_hash"))


@query("meta_maps", "WITH m AS (SELECT doc_id AS post_id, 'f' || doc_id % 3 AS field, source AS value FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents) SELECT post_id, count(*) AS n_fields, max(CASE WHEN field = 'lang' THEN value END) AS lang FROM m GROUP BY 1")
def meta_maps(spark, sf):
    docs = _t(spark, sf, "documents")
    meta = docs.select(F.col("doc_id").alias("post_id"), F.concat(F.lit("_translation_f"), F.col("doc_id") % 3).alias("meta_key"), F.col("source").alias("meta_value"))
    meta = meta.union(docs.select("doc_id", F.lit("_translation_lang"), "lang")).union(docs.select("doc_id", F.lit("_other"), "lang"))
    return PR.meta_translations(meta).select("post_id", F.size("fields").cast("long").alias("n_fields"), F.col("fields")["lang"].alias("lang"))


@query("unified_structure", f"WITH {TM_SQL} SELECT doc_id AS post_id, language_code, count(DISTINCT original_text) AS n_texts FROM tm GROUP BY 1, 2")
def unified_structure(spark, sf):
    rows = ST.unified_structure(_tm(spark, sf))
    # texts as keys may be longer than JSON readers take; without escapes, four quotes are left of each pair
    quotes = F.regexp_count(F.regexp_replace(F.col("groups")["content_blocks"], r"\\.", ""), F.lit('"'))
    return rows.select("post_id", "language_code", (quotes / 4).cast("long").alias("n_texts"))


# Sets of items.

_ITEMS_SQL = "items AS (SELECT doc_id % 20 AS page_id, ['content_blocks', 'seo_fields', 'page_strings', 'attributes', 'media'][CAST((doc_id + pos) % 5 AS INTEGER) + 1] AS field_group, doc_id * 1000000 + pos AS idx, ['meta', 'title'][CAST(pos % 2 AS INTEGER) + 1] AS type, text AS original FROM strings)"


def _items(spark, sf):
    groups = F.array(*[F.lit(x) for x in ("content_blocks", "seo_fields", "page_strings", "attributes", "media")])
    kinds = F.array(F.lit("meta"), F.lit("title"))
    doc, pos = F.col("doc_id"), F.col("pos")
    return _strings(spark, sf).select((doc % 20).alias("page_id"), F.get(groups, ((doc + pos) % 5).cast("int")).alias("field_group"), (doc * 1_000_000 + pos).alias("idx"), F.get(kinds, (pos % 2).cast("int")).alias("type"), F.col("text").alias("original"))


@query(
    "priority_dedupe",
    f"""WITH {STRINGS_SQL}, {_ITEMS_SQL} SELECT page_id, idx, field_group, type FROM items WHERE field_group = 'media' UNION ALL
SELECT page_id, idx, field_group, type FROM (SELECT *, row_number() OVER (PARTITION BY page_id, md5(original), CASE WHEN field_group = 'seo_fields' THEN type ELSE '' END ORDER BY CASE field_group WHEN 'content_blocks' THEN 4 WHEN 'seo_fields' THEN 3 WHEN 'page_strings' THEN 2 ELSE 1 END DESC, idx) AS r FROM items WHERE field_group <> 'media') WHERE r = 1""",
)
def priority_dedupe(spark, sf):
    return M.priority_dedupe(_items(spark, sf)).select("page_id", "idx", "field_group", "type")


@query("save_dedupe", f"WITH {STRINGS_SQL}, {_ITEMS_SQL} SELECT md5(original || '||' || CASE WHEN field_group = 'seo_fields' THEN type ELSE '' END) AS fingerprint, min(idx) AS idx FROM items GROUP BY 1")
def save_dedupe(spark, sf):
    seo = F.when(F.col("field_group") == "seo_fields", F.col("type"))
    return _items(spark, sf).groupBy(M.save_fingerprint(F.col("original"), F.lit(None).cast("int"), seo).alias("fingerprint")).agg(F.min("idx").alias("idx"))


def _n3_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace({_decode_sql(x)}, '(?i)<br\\s*/?\\s*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    x = _plain_sql(f"translate(translate({x}, chr(160), ' '), 'ёЁ', 'еЕ')", T.DOUBLE_QUOTES, '"')
    x = _plain_sql(_plain_sql(x, T.SINGLE_QUOTES, "'"), T.DASHES, "-")
    return f"lower(trim(regexp_replace(replace({x}, '…', '...'), '\\s+', ' ', 'g')))"


@query(
    "plaintext_conflict_all",
    f"""WITH {TM_SQL}, k AS (SELECT *, {_n3_sql('original_text')} AS plain FROM (SELECT id, language_code, CASE WHEN doc_id % 2 = 0 THEN '<b>' || original_text || '</b>' ELSE original_text END AS original_text FROM tm))
SELECT md5(plain) AS plain_hash, language_code, id FROM (SELECT *, row_number() OVER (PARTITION BY plain, language_code ORDER BY CAST(regexp_matches(original_text, '<[^>]*>') AS INTEGER) DESC, length(original_text) DESC, id) AS r FROM k) WHERE r = 1""",
)
def plaintext_conflict_all(spark, sf):
    """A20 over all rows of the memory."""
    original = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<b>"), "text", F.lit("</b>"))).otherwise(F.col("text"))
    sides = M.plain_sides(original)
    rows = M.build_memory(_t(spark, sf, "documents"), CONFIG, sides).select("id", "language_code", *sides)
    return M.plaintext_keys(rows).select("plain_hash", "language_code", "id")



# Changes.


@query("originals_backfill", f"WITH {TM_SQL} SELECT id, CAST(('0x' || substring(md5(original_text), 1, 15)) AS BIGINT) AS original_id FROM tm")
def originals_backfill(spark, sf):
    tm = _tm(spark, sf)
    return M.backfill_originals(tm, M.originals(tm)).select("id", "original_id")


_UPDATES_SQL = "updates AS (SELECT id + 4000000000000 AS id, original_text, original_text_hash, 'new ' || original_text AS translated_text, language_code, CASE WHEN pos % 2 = 0 THEN context ELSE context || '_x' END AS context, CASE WHEN pos % 4 = 0 THEN 'd' END AS gettext_domain, 2 AS status FROM tm WHERE doc_id % 3 = 0 AND language_code = 'fr')"


@query(
    "upsert_merge",
    f"""WITH {TM_SQL}, {_UPDATES_SQL},
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original_text_hash, language_code, context ORDER BY id DESC) AS r FROM updates) WHERE r = 1)
SELECT coalesce(tm.id, u.id) AS id, md5(CASE WHEN u.id IS NOT NULL THEN u.translated_text ELSE tm.translated_text END) AS translated_hash, coalesce(u.gettext_domain, tm.gettext_domain) AS gettext_domain, coalesce(u.status, tm.status) AS status
FROM tm FULL OUTER JOIN u ON tm.original_text_hash = u.original_text_hash AND tm.language_code = u.language_code AND tm.context = u.context""",
)
def upsert_merge(spark, sf):
    tm = _tm(spark, sf)
    pos = F.expr("id div 4 % 1000000")
    updates = tm.where("id div 4000000 % 3 = 0 and language_code = 'fr'").withColumn("context", F.when(pos % 2 == 0, F.col("context")).otherwise(F.concat("context", F.lit("_x"))))
    updates = updates.withColumn("gettext_domain", F.when(pos % 4 == 0, "d")).withColumn("translated_text", F.concat(F.lit("new "), "original_text")).withColumn("status", F.lit(2)).withColumn("id", F.col("id") + 4_000_000_000_000)
    return M.upsert(tm, updates).select("id", F.md5("translated_text").alias("translated_hash"), "gettext_domain", "status")


_CLEAN_SQL = r"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "saved_strings",
    rf"""WITH {TM_SQL},
edits AS (
  SELECT id, md5({_CLEAN_SQL.format(x='original_text')}) AS h, {_CLEAN_SQL.format(x="'new  <b>' || original_text || '</b> '")} AS t, language_code, CASE WHEN pos % 2 = 0 THEN context ELSE context || '_x' END AS context, TIMESTAMP '2025-01-01 00:00:00' + to_seconds(doc_id % 50) AS made
  FROM tm WHERE doc_id % 6 = 1 AND doc_id % 5 <> 0 AND language_code = 'fr'),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h, language_code, context ORDER BY made DESC, id DESC) AS r FROM edits) WHERE r = 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h, language_code ORDER BY made DESC, id DESC) AS r2 FROM u) WHERE r2 = 1),
saved AS (
  SELECT coalesce(tm.id, u.id) AS id, coalesce(u.h, tm.original_text_hash) AS h, coalesce(u.language_code, tm.language_code) AS language_code, u.id IS NOT NULL AS edited,
         CASE WHEN u.id IS NOT NULL THEN u.t ELSE tm.translated_text END AS t, CASE WHEN u.id IS NOT NULL THEN 2 ELSE tm.status END AS status, CASE WHEN u.id IS NOT NULL THEN 'custom' ELSE tm.kind END AS source
  FROM tm FULL OUTER JOIN u ON tm.original_text_hash = u.h AND tm.language_code = u.language_code AND tm.context = u.context)
SELECT s.id, s.source, s.language_code, md5(CASE WHEN f.id IS NOT NULL AND s.source = 'gettext' AND NOT s.edited THEN f.t ELSE s.t END) AS translated_hash,
       CAST(CASE WHEN f.id IS NOT NULL AND s.source = 'gettext' AND NOT s.edited THEN 1 ELSE s.status END AS INTEGER) AS status
FROM saved s LEFT JOIN f ON f.h = s.h AND f.language_code = s.language_code""",
)
def saved_strings(spark, sf):
    """French strings of every sixth document edited, in their own or a new context, and passed on to gettext rows."""
    tm = _tm(spark, sf)
    doc, pos = F.expr("id div 4000000"), F.expr("id div 4 % 1000000")
    edits = tm.where((doc % 6 == 1) & (doc % 5 != 0) & (F.col("language_code") == "fr"))
    edits = edits.withColumn("context", F.when(pos % 2 == 0, F.col("context")).otherwise(F.concat("context", F.lit("_x"))))
    edits = edits.withColumn("translated_text", F.concat(F.lit("new  <b>"), "original_text", F.lit("</b> "))).withColumn("updated_at", F.expr("timestamp'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id div 4000000 % 50)"))
    return M.save_strings(tm, edits).select("id", "source", "language_code", F.md5("translated_text").alias("translated_hash"), "status")


@query(
    "delete_on_empty",
    f"""WITH {TM_SQL}, edits AS (SELECT original_text_hash, context, language_code, CASE WHEN pos % 2 = 0 THEN 'seo' ELSE 'content' END AS kind FROM tm WHERE doc_id % 7 = 0 AND pos % 3 = 0)
SELECT id FROM tm WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.kind = 'seo' AND e.context = tm.context AND e.language_code = tm.language_code) AND NOT EXISTS (SELECT 1 FROM edits e WHERE e.kind <> 'seo' AND e.original_text_hash = tm.original_text_hash AND e.language_code = tm.language_code)""",
)
def delete_on_empty(spark, sf):
    tm = _tm(spark, sf)
    pos = F.expr("id div 4 % 1000000")
    edits = tm.where((F.expr("id div 4000000") % 7 == 0) & (pos % 3 == 0)).select("original_text", "context", F.when(pos % 2 == 0, "seo").otherwise("content").alias("kind"), "language_code", F.lit("").alias("translated_text"))
    return M.delete_on_empty(tm, edits).select("id")


@query("delete_pages", f"WITH {TM_SQL} SELECT id FROM tm WHERE doc_id % 10 <> 1")
def delete_pages(spark, sf):
    gone = _t(spark, sf, "documents").where("doc_id % 10 = 1").select(F.col("doc_id").alias("post_id"))
    return M.delete_pages(_tm(spark, sf), gone).select("id")


@query("update_by_id", f"WITH {TM_SQL} SELECT id, CASE WHEN id % 9 = 0 THEN CASE WHEN id % 2 = 0 THEN 0 ELSE 2 END ELSE status END AS status, md5(CASE WHEN id % 9 = 0 THEN CASE WHEN id % 2 = 0 THEN '' ELSE 'edited' END ELSE translated_text END) AS translated_hash FROM tm")
def update_by_id(spark, sf):
    tm = _tm(spark, sf)
    edits = tm.where("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 0, "").otherwise("edited").alias("translated_text"))
    return M.update_by_id(tm, edits).select("id", "status", F.md5("translated_text").alias("translated_hash"))


@query(
    "register_missing",
    f"""WITH {TM_SQL}, forms(language_code, nplurals) AS (VALUES ('en', 2), ('ru', 3), ('ja', 1), ('ar', 6)), known AS (SELECT DISTINCT original_text_hash FROM tm WHERE doc_id % 2 = 0),
new AS (SELECT DISTINCT text, length(text) < 40 AS is_plural FROM strings WHERE md5(text) NOT IN (SELECT original_text_hash FROM known))
SELECT md5(text) AS text_hash, language_code, CAST(NULL AS INTEGER) AS plural_form FROM new, forms WHERE NOT is_plural UNION ALL
SELECT md5(text), language_code, CAST(unnest(generate_series(0, nplurals - 1)) AS INTEGER) FROM new, forms WHERE is_plural""",
)
def register_missing(spark, sf):
    forms = {x: PL.form_count(x) for x in ("en", "ru", "ja", "ar")}
    texts = _strings(spark, sf).select("text", (F.char_length("text") < 40).alias("is_plural"))
    return M.register_missing(texts, _tm(spark, sf).where("id div 4000000 % 2 = 0"), forms).select(F.md5("text").alias("text_hash"), "language_code", "plural_form")


@query(
    "menu_reconcile",
    """WITH current AS (SELECT source AS code, doc_id AS item_id FROM documents), wanted AS (SELECT DISTINCT source AS code FROM documents UNION SELECT 'missing'),
f AS (SELECT code, min(item_id) AS first_id FROM current GROUP BY code)
SELECT coalesce(c.code, w.code) AS code, item_id, CASE WHEN c.code IS NULL THEN 'insert' WHEN w.code IS NULL THEN 'delete' WHEN item_id <> first_id THEN 'delete' ELSE 'update' END AS action
FROM (SELECT current.*, first_id FROM current JOIN f USING (code)) c FULL OUTER JOIN wanted w ON c.code = w.code""",
)
def menu_reconcile(spark, sf):
    docs = _t(spark, sf, "documents")
    wanted = docs.select(F.col("source").alias("code")).union(spark.range(1).select(F.lit("missing").alias("code")))
    return M.reconcile(docs.select(F.col("source").alias("code"), F.col("doc_id").alias("item_id")), wanted)


# Search.

_SEARCH_SQL = f"WITH {TM_SQL}, hits AS (SELECT doc_id FROM tm WHERE language_code = 'fr' AND contains(translated_text, 'eht') AND contains(translated_text, 'no') UNION SELECT doc_id FROM documents WHERE contains(text, 'eht') AND contains(text, 'no'))"


@query("search_all_terms", _SEARCH_SQL + " SELECT doc_id FROM hits")
def search_all_terms(spark, sf):
    return SE.search(_tm(spark, sf), _t(spark, sf, "documents"), '"eht" no', "fr")


@query("search_intersect", _SEARCH_SQL + " SELECT doc_id FROM hits INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def search_intersect(spark, sf):
    return SE.within(_t(spark, sf, "labels").where("quality = 1").select("doc_id"), search_all_terms(spark, sf))


# URLs.

_PATH_SQL = "CASE WHEN regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1) END"
_HEAD_SQL, _TAIL_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "regexp_extract(url, '([?#].*)$', 1)"
_CODES_SQL = ", ".join(_q(x) for x in LANGS)


def _clean_sql(path: str) -> str:
    return f"CASE WHEN regexp_replace({path}, '^(/({'|'.join(LANGS)}))+(/|$)', '\\3') = '' THEN '/' ELSE regexp_replace({path}, '^(/({'|'.join(LANGS)}))+(/|$)', '\\3') END"


def _norm_sql(path: str) -> str:
    return f"CASE WHEN regexp_replace('/' || {path}, '/+', '/', 'g') = '/' THEN '/' ELSE regexp_replace(regexp_replace('/' || {path}, '/+', '/', 'g'), '/$', '') END"


@query("page_language_from_url", f"SELECT page_id, CASE WHEN string_split(ltrim({_PATH_SQL}, '/'), '/')[1] IN ({_CODES_SQL}) THEN string_split(ltrim({_PATH_SQL}, '/'), '/')[1] END AS language_code FROM pages")
def page_language_from_url(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.language_of(F.col("url"), LANGS).alias("language_code"))


@query("prefixed_urls", f"SELECT page_id, code, CASE WHEN code = 'en' OR starts_with({_PATH_SQL}, '/' || code || '/') THEN url ELSE {_HEAD_SQL} || '/' || code || {_PATH_SQL} || {_TAIL_SQL} END AS prefixed FROM pages, (VALUES ('en'), ('fr'), ('de'), ('es')) l(code)")
def prefixed_urls(spark, sf):
    rows = _t(spark, sf, "pages").select("page_id", "url", F.explode(F.array(*[F.lit(x) for x in LANGS])).alias("code"))
    return rows.select("page_id", "code", U.add_language(F.col("url"), F.col("code"), CONFIG.default).alias("prefixed"))


@query("stripped_urls", f"SELECT page_id, {_clean_sql(_PATH_SQL)} AS stripped, {_norm_sql('(' + _clean_sql(_PATH_SQL) + ')')} AS normalized FROM pages")
def stripped_urls(spark, sf):
    clean = U.strip_languages(U.path_of(F.col("url")), LANGS)
    return _t(spark, sf, "pages").select("page_id", clean.alias("stripped"), U.normalize_path(clean).alias("normalized"))


def _for_language_sql(code: str) -> str:
    clean = f"({_clean_sql(_PATH_SQL)})"
    path = f"(CASE WHEN {code} = 'en' THEN {clean} ELSE '/' || {code} || {clean} END)"
    return f"{_HEAD_SQL} || ({_norm_sql(path)}) || {_TAIL_SQL}"


@query(
    "hreflang_matrix",
    f"""WITH x AS (SELECT page_id, hreflang, {_for_language_sql('code')} AS href FROM pages, (VALUES ('en', 'en'), ('fr', 'fr'), ('de', 'de'), ('es', 'es'), ('x-default', 'en')) l(hreflang, code))
SELECT page_id, hreflang, CASE WHEN regexp_matches(href, '^[a-z]+://[^/?#]*/?({'|'.join(LANGS)})?$') THEN regexp_replace(href, '/$', '') || '/' ELSE href END AS href FROM x""",
)
def hreflang_matrix(spark, sf):
    return U.hreflangs(_t(spark, sf, "pages"), "url", LANGS, CONFIG.default).select("page_id", "hreflang", "href")


@query(
    "page_links_classified",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(href, '(?i)^(mailto|tel|javascript|data|sms|whatsapp|viber|skype):') THEN 'special'
WHEN regexp_matches(href, '^(https?:)?//') THEN 'external' WHEN regexp_matches(href, '^/wp-(admin|login|content|includes|json)') THEN 'admin' ELSE 'internal' END AS kind, count(*) AS n FROM l GROUP BY 1, 2, 3""",
)
def page_links_classified(spark, sf):
    links = _t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", "href", U.classify_link(F.col("href"), F.lit("")).alias("kind")).groupBy("page_id", "href", "kind").agg(F.count("*").alias("n"))


@query("media_normalize", r"SELECT page_id, regexp_replace(regexp_replace('https://cdn.example.com/img-' || page_id || '-2-300x200.jpg', '-\d+x\d+(\.[a-zA-Z0-9]+)$', '\1'), '-\d+(\.[a-zA-Z0-9]+)$', '\1') AS media_key FROM pages")
def media_normalize(spark, sf):
    src = F.concat(F.lit("//cdn.example.com/img-"), "page_id", F.lit("-2-300x200.jpg?v=1"))
    return _t(spark, sf, "pages").select("page_id", U.media_key(src).alias("media_key"))


@query("page_cache_keys", "SELECT page_id, md5(url || '_' || 'guest' || '_' || 'fr') AS page_key FROM pages")
def page_cache_keys(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.page_key(F.col("url"), F.lit("guest"), F.lit("fr")).alias("page_key"))


# Plurals.

_PLURAL_LANGS = ("en", "fr", "ru", "uk", "pl", "cs", "sl", "ga", "gd", "br", "ar", "ja", "tr", "sr")


# Written by hand, apart from the rules that are under test: forms of n by language.
_FORMS_SQL = """CASE
WHEN language_code IN ('ja', 'tr') THEN 0
WHEN language_code = 'fr' THEN CASE WHEN n > 1 THEN 1 ELSE 0 END
WHEN language_code = 'en' THEN CASE WHEN n = 1 THEN 0 ELSE 1 END
WHEN language_code IN ('ru', 'sr') THEN CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 10 AND 19 THEN 1 ELSE 2 END
WHEN language_code = 'uk' THEN CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT IN (12, 13, 14) THEN 1 ELSE 2 END
WHEN language_code = 'pl' THEN CASE WHEN n = 1 THEN 0 WHEN n % 10 IN (2, 3, 4) AND n % 100 // 10 <> 1 THEN 1 ELSE 2 END
WHEN language_code = 'cs' THEN CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END
WHEN language_code = 'sl' THEN CASE n % 100 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 3 END
WHEN language_code = 'gd' THEN CASE WHEN n IN (1, 11) THEN 0 WHEN n IN (2, 12) THEN 1 WHEN n BETWEEN 3 AND 19 THEN 2 ELSE 3 END
WHEN language_code = 'ga' THEN CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 WHEN n BETWEEN 3 AND 6 THEN 2 WHEN n BETWEEN 7 AND 10 THEN 3 ELSE 4 END
WHEN language_code = 'br' THEN CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 WHEN n % 10 = 1 THEN 2 WHEN n % 10 = 2 THEN 3 ELSE 4 END
WHEN language_code = 'ar' THEN CASE WHEN n IN (0, 1, 2) THEN n WHEN n % 100 BETWEEN 3 AND 10 THEN 3 WHEN n % 100 >= 11 THEN 4 ELSE 5 END END"""
_LANGS_SQL = "(VALUES ('en', 2), ('fr', 2), ('ru', 3), ('uk', 3), ('pl', 3), ('cs', 3), ('sl', 4), ('ga', 5), ('gd', 4), ('br', 5), ('ar', 6), ('ja', 1), ('tr', 1), ('sr', 3)) v(language_code, nplurals)"


@query("plural_index_grid", f"SELECT language_code, n, CAST({_FORMS_SQL} AS INTEGER) AS form FROM (SELECT range AS n FROM range(0, 201)), {_LANGS_SQL}")
def plural_index_grid(spark, sf):
    grid = spark.range(201).select(F.col("id").alias("n"), F.explode(F.array(*[F.lit(x) for x in _PLURAL_LANGS])).alias("language_code"))
    return grid.select("language_code", "n", PL.form_for(F.col("language_code"), F.col("n"), _PLURAL_LANGS).alias("form"))


@query("plural_counts", f"SELECT language_code, CAST(nplurals AS INTEGER) AS nplurals FROM {_LANGS_SQL}")
def plural_counts(spark, sf):
    return PL.rule_table(spark, _PLURAL_LANGS).select("language_code", "nplurals")


@query(
    "plural_maps",
    f"""WITH {TM_SQL}, forms AS (SELECT original_text, language_code, CAST(pos % 3 AS INTEGER) AS plural_form, max(coalesce(translated_text, '')) AS t FROM tm GROUP BY 1, 2, 3)
SELECT md5(original_text) AS text_hash, language_code, count(*) AS forms, CAST(sum(CASE WHEN t <> '' THEN 1 ELSE 0 END) AS BIGINT) AS translated, md5(max_by(t, plural_form)) AS last_hash FROM forms GROUP BY original_text, language_code""",
)
def plural_maps(spark, sf):
    """A9, A10; the strings stand by their hashes, as the result has them, so texts move once."""
    pos, empty = F.expr("id div 4 % 1000000"), F.col("t") == ""
    rows = _tm(spark, sf).select("original_text_hash", "language_code", (pos % 3).cast("int").alias("plural_form"), F.coalesce("translated_text", F.lit("")).alias("t"))
    rows = rows.groupBy("original_text_hash", "language_code", "plural_form").agg(F.max("t").alias("t"))
    maps = ST.plural_maps(rows.select(F.col("original_text_hash").alias("original_text"), "language_code", "plural_form", F.when(empty, "").otherwise(F.md5("t")).alias("translated_text")))
    last = F.when(F.col("last_form") == "", F.md5(F.lit(""))).otherwise(F.col("last_form"))
    return ST.completeness_of(maps).select(F.col("original_text").alias("text_hash"), "language_code", "forms", "translated", last.alias("last_hash"))


# Pages.


@query("page_titles", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""".replace("\\\\", "\\"))
def page_titles(spark, sf):
    return H.strings_of(_t(spark, sf, "pages")).where("kind = 'title'").select("page_id", F.col("text").alias("title"))


@query("page_items")
def page_items(spark, sf):
    return H.items_of(_t(spark, sf, "pages"))


@query("page_item_counts")
def page_item_counts(spark, sf):
    return ST.items_by_group(H.items_of(_t(spark, sf, "pages")))


@query(
    "page_text_nodes",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]+</a></li>')) AS BIGINT) AS n_menu, CAST(len(regexp_extract_all(html, '<h1>[^<]+</h1>')) AS BIGINT) AS n_heads FROM pages""",
)
def page_text_nodes(spark, sf):
    nodes = D.text_nodes(_t(spark, sf, "pages"))
    return nodes.groupBy("page_id").agg(F.sum((F.col("in_global") & (F.col("context") == "text_node") & (F.col("kind") == "text")).cast("long") - F.col("text").startswith("©").cast("long")).alias("n_menu"), F.sum((F.col("context") == "heading").cast("long")).alias("n_heads"))


@query("capturable_nodes")
def capturable_nodes(spark, sf):
    return D.capturable(D.text_nodes(_t(spark, sf, "pages")))


_SENTENCE = '<(?:h1|p|div class="ad")>([^<&]{40,})</(?:h1|p|div)>'
_DECODED_SQL = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_FOLDED_SQL = r"trim(replace(translate(regexp_replace({x}, '\s{{2,}}', ' ', 'g'), '–—‐ёЁ“”‟„«»‘’‛‹›', '---еЕ' || repeat('\"', 6) || repeat(chr(39), 5)), '…', '...'))".replace('\\"', '"')


@query(
    "localized_pages",
    rf"""WITH tm AS (
  SELECT DISTINCT lower({_FOLDED_SQL.format(x='x')}) AS k FROM (SELECT unnest(regexp_extract_all(html, '{_SENTENCE}', 1)) AS x FROM pages)
  WHERE md5(lower({_FOLDED_SQL.format(x='x')})) < '8'),
pieces AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|p|div class="ad")>[^<]+</(?:h1|p|div)>|<b>[^<]+<br>|<title>[^<]+</title>')) AS piece FROM pages),
parts AS (
  SELECT page_id, piece, count(*) AS n, regexp_extract(piece, '^<[^>]*>') AS tag, regexp_extract(piece, '<[^>]*>$') AS ends,
         {_FOLDED_SQL.format(x=_DECODED_SQL.format(x="regexp_extract(piece, '>([^<]*)<', 1)"))} AS x
  FROM pieces GROUP BY page_id, piece),
nodes AS (SELECT DISTINCT x, lower(x) AS low FROM parts WHERE tag NOT IN ('<b>', '<title>') AND octet_length(encode(x)) <= 500),
held AS (
  SELECT x, max_by(left(x, strpos(low, k) - 1) || 'T ' || reverse(k) || substr(x, strpos(low, k) + length(k)), (octet_length(encode(k)), k)) AS found
  FROM nodes JOIN tm ON contains(low, k) AND low <> k AND octet_length(encode(low)) <= octet_length(encode(k)) + 15 GROUP BY x),
made AS (
  SELECT p.page_id, p.piece, p.n, p.tag || CASE WHEN p.tag <> '<title>' THEN regexp_extract(p.piece, '>(\s*)[^<]*<', 1) ELSE '' END
         || CASE WHEN tm.k IS NOT NULL THEN 'T ' || reverse(tm.k) ELSE replace(h.found, '&', '&amp;') END
         || CASE WHEN p.tag <> '<title>' THEN regexp_extract(p.piece, '(\s*)<[^<]*$', 1) ELSE '' END || p.ends AS fresh
  FROM parts p LEFT JOIN tm ON tm.k = lower(p.x) LEFT JOIN held h ON h.x = p.x AND p.tag NOT IN ('<b>', '<title>')),
own AS (SELECT page_id, list(piece || chr(1) || fresh ORDER BY piece) AS steps, sum(n) AS n FROM made WHERE fresh IS NOT NULL GROUP BY page_id)
SELECT page_id, coalesce(list_reduce([html] || steps, lambda acc, e: replace(acc, split_part(e, chr(1), 1), split_part(e, chr(1), 2))), html) AS html, CAST(coalesce(n, 0) AS BIGINT) AS n_translated
FROM pages LEFT JOIN own USING (page_id)""",
)
def localized_pages(spark, sf):
    """Every page with half of the sentences that pages show translated."""
    pages = _t(spark, sf, "pages")
    texts = pages.select(F.explode(F.regexp_extract_all("html", F.lit(_SENTENCE), F.lit(1))).alias("original_text")).distinct()
    key = T.normalize_lookup(F.col("original_text"))
    tm = texts.where(F.md5(key) < "8").withColumn("translated_text", F.concat(F.lit("T "), F.reverse(key)))
    return RW.localize(pages, tm).select("page_id", "html", "n_translated")


#: What the fixture's pages have, by selectors of every kind.
PAGE_SELECTORS = {"menu": ("nav > ul li > a[href^='/']",), "ad": ("div.ad",), "headline": ("body article > h1, body main > h1",), "notice_before": ("div[class=ad] + article > h1",), "footer": ("html body > footer", "body > p.footer")}
_PLAIN_SQL = "trim(regexp_replace(" + _DECODED_SQL.format(x="t") + r", '\s+', ' ', 'g'))"


@query(
    "selected_elements",
    f"""WITH found AS (
  SELECT page_id, 'menu' AS name, unnest(regexp_extract_all(html, '<li><a href="/[^"]*">([^<]*)</a></li>', 1)) AS t FROM pages
  UNION ALL SELECT page_id, 'ad', unnest(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)) FROM pages
  UNION ALL SELECT page_id, 'headline', unnest(regexp_extract_all(html, '<article><h1>([^<]*)</h1>', 1)) FROM pages
  UNION ALL SELECT page_id, 'notice_before', unnest(regexp_extract_all(html, '<div class="ad">[^<]*</div><article><h1>([^<]*)</h1>', 1)) FROM pages
  UNION ALL SELECT page_id, 'footer', unnest(regexp_extract_all(html, '<footer>([^<]*)</footer>', 1)) FROM pages)
SELECT page_id, name, {_PLAIN_SQL} AS text, count(*) AS n FROM found GROUP BY ALL""",
)
def selected_elements(spark, sf):
    return S.selected(_t(spark, sf, "pages"), PAGE_SELECTORS).groupBy("page_id", "name", "text").agg(F.count("*").alias("n"))


@query("localization_summary", "SELECT " + f"CASE WHEN string_split(ltrim({_PATH_SQL}, '/'), '/')[1] IN ({_CODES_SQL}) THEN string_split(ltrim({_PATH_SQL}, '/'), '/')[1] END AS language_code, count(*) AS n_pages, CAST(sum(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS BIGINT) AS n_links, CAST(sum(CASE WHEN octet_length(encode(html)) >= 100 AND regexp_matches(html, '(?i)<html|<!DOCTYPE') THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM pages GROUP BY 1")
def localization_summary(spark, sf):
    pages = _t(spark, sf, "pages").select(U.language_of(F.col("url"), LANGS).alias("language_code"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("links"), P.valid_page(F.col("html")).alias("valid"))
    return pages.groupBy("language_code").agg(F.count("*").alias("n_pages"), F.sum("links").cast("long").alias("n_links"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


# Streams.


@query(
    "stream_lookup",
    f"""WITH {TM_SQL}, own AS (SELECT original_text, id FROM (SELECT original_text, id, row_number() OVER (PARTITION BY md5(trim(regexp_replace(original_text, '\\s{{2,}}', ' ', 'g'))) ORDER BY status DESC, updated_at DESC, id) AS r, md5(trim(regexp_replace(original_text, '\\s{{2,}}', ' ', 'g'))) AS h FROM tm WHERE language_code = 'de') WHERE r = 1)
SELECT conv_id, turn, md5(text) AS text_hash, max(id) AS id FROM conversations LEFT JOIN own ON trim(regexp_replace(text, '\\s{{2,}}', ' ', 'g')) = trim(regexp_replace(original_text, '\\s{{2,}}', ' ', 'g')) GROUP BY 1, 2, 3""",
)
def stream_lookup(spark, sf):
    table = _t(spark, sf, "conversations")
    stream = SL.table_stream(spark, f"{sf}/conversations.parquet", table.schema)
    tm = _tm(spark, sf).where("language_code = 'de'").withColumn("translated_text", F.col("id").cast("string"))
    found = SL.run_available(spark, SL.lookup_stream(stream.select("conv_id", "turn", "text"), tm), "stream_lookup")
    return found.select("conv_id", "turn", F.md5("text").alias("text_hash"), F.col("translated_text").cast("long").alias("id"))


@query("stream_strings_once", "SELECT DISTINCT conv_id, md5(text) AS text_hash FROM conversations")
def stream_strings_once(spark, sf):
    """The strings of each conversation that a stream has to look up: none twice within an hour."""
    path, schema = f"{sf}/conversations.parquet", _t(spark, sf, "conversations").schema
    stream = SL.table_stream(spark, path, schema).select("conv_id", F.md5("text").alias("text_hash"), F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("turn", F.lit(0))).alias("seen_at"))
    return SL.run_available(spark, SL.asked_once(stream, "1 hour", ("conv_id", "text_hash")), "strings_once").select("conv_id", "text_hash")


from glossaloom.plans import single as _single  # noqa: E402, F401  registers its queries here

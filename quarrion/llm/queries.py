"""The queries of this subpackage and their SQL; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm import factorization, forest, licences, maintext, mixing, piecewise, sharding, substring, turns, urllists, vectorcodes, warc, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(_table(spark, sf_dir, "pages")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.fingerprints(_table(spark, sf_dir, "documents"))


def _captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the tables hold no fetch time, so the id gives one within January 2024."""
    seconds = F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(2592000))
    return pages.select("page_id", "url", F.timestamp_seconds(seconds).alias("fetched_at"))


def _list_entries(pages: DataFrame, events: DataFrame) -> DataFrame:
    """The events as dated list entries for the host, or at sign-ups for the parent domain, of the page whose id is the user's."""
    hosts = pages.select(F.col("page_id").alias("user_id"), urllists.host_of(F.col("url")).alias("host"))
    domain = F.when(F.col("event_type") == "signup", F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    return events.join(hosts, "user_id").select(domain.alias("domain"), F.col("event_type").isin("error", "signup").alias("listed"), F.col("ts").cast("timestamp").alias("ts"))


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = urllists.evaluate(_captures(pages), _list_entries(pages, _table(spark, sf_dir, "events")))
    return found.select("page_id", "url", "host", "fetched_at", "blocked", "matched", "since", "until")


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages"))


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(_table(spark, sf_dir, "embeddings")).drop("rescans")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(_table(spark, sf_dir, "conversations")), present=F.col("present"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_substring_dedup, op3_decontamination, op4_quality_classifier, op5_piecewise_fingerprints,
        op6_temporal_url_lists, op7_source_mixture, op8_minhash_near_dedup, op9_licence_digests, op10_html_main_text,
        op11_rendezvous_shards, op12_vector_codes, op13_conversation_repair,
    )
}


def _quoted(text: str) -> str:
    """A DuckDB string constant; line ends and other controls are spelt as chr()."""
    parts = [f"'{p}'" for p in text.replace("'", "''").split("\n")]
    return "(" + " || chr(10) || ".join(parts).replace("\r", "' || chr(13) || '") + ")"


def _replaced(column: str, steps) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return column


def _uuid_sql(text: str) -> str:
    h = f"sha256({text})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_OP1 = f"""
WITH response AS (
  SELECT {_uuid_sql("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha256(coalesce(html, ''))")} AS record_id, url AS target_uri, coalesce(html, '') AS payload FROM pages
), source AS (
  SELECT record_id, target_uri, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) AS source_headers,
    'sha256:' || sha256(payload) AS source_digest, {_replaced("payload", warc.TEXT_STEPS)} AS text,
    trim(regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title,
    len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref=')) AS links
  FROM response
), both_kinds AS (
  SELECT 'metadata' AS warc_type, 'application/warc-fields' AS content_type, 'software: {warc.SOFTWARE}' || chr(13) || chr(10) || 'source-digest: ' || source_digest || chr(13) || chr(10) || 'text-digest: sha256:' || sha256(text)
    || chr(13) || chr(10) || 'title: ' || title || chr(13) || chr(10) || 'outlinks: ' || links || chr(13) || chr(10) || 'source-headers: ' || replace(source_headers, chr(13) || chr(10), chr(13) || chr(10) || ' ') || chr(13) || chr(10) AS block, * EXCLUDE (text, title, links) FROM source
  UNION ALL
  SELECT 'conversion', 'text/plain; charset=utf-8', text, * EXCLUDE (text, title, links) FROM source
)
SELECT {_uuid_sql("warc_type || '|' || record_id")} AS record_id, warc_type, record_id AS refers_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, source_headers, block
FROM both_kinds
"""

_HOST_SQL = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"

_OP6 = f"""
WITH hosted AS (
  SELECT page_id, url, {_HOST_SQL} AS host, make_timestamp(CAST((1704067200 + (page_id * 7919) % 2592000) * 1000000 AS BIGINT)) AS fetched_at FROM pages
), entry AS (
  SELECT CASE WHEN event_type = 'signup' THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END AS domain, ts, max(event_type IN ('error', 'signup')) AS listed
  FROM events JOIN hosted ON page_id = user_id GROUP BY ALL
), valid AS (
  SELECT domain, listed, ts AS since, lead(ts) OVER (PARTITION BY domain ORDER BY ts) AS until FROM entry
), asked AS (
  SELECT DISTINCT host, fetched_at, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS domain FROM hosted
), hit AS (
  SELECT host, fetched_at, domain, since, until, row_number() OVER (PARTITION BY host, fetched_at ORDER BY length(domain) DESC) AS n
  FROM asked JOIN valid USING (domain) WHERE listed AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
)
SELECT page_id, url, host, fetched_at, domain IS NOT NULL AS blocked, domain AS matched, since, until
FROM hosted LEFT JOIN (SELECT * FROM hit WHERE n = 1) USING (host, fetched_at)
"""


def _canonical_sql(text: str) -> str:
    c = f"regexp_replace(lower(regexp_replace(coalesce({text}, ''), {_quoted(licences.COPYRIGHT_LINE)}, '', 'g')), {_quoted(r'[^\p{L}\p{N}' + chr(10) + ']+')}, ' ', 'g')"
    for old, new in licences.SPELLINGS:
        c = f"replace({c}, '{old}', '{new}')"
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_KNOWN_SQL = ", ".join(f"('{i}', {_quoted(t)})" for i, t in licences.KNOWN)

_OP9 = f"""
WITH known AS (
  SELECT sha256(array_to_string(lines, ' ')) AS digest, min(licence_id) AS licence_id
  FROM (SELECT licence_id, {_canonical_sql("text")} AS lines FROM (VALUES {_KNOWN_SQL}) AS v(licence_id, text)) WHERE len(lines) > 0 GROUP BY 1
), doc AS (SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line FROM doc),
met AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS ids FROM line JOIN known ON sha256(line) = digest GROUP BY 1)
SELECT doc.doc_id, len(lines) AS n_lines, sha256(array_to_string(lines, ' ')) AS text_digest, licence_id, coalesce(n, 0) AS n_notices, coalesce(ids, '') AS notices
FROM doc LEFT JOIN known ON sha256(array_to_string(lines, ' ')) = digest LEFT JOIN met ON met.doc_id = doc.doc_id
"""

_M64 = (1 << 64) - 1


def _hash_sql(source: str, values: list[str], out: str) -> str:
    """source with the 64-bit xxHash of the values, whole numbers that follow each other with the hash before as seed; nulls are passed over."""
    m, p = f"{_M64}::UHUGEINT", [f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
    rel = f"SELECT *, 42::UHUGEINT AS _h FROM ({source})"
    for value in values:
        steps = [
            f"((({value}::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT * {p[1]}) & {m}", f"((((_k << 31) & {m}) | (_k >> 33)) * {p[0]}) & {m}",
            f"xor((_h + {p[4]} + 8::UHUGEINT) & {m}, _k)", f"((((_k << 27) & {m}) | (_k >> 37)) * {p[0]} + {p[3]}) & {m}",
            f"(xor(_k, _k >> 33) * {p[1]}) & {m}", f"(xor(_k, _k >> 29) * {p[2]}) & {m}", "xor(_k, _k >> 32)",
        ]
        for i, step in enumerate(steps):
            rel = f"SELECT {'*' if not i else '* EXCLUDE (_k)'}, {step} AS _k FROM ({rel})"
        rel = f"SELECT * EXCLUDE (_k, _h), CASE WHEN {value} IS NULL THEN _h ELSE _k END AS _h FROM ({rel})"
    return f"SELECT * EXCLUDE (_h), _h AS {out} FROM ({rel})"


def _crc_sql(text: str) -> str:
    """CRC-32 of a text, by the halves of its bytes."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    half = lambda c: f"xor({c} >> 4, ({table}::BIGINT[])[1 + ({c} & 15)])"
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: {half('(' + half('xor(c, b)') + ')')}), 4294967295)"


_OP11 = f"""
WITH doc AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + {sharding.OVERHEAD} AS BIGINT) AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
key AS (SELECT doc_id, unnest(range({sharding.SHARDS + 1})) AS s FROM (SELECT DISTINCT doc_id FROM doc)),
score AS ({_hash_sql("SELECT * FROM key", ["doc_id", "s"], "score")}),
best AS (
  SELECT doc_id, CAST(arg_max(s, score >> 11) AS INTEGER) AS grown_shard, CAST(arg_max(s, score >> 11) FILTER (s < {sharding.SHARDS}) AS INTEGER) AS shard FROM score GROUP BY doc_id
), lot AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {sharding.COPIES} AS lot FROM doc),
place AS ({_hash_sql("SELECT * FROM lot", ["doc_id", "size", "text_crc32", "lot"], "place")})
SELECT p.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY (place + 9223372036854775808) & {_M64}::UHUGEINT, p.doc_id NULLS FIRST, size, text_crc32, lot) - 1 AS slot
FROM place p JOIN best b ON p.doc_id IS NOT DISTINCT FROM b.doc_id
"""


def _assigned_sql(number: int) -> str:
    """Every part with its nearest entry of the codebooks of a round: the least squared distance, then the lower index."""
    return f"""near{number} AS MATERIALIZED (
  SELECT vec_id, label, part, p, min(struct_pack(d := list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))::BIGINT, entry := entry)) AS best
  FROM parts JOIN book{number} USING (part) GROUP BY ALL)"""


def _moved_sql(number: int) -> str:
    return f"""book{number + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{number} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT part, best.entry AS entry, i, sum(p[i])::HUGEINT AS total, count(*) AS n FROM near{number}, unnest(range(1, len(p) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL
  ) m ON m.part = b.part AND m.entry = b.entry)"""


_OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {vectorcodes.SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(v, part * len(v) // {vectorcodes.PARTS} + 1, (part + 1) * len(v) // {vectorcodes.PARTS}) AS p FROM kept, unnest(range({vectorcodes.PARTS})) AS u(part)
), book0 AS MATERIALIZED (
  SELECT part, entry, p AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {vectorcodes.ENTRIES}) USING (vec_id)
), {_assigned_sql(0)}, {_moved_sql(0)}, {_assigned_sql(1)}, {_moved_sql(1)}, {_assigned_sql(2)},
coded AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY ALL)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded
"""

ORACLES: dict[str, str] = {"op1_warc_derivatives": _OP1, "op6_temporal_url_lists": _OP6, "op9_licence_digests": _OP9, "op11_rendezvous_shards": _OP11, "op12_vector_codes": _OP12}

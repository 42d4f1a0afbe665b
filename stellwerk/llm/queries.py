"""Registered queries: thin derivations of each operator's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import (
    bm25_search, curve_search, exact_dedup, filter_audit, jaccard_join, language, merkle, packing, piece_codec, sharding, suffix_index,
    token_files, toxicity,
)
from stellwerk.llm.common import fresh_folder, table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return wrap


@register("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every document's pieces in sequences of 1024 to 8192 words."""
    return packing.pack(packing.with_lengths(table(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.digest(documents, language.fit(documents))


# CRC-32 of a text's bytes, spelled out: DuckDB has no such function.
_CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))
),
crcs AS (
  SELECT text, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table
)"""


@register(
    "op3_virtual_slot_sharding",
    f"""
WITH RECURSIVE {_CRC_SQL},
slotted AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 8))::BIGINT % {sharding.SLOTS} AS virtual_slot
  FROM documents
),
sizes AS (
  SELECT virtual_slot, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS rn
  FROM slotted GROUP BY virtual_slot
),
dealt(rn, loads, shard, virtual_slot) AS (
  SELECT 0::BIGINT, list_transform(range(24), lambda x: 0::BIGINT), -1::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT s.rn, list_transform(d.loads, lambda l, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN l + s.bytes ELSE l END),
    list_position(d.loads, list_min(d.loads)) - 1, s.virtual_slot
  FROM dealt d JOIN sizes s ON s.rn = d.rn + 1
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id, size, crc) - 1 AS slot,
  NULL::INT AS grown_shard, virtual_slot::INT AS virtual_slot, 1::INT AS map_version
FROM slotted JOIN crcs USING (text) JOIN dealt USING (virtual_slot)
""",
)
def virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(documents, 24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version"
    )


@register("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of documents not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    languages = language.fit(documents, rows=None)
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), languages, keep_marked=False)
    return toxicity.digest(documents, model, languages)


@register(
    "op5_jaccard_join",
    """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM docs
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reached(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
""",
)
def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


@register("op6_piece_codec")
def piece_codec_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them."""
    return piece_codec.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_token_files")
def token_file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written token files hold per document."""
    path = fresh_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return token_files.directory(spark, path)


@register(
    "op8_suffix_dedup",
    """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
),
windows AS (SELECT r, n, unnest(range(0, n - 199)) AS i, h FROM docs WHERE n >= 200),
prints AS (SELECT r, i, md5(h[2 * i + 1:2 * i + 400]) AS p FROM windows),
repeated AS (SELECT p FROM prints GROUP BY p HAVING count(*) > 1),
hits AS (SELECT r, i FROM prints SEMI JOIN repeated USING (p)),
runs AS (SELECT r, i, coalesce(i > max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, true) AS new FROM hits),
numbered AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM runs),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, run),
gaps AS (
  SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1),
    lambda k: substr(h, 1 + 2 * coalesce(ends[k], 0), 2 * (coalesce(starts[k + 1], n) - coalesce(ends[k], 0)))), '') END)) AS kept_sha256
FROM docs LEFT JOIN gaps USING (r)
""",
)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without its repeated 200-byte strings."""
    return suffix_index.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


@register("op9_curve_search")
def curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth vector, by inner product."""
    vectors = curve_search.usable(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return curve_search.search(vectors, vectors.where(F.col("id") % 20 == 0), 20)


@register(
    "op10_bm25_search",
    f"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL
),
totals AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM docs),
terms AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * ({bm25_search.K1} + 1)
      / (d.tf + {bm25_search.K1} * (1 - {bm25_search.B} + {bm25_search.B} * d.len / mean))), {bm25_search.PLACES}) AS score
  FROM terms q JOIN terms d ON q.term = d.term AND q.doc_id <> d.doc_id JOIN dfs ON dfs.term = q.term, totals
  WHERE q.doc_id % 100 = 0
  GROUP BY 1, 2
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
""",
)
def bm25_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for the whole text of every hundredth document."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25_search.search(documents, documents.where(F.col("id") % 100 == 0), 10)


@register(
    "op11_exact_dedup",
    """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM documents
),
middle AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS m FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256,
  coalesce(min(doc_id) OVER (PARTITION BY text) <= m, false) AS known
FROM texts, middle
""",
)
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and whether it stays."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    """SQL of a row's leaf: byte count and value of each column."""
    columns = [text if c == "text" else f"{c}::VARCHAR" for c in merkle.LEAF_COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


@register(
    "op12_merkle_manifest",
    f"""
WITH RECURSIVE {_CRC_SQL.replace("coalesce(text, '') AS text FROM documents", "doc_id::VARCHAR AS text FROM documents WHERE doc_id IS NOT NULL")},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered
  FROM documents
),
placed AS (
  SELECT l.doc_id, k, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS shown, row_number() OVER (PARTITION BY k ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS place
  FROM leaves l LEFT JOIN crcs ON crcs.text = l.doc_id::VARCHAR
),
nodes(k, level, place, n, h) AS (
  SELECT k, 0, place, count(*) OVER (PARTITION BY k), leaf FROM placed
  UNION ALL
  SELECT k, any_value(level) + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY k, place // 8
),
tops AS (SELECT k, level, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS place FROM nodes WHERE n = 1),
upper(level, place, n, h) AS (
  SELECT 0, place, count(*) OVER (), subroot FROM tops
  UNION ALL
  SELECT any_value(level) + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY place // 8
),
parts AS (
  SELECT p.k, p.place, s.level, coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place < p.place // (8 ** s.level)::BIGINT), '') AS a,
    coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place > p.place // (8 ** s.level)::BIGINT), '') AS b
  FROM placed p JOIN nodes s ON s.k = p.k AND s.n > 1 AND s.place // 8 = p.place // (8 ** (s.level + 1))::BIGINT
  GROUP BY p.k, p.place, s.level
),
lists AS (SELECT k, place, list(a || '|' || b ORDER BY level) AS segments FROM parts GROUP BY k, place),
upper_parts AS (
  SELECT t.k, s.level, coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place < t.place // (8 ** s.level)::BIGINT), '') AS a,
    coalesce(string_agg(s.h, '' ORDER BY s.place) FILTER (s.place > t.place // (8 ** s.level)::BIGINT), '') AS b
  FROM tops t JOIN upper s ON s.n > 1 AND s.place // 8 = t.place // (8 ** (s.level + 1))::BIGINT
  GROUP BY t.k, s.level
),
upper_lists AS (SELECT k, list(a || '|' || b ORDER BY level) AS segments FROM upper_parts GROUP BY k),
paths AS (
  SELECT doc_id, leaf, shown, subroot, list_concat(coalesce(l.segments, []), coalesce(u.segments, [])) AS segments
  FROM placed p JOIN tops USING (k) LEFT JOIN lists l ON l.k = p.k AND l.place = p.place LEFT JOIN upper_lists u ON u.k = p.k
),
folded AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(replace(array_to_string(segments, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(shown, segments), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
  FROM paths
)
SELECT *, folded_root = root AS verified FROM folded
""",
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and a checked proof of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


@register(
    "op13_filter_audit",
    f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM texts LEFT JOIN marks USING (doc_id)
),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS axes FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
steps AS (SELECT filter_order, step, axes[step] AS own, axes[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
effects AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, coalesce(list_bool_or(list_transform(earlier, lambda i: f[i])), false) AS gone,
    len(list_filter(f, lambda x: x)) AS failed
  FROM steps, cells
),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM effects GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
""",
)
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, at every step of every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

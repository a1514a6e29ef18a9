"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, mixing, packing, quality_fm, ranked_search, sharding, simhash, spelling_variants, suffix_dedup, token_file, topk, url_filter
from .common import table, work_root

# A conversation that holds the template's own control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    out = quality_fm.score(docs, machine)
    return out.select(
        "doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    out = chat_format.format_chats(conv.unionByName(extra))
    out = out.withColumn("read", chat_format.read_turns(F.col("formatted")))
    out = out.withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_root(spark)}/token-file-{uuid.uuid4().hex}"
    token_file.write_ids(table(spark, sf_dir, "documents"), path)
    return token_file.documents(spark, path)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_chat_format": op2_chat_format,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_topk": op8_topk,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_token_file": op11_token_file,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op2_chat_format": r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '(</?s|\[/?INST)\\*[>\]]')) AS role_len,
    length(text) + len(regexp_extract_all(text, '(</?s|\[/?INST)\\*[>\]]')) AS text_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + 13 + CASE WHEN before IS NULL OR before <> role THEN role_len + 9 ELSE 0 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)
""",
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM per
), levels AS (
  SELECT *, (3 * sum(source_size) OVER ()
      - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (2 * sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, least(w * max(level) OVER (), (2 * source_size)::DOUBLE) AS target FROM levels
), rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || md5('mix-1/' || coalesce(doc_id::VARCHAR, '~'))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM rates
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
""",
    # CRC-32 by its byte table; the draws of the tree by list functions
    "op9_sharding": """
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda acc, j: xor(acc >> 1, (acc & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '~') AS k, encode(coalesce(text, '')) AS raw FROM documents
), bytes AS (
  SELECT doc_id, k, octet_length(raw) + 1 AS size,
    list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d
), regions AS (
  SELECT doc_id, k, size, b,
    list_transform([8.0, 8.0, 1.0], lambda w, i:
      -ln((('0x' || md5('tree-1/' || k || '/r.' || (i - 1)::VARCHAR)[1:13])::BIGINT + 1) / 4503599627370496.0::DOUBLE) / w::DOUBLE) AS draws
  FROM bytes
), region AS (
  SELECT *, list_position(draws[1:2], list_min(draws[1:2])) - 1 AS r, list_min(draws) = draws[3] AS moves FROM regions
), racks AS (
  SELECT *, list_transform([0, 1], lambda i:
      -ln((('0x' || md5('tree-1/' || k || '/r.' || r::VARCHAR || '.' || i::VARCHAR)[1:13])::BIGINT + 1) / 4503599627370496.0::DOUBLE) / 4.0::DOUBLE) AS rack_draws
  FROM region
), rack AS (
  SELECT *, list_position(rack_draws, list_min(rack_draws)) - 1 AS j FROM racks
), leaves AS (
  SELECT *, list_transform([0, 1, 2, 3], lambda i:
      -ln((('0x' || md5('tree-1/' || k || '/r.' || r::VARCHAR || '.' || j::VARCHAR || '.' || i::VARCHAR)[1:13])::BIGINT + 1) / 4503599627370496.0::DOUBLE)) AS leaf_draws
  FROM rack
), placed AS (
  SELECT *, (8 * r + 4 * j + list_position(leaf_draws, list_min(leaf_draws)) - 1)::INTEGER AS shard FROM leaves
)
SELECT doc_id, size::BIGINT AS size,
  coalesce(xor(list_reduce(b, lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), 4294967295::BIGINT), 4294967295), 0)::BIGINT AS text_crc32,
  'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id) - 1 AS slot,
  CASE WHEN moves THEN 16 ELSE shard END::INTEGER AS grown_shard
FROM placed, crc
""",
    # every window of 200 bytes as 400 hex digits; spans are islands of their starts
    "op6_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d)
), again AS (
  SELECT s FROM w GROUP BY s HAVING count(*) > 1
), starts AS (
  SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS gap FROM w JOIN again USING (s)
), islands AS (
  SELECT doc_id, i, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM starts
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY doc_id, island
), around AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), found AS (
  SELECT d.doc_id, d.n, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed,
    coalesce(string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a), '')
      || substring(any_value(h), 2 * coalesce(max(b), 0) + 1, 2 * n) AS kept
  FROM d LEFT JOIN around USING (doc_id) GROUP BY d.doc_id, d.n
)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM found
""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), facts AS (
  SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS documents, sum(len(t))::BIGINT AS total FROM d
), hits AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM hits, facts GROUP BY term
), norms AS (
  SELECT r, doc_id, 100 - 50 + ((50 * len(t)::BIGINT * documents) // total) AS m FROM d, facts WHERE len(t) > 0
), scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN hits USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY item_id, doc_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
""",
    # CRC-32 by its byte table; near words share what is left of them without one letter
    "op13_spelling_variants": """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda acc, j: xor(acc >> 1, (acc & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), per AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), bytes AS (
  SELECT run, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM per
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), cut AS (
  SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM pairs
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.k = 1
), chain AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.at FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e USING (word)
""",
}

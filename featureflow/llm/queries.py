"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, conversations, decontamination, language, multi_length, packing, pii, quality, secrets, simhash, token_files, toxicity, warc

#: Vocabulary file of the token queries (a parameter of the operators).
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(joined(of(*secrets.BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: Documents scored at this or over are taken for toxic.
TOXIC_AT = 0.3


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, index).select(
        "doc_id", "held_out", "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "evidence")


#: Key of the surrogates; a deployment passes its own secret.
PII_KEY = "surrogates"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = pii.with_surrogates(docs, PII_KEY)
    counts = [F.size(F.filter("_pii_kinds", lambda k: k == F.lit(t))).cast("long").alias(f"n_{t}") for t in pii.TYPES]
    return done.select("doc_id", "text", *counts)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, capacity=2048)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.key = bw.key),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "token-files")
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=2)
    return token_files.read_token_files(spark, files)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least=1000)


OP10_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
), r AS (
  SELECT p.*, largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again, largest
  FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN largest END AS refers_to
FROM r
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, scale=2_000_000, share=80, top=2000)


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, g, count(*) AS f
  FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY lang, g HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r,
    CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k)
  JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), cover AS (
  SELECT lang, g, max(f) AS f
  FROM (SELECT lang, f, unnest(list_transform(range(1, len(g) - n + 2), lambda i: list_slice(g, i, i + n - 1))) AS g
        FROM f, (SELECT unnest([2, 3]) AS n) WHERE len(g) > n)
  GROUP BY lang, g
), kept AS (
  SELECT low.* FROM low LEFT JOIN cover USING (lang, g)
  WHERE cover.f IS NULL OR 100::HUGEINT * cover.f < 80::HUGEINT * low.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, repaired = conversations.repair(table(spark, sf_dir, "conversations"))
    return found.join(conversations.digests(repaired), "key", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Damage, faults and edits stated plainly: the least (cost, audit) by state, row
#: after row; insertions before a row and at the end are listed by state.
OP12_SQL = """
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM src WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    left(role, 1) AS c, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS mark
  FROM damaged
), rows AS (
  SELECT *, CASE WHEN mark = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id
), inserted(p, r, lines) AS (
  VALUES (0, 0, []::VARCHAR[]), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']), (1, 1, []), (1, 2, ['user:']),
    (1, 3, ['user:', 'assistant:']), (2, 2, []), (2, 3, ['assistant:']), (3, 3, []), (3, 2, ['user:'])
), moves(r, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT conv_id, i, r, q, 'K' AS edit, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cost, [role || ':' || text] AS lines
  FROM rows JOIN moves USING (c) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, r, q, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, [CASE m.c WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM rows, (SELECT * FROM moves WHERE c <> 's') m WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, r, r, 'D', 4, []::VARCHAR[] FROM rows, (SELECT unnest([0, 1, 2, 3]) AS r)
), best(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM counted
  UNION ALL
  SELECT * FROM (
    SELECT b.conv_id, e.i, e.q, b.cost + 3 * len(s.lines) + e.cost AS cost, b.audit || repeat('I', len(s.lines)) || e.edit AS audit,
      list_concat(list_concat(b.lines, s.lines), e.lines)
    FROM best b JOIN inserted s ON s.p = b.state
    JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.r = s.r
    QUALIFY row_number() OVER (PARTITION BY b.conv_id, e.q ORDER BY b.cost + 3 * len(s.lines) + e.cost,
      b.audit || repeat('I', len(s.lines)) || e.edit) = 1)
), done AS (
  SELECT b.conv_id, b.cost + 3 * len(s.lines) AS cost, b.audit || repeat('I', len(s.lines)) AS audit, list_concat(b.lines, s.lines) AS lines
  FROM best b JOIN counted n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.n = b.i JOIN inserted s ON s.p = b.state
  WHERE s.r IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 3 * len(s.lines), b.audit || repeat('I', len(s.lines))) = 1
)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
  coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(d.cost, 0) AS cost, coalesce(d.audit, '') AS audit,
  sha256(coalesce(array_to_string(d.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_length.pack_multi_length(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, sizes=(1024, 512, 256, 128))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_quality_rules, op3_toxicity, op4_pii_surrogates, op5_best_fit_packing, op6_simhash_near_dedup, op7_decontamination, op8_token_files,
    op9_language_id, op10_warc, op11_phrase_collocations, op12_conversation_repair, op13_multi_length_packing)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op7_decontamination": OP7_SQL, "op10_warc": OP10_SQL,
                           "op11_phrase_collocations": OP11_SQL, "op12_conversation_repair": OP12_SQL}

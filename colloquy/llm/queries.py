"""The registered queries of this subpackage: thin readers of tables around the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import classlm, conversations, packing, personal, pieces, quality, resample, sharding, simhash, toxicity, urls, warc, winnowing

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the isolation forest's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit_forest(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, forest).drop("text")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL["op3_url_filters"] = """
WITH parsed AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages
), cut AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS rest FROM parsed
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM named n LEFT JOIN fit f USING (page_id)
"""


@query
def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards whose counts differ by one at most."""
    out = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return winnowing.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say about each."""
    back = warc.archived(table(spark, sf_dir, "pages"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_warc"] = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), first AS (
  SELECT html, max(page_id) AS first FROM sized WHERE n >= 1000 GROUP BY html
)
SELECT page_id, n AS payload_bytes, sha1(sized.html) AS payload_digest,
       CASE WHEN first.first IS NULL OR first.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first.first <> page_id THEN first.first END AS refers_to
FROM sized LEFT JOIN first ON sized.html = first.html AND n >= 1000
"""


@query
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by word counts and by the class model, learnt from the rows of four folds in five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (toxicity.fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    model, counts = classlm.fit(docs.where("not held_out"))
    scored = classlm.score(docs, model, counts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


@query
def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, decoded again."""
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planted faults."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


#: CRC-32 of a list of bytes, and its table of 256 remainders.
CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"
CRC_OF = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"

SQL["op11_conversation_repair"] = f"""
WITH RECURSIVE crc AS (SELECT t FROM {CRC_TABLE}), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS key
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, {CRC_OF.format(bytes="key")} % 20 AS kind FROM hashed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER w AS i,
         lead(role[1]) OVER w AS next_letter, lead(1) OVER w AS more, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (more = 1 AND role[1] || next_letter NOT IN ('su', 'ua', 'au')) AS illegal,
         list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END ORDER BY i) AS letters,
         list(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END ORDER BY i) AS cuts, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM judged GROUP BY conv_id
), inserts(q, p, cost, audit) AS (
  VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 5, 'I'), ('s', 'u', 5, 'I'), ('u', 'a', 5, 'I'), ('a', 'u', 5, 'I'), ('', 'a', 10, 'II'), ('s', 'a', 10, 'II')
), edits(p, letter, q, cost, audit) AS (
  SELECT p, letter, p, 2, 'D' FROM (VALUES (''), ('s'), ('u'), ('a')) a(p), (VALUES ('x'), ('s'), ('u'), ('a'), ('o')) b(letter)
  UNION ALL SELECT p, letter, CASE WHEN p = 'u' THEN 'a' ELSE 'u' END, 1, 'R' FROM (VALUES (''), ('s'), ('u'), ('a')) a(p), (VALUES ('s'), ('u'), ('a'), ('o')) b(letter)
  UNION ALL VALUES ('', 's', 's', 0, 'K'), ('', 'u', 'u', 0, 'K'), ('s', 'u', 'u', 0, 'K'), ('u', 'a', 'a', 0, 'K'), ('a', 'u', 'u', 0, 'K')
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q, min({{'cost': w.best.cost + s.cost + e.cost + CASE WHEN e.audit = 'D' THEN 0 ELSE c.cuts[w.i + 1] END, 'audit': w.best.audit || s.audit || e.audit}})
  FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i < c.n JOIN inserts s ON s.q = w.q JOIN edits e ON e.p = s.p AND e.letter = c.letters[w.i + 1]
  GROUP BY w.conv_id, w.i, e.q
), solved AS (
  SELECT c.conv_id, min({{'cost': w.best.cost + CASE q WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, 'audit': w.best.audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END}}) AS best
  FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n GROUP BY c.conv_id
), letters AS (
  SELECT conv_id, generate_subscripts(string_split(best.audit, ''), 1) AS k, unnest(string_split(best.audit, '')) AS e FROM solved WHERE best.audit <> ''
), read AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS stays FROM letters
), kept AS (
  SELECT l.conv_id, k, CASE WHEN stays = 1 AND e = 'K' AND c.letters[pos] = 's' THEN 1 END AS system, stays, CASE WHEN e = 'K' THEN c.roles[pos] END AS role, CASE WHEN e = 'I' THEN '' ELSE c.texts[pos] END AS text
  FROM read l JOIN counted c ON l.conv_id IS NOT DISTINCT FROM c.conv_id WHERE e <> 'D'
), named AS (
  SELECT *, coalesce(role, CASE WHEN (stays - coalesce(max(system) OVER (PARTITION BY conv_id), 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS name FROM kept
), joined AS (
  SELECT conv_id, string_agg(name || ':' || text, chr(10) ORDER BY k) AS whole FROM named GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN joined j ON o.conv_id IS NOT DISTINCT FROM j.conv_id
"""


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the distribution of the benchmark."""
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _features_sql(table: str, key: str) -> str:
    """Words and pairs of words of every row, by row."""
    return f"""SELECT row, unnest(words || pairs) AS feature FROM (
      SELECT row, words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs FROM (
        SELECT row, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
        FROM (SELECT row_number() OVER (ORDER BY {key}, text) AS row, text FROM {table}))) WHERE len(words) > 0"""


SQL["op12_resampling"] = f"""
WITH crc AS (SELECT t FROM {CRC_TABLE}), own AS ({_features_sql("documents", "doc_id")}), other AS ({_features_sql("benchmark", "item_id")}
), vocabulary AS (
  SELECT feature, list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT feature FROM own UNION SELECT feature FROM other)
), placed AS (
  SELECT feature, {CRC_OF.format(bytes="bytes")} % 10000 AS bucket FROM vocabulary, crc
), mine AS (
  SELECT row, bucket, count(*) AS n FROM own JOIN placed USING (feature) GROUP BY row, bucket
), corpus AS (SELECT bucket, sum(n) AS s FROM mine GROUP BY bucket
), target AS (SELECT bucket, count(*) AS t FROM other JOIN placed USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM corpus) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket)
), weighed AS (
  SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM mine JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT row_number() OVER (ORDER BY doc_id, text) AS row, doc_id FROM documents) LEFT JOIN weighed USING (row)
), ordered AS (
  SELECT *, CASE WHEN n_features >= 39 THEN row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id NULLS FIRST) END AS place, count(*) FILTER (n_features >= 39) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM ordered
"""


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans with those of the field."""
    found = personal.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter(F.split("base_spans", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in personal.KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")

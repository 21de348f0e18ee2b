"""The queries of the ``llm`` operators: one for each, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import best_fit, decontamination, html_extract, license_scan, media, merkle, packing, simhash, suffix_dedup, token_counts, toxicity, url_filter, whitening
from docloom.llm.bpe import default_tokenizer
from docloom.plans.query import read

#: Host and path rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Arrow batches of few rows keep Python workers small when texts are long.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return read(spark, sf_dir, name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), 1024)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, default_tokenizer())
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 as over_limit")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = license_scan.train(license_scan.training_paragraphs(docs))
    return license_scan.scan_licenses(docs, model)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep_text=False, report=suffix_dedup.PASSAGE)
    passages = [F.size("reported").cast("long").alias("n_passages"), F.expr("aggregate(reported, 0L, (n, r) -> n + r.stop - r.start)").alias("passage_bytes")]
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *passages)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), F.translate("text", "\n", ""), tampered)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(table(spark, sf_dir, "documents"), default_tokenizer(), 1024, 2)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 16)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_html_extraction, op2_decontamination, op3_packing, op4_token_counts, op5_toxicity, op6_license_scan, op7_media_columns, op8_url_filter, op9_simhash_near_dedup, op10_suffix_array_dedup, op11_merkle_manifest, op12_best_fit_packing, op13_embedding_whitening,
    )
    return {q.__name__: q for q in own}


#: Windows of item words in documents by joins of joined words.
DECONTAMINATION_SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, size, array_to_string(w[k:k + size - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM sized)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spot AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS said FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT doc_id, k, spot.size, item_id FROM spot JOIN win ON spot.said = win.said AND spot.size = win.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Both trees level by level, each document's way through them as (step, left, right), and the fold a step at a time. An unsigned CRC-32 is even if the register's last bit is one.
MERKLE_SQL = f"""WITH RECURSIVE crc AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 2 = 1 AS even FROM documents),
doc AS (SELECT *, CASE WHEN even THEN changed ELSE leaf END AS start, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n, row_number() OVER () AS r
  FROM (SELECT doc_id, coalesce('=' || source, '') AS key, even, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS changed FROM crc)),
node AS (SELECT 0 AS level, key, idx, n, leaf AS digest FROM doc UNION ALL SELECT level + 1, key, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY level, key, idx // 3, n),
sub AS (SELECT key, level AS height, digest, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, digest FROM sub UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 3, n),
root AS (SELECT level AS height, digest FROM top WHERE n = 1),
run AS (SELECT level, key, idx // 3 AS run, list(digest ORDER BY idx) AS c FROM node GROUP BY ALL), toprun AS (SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS c FROM top GROUP BY ALL),
low AS (SELECT r, doc.key, height, unnest(range(height)) AS level, doc.idx FROM doc JOIN sub USING (key)), high AS (SELECT r, sub.height, unnest(range(root.height)) AS level, sub.idx FROM doc JOIN sub USING (key), root),
way AS (SELECT r, low.level AS step, c, CAST(low.idx // CAST(pow(3, low.level) AS BIGINT) % 3 AS INT) AS p FROM low JOIN run ON run.level = low.level AND run.key = low.key AND run.run = low.idx // CAST(pow(3, low.level + 1) AS BIGINT)
  UNION ALL SELECT r, high.height + high.level, c, CAST(high.idx // CAST(pow(3, high.level) AS BIGINT) % 3 AS INT) FROM high JOIN toprun ON toprun.level = high.level AND toprun.run = high.idx // CAST(pow(3, high.level + 1) AS BIGINT)),
path AS (SELECT r, step, array_to_string(c[1:p], '') AS l, array_to_string(c[p + 2:], '') AS g FROM way),
fold AS (SELECT r, 0 AS step, start AS acc FROM doc UNION ALL SELECT fold.r, fold.step + 1, sha256(l || acc || g) FROM fold JOIN path ON path.r = fold.r AND path.step = fold.step),
folded AS (SELECT r, arg_max(acc, step) AS folded_root FROM fold GROUP BY 1), proof AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY 1)
SELECT doc_id, leaf, sub.digest AS subroot, root.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.digest AS verified FROM doc JOIN sub USING (key) JOIN folded USING (r) LEFT JOIN proof USING (r), root"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION_SQL, "op11_merkle_manifest": MERKLE_SQL}

"""Queries of the retrieval operators: benchmark items as questions, documents as the corpus, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.fixed_values import PROGRAM_KEYWORDS, UNIVERSITY_NAMES
from docloom.functions import stemming
from docloom.operators import retrieval, vector_index
from docloom.plans.query import Query, read


def _micro(c: str) -> Column:
    return F.round(F.col(c) * 1_000_000).cast("long").alias("score_e6")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


COSINE = "list_sum(list_transform(list_zip({0}, {1}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


def _cosine(a: str, b: str) -> str:
    return f"({COSINE.format(a, b)} / (sqrt({COSINE.format(a, a)}) * sqrt({COSINE.format(b, b)})))"


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Searches: the vectors whose id 50 divides, against all."""
    asked = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    return retrieval.dense_top_k(asked, _vectors(spark, d), 10, 0.15).select("qid", "chunk_id", "rank", _micro("score"))


DENSE = f"""SELECT qid, chunk_id, CAST(rank AS INT) AS rank, CAST(round(score * 1000000) AS BIGINT) AS score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM
(SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round({_cosine("q.embedding", "v.embedding")}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 10 AND score >= 0.15"""


def dense_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    return retrieval.dense_top_k(asked, _vectors(spark, d), 5, 0.25, "l2_exp").select("qid", "chunk_id", "rank", _micro("score"))


DENSE_L2 = f"""SELECT qid, chunk_id, CAST(rank AS INT) AS rank, CAST(round(score * 1000000) AS BIGINT) AS score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM
(SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(exp(-({COSINE.format("q.embedding", "q.embedding")} + {COSINE.format("v.embedding", "v.embedding")} - 2 * {COSINE.format("q.embedding", "v.embedding")})), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 5 AND score >= 0.25"""

TERMS = r"list_filter(string_split_regex(lower({0}), '[^\pL\pN]+'), lambda w: w <> '')"

BM25_CTE = f"""asked AS (SELECT DISTINCT item_id AS qid, unnest({TERMS.format("text")}) AS term FROM benchmark), listed AS (SELECT doc_id AS chunk_id, {TERMS.format("text")} AS w FROM documents),
size AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM listed), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM listed) GROUP BY ALL),
hit AS (SELECT * FROM tf WHERE term IN (SELECT term FROM asked)), idf AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM hit, size GROUP BY term, docs),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN hit USING (term) JOIN idf USING (term), size GROUP BY ALL))"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_questions(spark, d), _corpus(spark, d), 10).select("qid", "chunk_id", "rank", _micro("score"))


BM25 = f"WITH {BM25_CTE} SELECT qid, chunk_id, CAST(rank AS INT) AS rank, CAST(round(score * 1000000) AS BIGINT) AS score_e6 FROM sparse WHERE rank <= 10"


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """English stems without stop words. Rows only here: tests hold it against a plain stemmer and plain sums."""
    return retrieval.bm25(_questions(spark, d), _corpus(spark, d), 10, split=retrieval.english_terms, stem=stemming.stem).select("qid", "chunk_id", "rank", _micro("score"))


def _hybrid_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, d)
    asked = _questions(spark, d).join(vectors.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector")), "qid", "left")
    return asked, vectors


DENSE_CTE = f"""dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM
(SELECT item_id AS qid, v.vec_id AS chunk_id, round({_cosine("q.embedding", "v.embedding")}, 6) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v)),
both_ AS (SELECT qid, chunk_id, score, rank, 0 AS source FROM dense WHERE rank <= 10 AND score >= 0.15 UNION ALL SELECT qid, chunk_id, score, rank, 1 FROM sparse WHERE rank <= 10),
blend AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source, rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY source) AS n FROM both_) WHERE n = 1)"""


def blend_union(spark: SparkSession, d: str) -> DataFrame:
    asked, vectors = _hybrid_parts(spark, d)
    dense = retrieval.dense_top_k(asked.where("query_vector is not null").select("qid", "query_vector"), vectors, 10, 0.15)
    return retrieval.blend(dense, retrieval.bm25(asked.select("qid", "query"), _corpus(spark, d), 10)).select("qid", "chunk_id", "source", "position", _micro("score"))


BLEND = f"WITH {BM25_CTE}, {DENSE_CTE} SELECT qid, chunk_id, source, CAST(position AS INT) AS position, CAST(round(score * 1000000) AS BIGINT) AS score_e6 FROM blend"


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    asked, vectors = _hybrid_parts(spark, d)
    found = retrieval.hybrid_search(asked, _corpus(spark, d), vectors)
    return found.select("qid", "rank", "chunk_id", "source", F.col("total_retrieved"), _micro("score"), F.md5("text").alias("text_md5"))


LEXICAL = f"len(list_intersect(list_distinct({TERMS.format('{0}')}), list_distinct({TERMS.format('{1}')}))) / len(list_distinct({TERMS.format('{0}')}))"
HYBRID = f"""WITH {BM25_CTE}, {DENSE_CTE}, said AS (SELECT b.qid, b.chunk_id, b.source, b.position, d.text, {LEXICAL.format("q.text", "d.text")} AS score, c.n FROM blend b JOIN documents d ON d.doc_id = b.chunk_id JOIN benchmark q ON q.item_id = b.qid
JOIN (SELECT qid, count(*) AS n FROM blend GROUP BY 1) c ON c.qid = b.qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rank FROM said)
SELECT qid, CAST(rank AS INT) AS rank, chunk_id, source, n AS total_retrieved, CAST(round(score * 1000000) AS BIGINT) AS score_e6, md5(text) AS text_md5 FROM r WHERE (score >= 0.1 OR rank = 1) AND rank <= 3"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 candidates of all questions with their documents."""
    found = retrieval.bm25(_questions(spark, d), _corpus(spark, d), 10)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
    return found.join(docs, "chunk_id").join(_questions(spark, d), "qid")


CANDIDATES = f"{BM25_CTE}, cand AS (SELECT s.qid, s.chunk_id, s.rank, s.score, d.text, d.lang, d.source, b.text AS query FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id JOIN benchmark b ON b.item_id = s.qid WHERE s.rank <= 10)"


def rerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.rerank(_candidates(spark, d).withColumnRenamed("rank", "position"), 0.5)
    return found.select("qid", "chunk_id", "rank", _micro("score"))


RERANK = f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY new DESC, rank) AS place FROM (SELECT *, {LEXICAL.format("query", "text")} AS new FROM cand))
SELECT qid, chunk_id, CAST(place AS INT) AS rank, CAST(round(new * 1000000) AS BIGINT) AS score_e6 FROM r WHERE new >= 0.5 OR place = 1"""


def fallback_order(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.fallback_order(retrieval.bm25(_questions(spark, d), _corpus(spark, d), 10))
    return found.select("qid", "chunk_id", "rank", _micro("score"))


FALLBACK = f"""WITH {BM25_CTE}, r AS (SELECT qid, chunk_id, score, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM sparse WHERE rank <= 10), s AS (SELECT qid, chunk_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS score FROM r)
SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INT) AS rank, CAST(round(score * 1000000) AS BIGINT) AS score_e6 FROM s"""


def delivery_filter(spark: SparkSession, d: str) -> DataFrame:
    """Both ways of study stand for words of the driver's data."""
    found = retrieval.delivery_filter(_candidates(spark, d), title="text", remote="der ", regular="the ")
    return found.select("qid", "chunk_id")


DELIVERY = f"""WITH {CANDIDATES}, h AS (SELECT *, contains(lower(text), 'der ') AS hit, sum(CAST(contains(lower(text), 'der ') AS INT)) OVER (PARTITION BY qid) AS hits FROM cand)
SELECT qid, chunk_id FROM h WHERE CASE WHEN contains(lower(query), 'der ') AND hits > 0 THEN hit WHEN contains(lower(query), 'the ') THEN NOT hit ELSE true END"""


def program_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("qid", "chunk_id", F.concat_ws("-", "lang", "source").alias("document_id"), F.when(F.col("qid") % 3 == 0, "de-").when(F.col("qid") % 3 == 1, "src3").alias("program"))
    return retrieval.program_filter(rows).select("qid", "chunk_id", "document_id")


PROGRAM_FILTER = f"""WITH {CANDIDATES}, h AS (SELECT qid, chunk_id, lang || '-' || source AS document_id, coalesce(contains(lang || '-' || source, CASE qid % 3 WHEN 0 THEN 'de-' WHEN 1 THEN 'src3' END), false) AS hit FROM cand)
SELECT qid, chunk_id, document_id FROM (SELECT *, bool_or(hit) OVER (PARTITION BY qid) AS any_hit FROM h) WHERE hit OR NOT any_hit"""


def dedup_max_score(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return retrieval.dedup_max(rows)


DEDUP = "SELECT chunk_id, score, seq, first_seq FROM (SELECT user_id AS chunk_id, value AS score, event_id AS seq, min(event_id) OVER (PARTITION BY user_id) AS first_seq, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1"

ASKED = [
    ("điều kiện TN ngành Khoa học máy tính", "khoa-hoc-may-tinh"), ("CTDT KHMT năm 2022", "khoa-hoc-may-tinh"), ("số tín chỉ ngành Hệ thống thông tin trường Đại học Công nghệ Thông tin", "he-thong-thong-tin"), ("học phí năm 2024", None),
    ("có hai học kỳ", "tri-tue-nhan-tao"),
]


def program_detect(spark: SparkSession, d: str) -> DataFrame:
    """Fixture questions and all benchmark items."""
    asked = spark.createDataFrame([(q,) for q, _ in ASKED], "query string").unionAll(read(spark, d, "benchmark").select("text"))
    return asked.select("query", retrieval.detect_program(F.col("query")).alias("program"))


def _detect_sql() -> str:
    low = "lower(query)"
    for name in UNIVERSITY_NAMES:
        low = f"replace({low}, '{name}', ' ')"
    ordered = [(s, w) for s, ws in PROGRAM_KEYWORDS.items() for w in ws]
    values = ", ".join(f"({k}, '{s}', '{w}', {len(w)})" for k, (s, w) in enumerate(ordered))
    asked = ", ".join(f"('{q}')" for q, _ in ASKED)
    return f"""WITH a AS (SELECT row_number() OVER () AS r, query, {low} AS low FROM (SELECT * FROM (VALUES {asked}) t(query) UNION ALL SELECT text FROM benchmark)), k AS (SELECT * FROM (VALUES {values}) t(k, slug, word, size)),
f AS (SELECT r, slug, row_number() OVER (PARTITION BY r ORDER BY instr(low, word), -size, k) AS n FROM a, k WHERE instr(low, word) > 0) SELECT query, f.slug AS program FROM a LEFT JOIN f ON f.r = a.r AND n = 1"""


def retrieve_structured(spark: SparkSession, d: str) -> DataFrame:
    """The result documents of all questions, one row for each; nested rows as JSON."""
    rows = _candidates(spark, d).select(
        "qid", "rank", "text", F.col("source").alias("title"), F.lit(None).cast("string").alias("regulation_number"), F.col("lang").alias("hierarchy"), F.lit(None).cast("string").alias("effective_date"), F.lit(None).cast("string").alias("document_type"),
        F.lit(2024).alias("year"), F.lit(None).cast("string").alias("pdf_file"), F.col("score"),
    )
    shaped = retrieval.format_regulations(rows.where("rank <= 3"), "first_dashes").withColumn("content", F.md5("content")).drop("score")
    nested = retrieval.nest_results(shaped, _questions(spark, d))
    return nested.select("qid", "total_retrieved", F.md5(F.array_join(F.transform("documents", lambda x: F.concat_ws(",", x["rank"].cast("string"), x["content"], x["title"], x["hierarchy"], x["document_type"], x["year"].cast("string"))), ";")).alias("documents_md5"))


STRUCTURED = rf"""WITH {CANDIDATES}, f AS (SELECT qid, rank, concat_ws(',', rank, md5(CASE WHEN instr(text, '---') > 0 THEN regexp_replace(text[instr(text, '---') + 3:], '^\s+|\s+$', '', 'g') ELSE text END), source, lang, 'original', '2024') AS x FROM cand WHERE rank <= 3)
SELECT item_id AS qid, CAST(count(f.qid) AS INT) AS total_retrieved, md5(string_agg(x, ';' ORDER BY rank)) AS documents_md5 FROM benchmark LEFT JOIN f ON f.qid = item_id GROUP BY 1"""


def raw_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).withColumn("file_name", F.when(F.col("chunk_id") % 2 == 0, F.col("source")))
    return retrieval.raw_context(rows).select("qid", F.md5("context").alias("context_md5"))


CONTEXT = f"""WITH {CANDIDATES} SELECT qid, md5(string_agg('[Nguồn ' || rank || ': ' || CASE WHEN chunk_id % 2 = 0 THEN source ELSE 'Unknown' END || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM cand GROUP BY qid"""


def distilled_context(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model's summary: the sentences that share a term with the question."""
    return retrieval.distil(_candidates(spark, d).withColumn("file_name", F.col("source"))).select("qid", "distilled", F.length("context").alias("n_chars"))


DISTILLED = rf"""WITH {CANDIDATES}, raw AS (SELECT qid, count(*) AS n, string_agg('[Nguồn ' || rank || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM cand GROUP BY 1),
s AS (SELECT qid, rank, array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: list_has_any({TERMS.format("x")}, {TERMS.format("query")})), ' ') AS said FROM cand),
short AS (SELECT qid, coalesce(string_agg(said, chr(10) ORDER BY rank) FILTER (said <> ''), '') AS short FROM s GROUP BY 1),
g AS (SELECT qid, context, short, n >= 3 AND length(short) > 0 AND length(short) <= 0.9 * length(context) AS good FROM raw JOIN short USING (qid))
SELECT qid, good AS distilled, CAST(length(CASE WHEN good THEN short ELSE context END) AS INT) AS n_chars FROM g"""


def embedding_index(spark: SparkSession, d: str) -> DataFrame:
    """Hashed term vectors in millionths, and the cost of embedding, by document."""
    found = retrieval.hashing_embeddings(read(spark, d, "documents"), "doc_id", "text", 16)
    listed = F.array_join(F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return found.select("doc_id", listed.alias("embedding_e6"), retrieval.embedding_cost(F.lit(1)).alias("cost"))


EMBEDDING = f"""WITH w AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents), c AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 16 AS bucket, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1), e AS (SELECT d.doc_id, b.k, CASE WHEN norm > 0 THEN coalesce(n, 0) / norm ELSE 0 END AS x FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS k) b LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id AND c.bucket = b.k)
SELECT doc_id, string_agg(CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS embedding_e6, 200 / CAST(1000000 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS cost FROM e GROUP BY 1"""


def vector_index_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What the searches of dense_topk cost: pairs scored by the index, of all there are. Rows only: it depends on the cells."""
    vectors = _vectors(spark, d)
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector"))
    index = vector_index.build_index(vectors)
    return vector_index.search(index, asked, 10, 0.15)[1].withColumn("all_pairs", F.lit(int(index.counts.sum())))


def corpus_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_corpus(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


TERM_COUNTS = f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY 1"

QUERIES = {
    "hybrid_search": Query(hybrid_search, HYBRID),
    "dense_topk": Query(dense_topk, DENSE),
    "dense_topk_l2": Query(dense_topk_l2, DENSE_L2),
    "bm25_topk": Query(bm25_topk, BM25),
    "bm25_stemmed": Query(bm25_stemmed),
    "blend_union": Query(blend_union, BLEND),
    "rerank_threshold": Query(rerank_threshold, RERANK),
    "fallback_order": Query(fallback_order, FALLBACK),
    "delivery_filter": Query(delivery_filter, DELIVERY),
    "program_filter": Query(program_filter, PROGRAM_FILTER),
    "program_detect": Query(program_detect, _detect_sql()),
    "dedup_max_score": Query(dedup_max_score, DEDUP),
    "retrieve_structured": Query(retrieve_structured, STRUCTURED),
    "raw_context": Query(raw_context, CONTEXT),
    "distilled_context": Query(distilled_context, DISTILLED),
    "embedding_index": Query(embedding_index, EMBEDDING),
    "vector_index_pairs": Query(vector_index_pairs),
    "corpus_terms": Query(corpus_terms, TERM_COUNTS),
}

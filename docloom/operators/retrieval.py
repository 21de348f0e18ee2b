"""Retrieval: dense and BM25 top-k, blending, filters, reranking, formatting.

Queries come in tables too (``qid`` and its text or vector), so a batch of queries is one job. Models outside Spark
have plug-in points with offline stand-ins that are named as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed_values import ENGLISH_STOP, PROGRAM_KEYWORDS, UNIVERSITY_NAMES
from docloom.functions.text import let, strip_metadata
from docloom.operators import vector_index
from docloom.plans.stored import sized, stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """``cosine``, or ``l2_exp``: exp of the negative squared distance."""
    if metric == "cosine":
        return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if metric == "l2_exp":
        return F.exp(-(dot(a, a) + dot(b, b) - 2 * dot(a, b)))
    raise ValueError(f"unknown metric {metric}")


def top_k(scored: DataFrame, k: int, group: str = "qid", score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The k best rows of each query, ranked; equal scores go by key."""
    own = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, min_score: float = 0.15, metric: str = "cosine") -> DataFrame:
    """(qid, chunk_id, score, rank) from queries (qid, query_vector) and vectors (chunk_id, embedding), by an index built for this call.

    The rows are those of scoring every query against every vector, with scores rounded to six places; see :mod:`vector_index`, whose index can be
    kept for further searches. Rows under ``min_score`` go after the ranks are given.
    """
    return vector_index.search(vector_index.build_index(vectors, metric), queries, k, min_score)[0]


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(corpus: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl): how often a chunk has a term, and its length. Counts are partly summed before the shuffle."""
    listed = corpus.select(key, terms(F.col(text)).alias("w"))
    return listed.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def english_terms(text: Column) -> Column:
    """Terms of two characters or more that are no stop words."""
    return F.filter(terms(text), lambda w: (F.length(w) > 1) & ~w.isin(ENGLISH_STOP))


#: Rows that a task of :func:`bm25` sums, on average.
TASK_ROWS = 1 << 20


def _dealt(rows: DataFrame, size: int | None, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to a task for each TASK_ROWS of ``size``, or to all cores. With the number named, Spark doesn't put tasks together by the bytes read, which say little of what is summed."""
    return rows.repartition(max(-(-(size or 0) // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), F.col(key))


def bm25(
    queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, key: str = "chunk_id", text: str = "text", split: Callable[[Column], Column] = terms, stem: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(qid, chunk_id, score, rank) from queries (qid, query) and a corpus; ``split`` makes words of both, and ``stem`` terms of words.

    Stems are made of the corpus's distinct words, once each. Only words that some query asks for are counted by chunk, and a chunk's scores are summed where its
    words are; what is shuffled for the ranks is the best k of each task. Both steps are dealt by chunk into as many tasks as their rows ask for, so a
    task holds no more of a larger corpus. Statistics cover the whole corpus. Scores are rounded to six places, so that equal texts rank by key however
    their terms were summed.
    """
    termed = stem or (lambda w: w)
    asked = queries.select("qid", F.explode(split(F.col("query"))).alias("word")).distinct().select("qid", termed(F.col("word")).alias("term")).distinct()
    listed = corpus.select(key, split(F.col(text)).alias("w"))
    size = listed.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("avgdl"), F.sum(F.size("w")).alias("words")).first()
    wanted = asked.select("term").distinct()
    if stem:
        vocabulary = stored(listed.select(F.explode("w").alias("word")).distinct().select("word", stem(F.col("word")).alias("term")), "vocabulary")
        words = stored(vocabulary.join(sized(wanted), "term", "left_semi"), "wanted-words")
    else:
        words = wanted.select(F.col("term").alias("word"), "term")
    exploded = listed.select(key, F.size("w").alias("dl"), F.explode("w").alias("word")).join(sized(words), "word").select(key, "dl", "term")
    found = stored(_dealt(exploded, size["words"], key).groupBy(key, "dl", "term").agg(F.count("*").alias("tf")), "found")
    often = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = often.select("term", "df", F.log(1 + (F.lit(size["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(size["avgdl"]).cast("double")))
    scores = stored(asked.join(weighed, "term"), "asked")
    most = scores.agg(F.sum("df").alias("terms"), F.count_distinct("qid").alias("queries")).first()  # a chunk has one score a query, at most one a term
    scored = _dealt(found, min(most["terms"] or 0, most["queries"] * size["docs"]), key).join(sized(scores.drop("df")), "term").groupBy("qid", F.col(key).alias("chunk_id")).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scored, k)


def blend(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Dense rows in order, then sparse rows whose chunk is new; ``position`` from 1 within a query."""
    both = dense.select("qid", "chunk_id", "score", "rank", F.lit(0).alias("source")).unionByName(sparse.select("qid", "chunk_id", "score", "rank", F.lit(1).alias("source")))
    first = Window.partitionBy("qid", "chunk_id").orderBy("source")
    kept = both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("source", "rank")))


def dedup_max(rows: DataFrame, key: str = "chunk_id", score: str = "score", order: str = "seq") -> DataFrame:
    """The best row of each key, the first of equals, in order of first occurrence (``first_seq``)."""
    own = Window.partitionBy(key)
    best = rows.withColumn("first_seq", F.min(order).over(own)).withColumn("n", F.row_number().over(own.orderBy(F.desc(score), F.asc(order))))
    return best.where("n = 1").drop("n")


def delivery_filter(rows: DataFrame, query: str = "query", title: str = "title", group: str = "qid", remote: str = "từ xa", regular: str = "chính quy") -> DataFrame:
    """Rows by the way of study that the query names: remote ones only, if any; or without remote ones."""
    is_remote = F.contains(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit(remote))
    low = F.lower(F.col(query))
    counted = rows.withColumn("__hit", is_remote).withColumn("__hits", F.sum(is_remote.cast("int")).over(Window.partitionBy(group)))
    asks_remote = F.contains(low, F.lit(remote)) & (F.col("__hits") > 0)
    return counted.where(F.when(asks_remote, F.col("__hit")).when(F.contains(low, F.lit(regular)), ~F.col("__hit")).otherwise(True)).drop("__hit", "__hits")


def lexical_score(query: Column, text: Column) -> Column:
    """Offline stand-in for a reranking model: share of the query's terms that the text has, 0 to 1."""
    return let(F.array_distinct(terms(query)), lambda asked: F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(text))) / F.size(asked)).otherwise(0.0))


def rerank(rows: DataFrame, threshold: float = 0.1, scorer: Callable[[Column, Column], Column] = lexical_score, query: str = "query", text: str = "text", order: str = "position") -> DataFrame:
    """New scores, best first; rows from ``threshold`` on, or the best alone if none reaches it."""
    scored = rows.withColumn("score", scorer(F.col(query), F.col(text)))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(order))))
    return ranked.where((F.col("score") >= threshold) | (F.col("rank") == 1))


def fallback_order(rows: DataFrame) -> DataFrame:
    """Without a reranker: best raw scores first, scaled to 0 to 1 over a query's rows."""
    own = Window.partitionBy("qid")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = rows.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))
    return scaled.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id"))))


def detect_program(query: Column) -> Column:
    """Program named first in a query, the longest name of those at one place; null for none."""
    low = F.lower(query)
    for name in UNIVERSITY_NAMES:
        low = F.replace(low, F.lit(name), F.lit(" "))
    ordered = [(slug, word) for slug, words in PROGRAM_KEYWORDS.items() for word in words]
    found = F.array(*[F.struct(F.instr(low, word).alias("at"), F.lit(-len(word)).alias("size"), F.lit(k).alias("k"), F.lit(slug).alias("slug")) for k, (slug, word) in enumerate(ordered)])
    return F.get(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), F.lit(0))["slug"]


def program_filter(rows: DataFrame, program: str = "program", document_id: str = "document_id", group: str = "qid") -> DataFrame:
    """Rows whose document id names the program; all rows where none does or no program is given."""
    hit = F.coalesce(F.contains(F.lower(F.col(document_id)), F.col(program)), F.lit(False))
    return rows.withColumn("__hit", hit).withColumn("__any", F.max(hit).over(Window.partitionBy(group))).where(F.col("__hit") | ~F.col("__any")).drop("__hit", "__any")


def final_top(rows: DataFrame, k: int = 3) -> DataFrame:
    """The first k of each query with the number of its candidates (``total_retrieved``) and of what is left (``final_count``)."""
    own = Window.partitionBy("qid")
    counted = rows.withColumn("total_retrieved", F.count("*").over(own)).where(F.col("rank") <= k)
    return counted.withColumn("final_count", F.count("*").over(own))


def format_regulations(rows: DataFrame, strip_mode: str = "block") -> DataFrame:
    """Result rows of regulations with their defaults; scores rounded to two places."""
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    return rows.select(
        "qid", "rank", strip_metadata(F.col("text"), strip_mode).alias("content"), text("title", ""), "regulation_number", text("hierarchy", ""), "effective_date", text("document_type", "original"),
        F.col("year").cast("int").alias("year"), "pdf_file", F.round("score", 2).alias("score"),
    )


def format_curricula(rows: DataFrame, strip_mode: str = "block") -> DataFrame:
    return rows.select(
        "qid", "rank", strip_metadata(F.col("text"), strip_mode).alias("content"), F.coalesce("title", F.lit("")).alias("title"), F.col("year").cast("int").alias("year"), "major", "major_code", "program_type", "program_name", "source_url",
        F.round("score", 2).alias("score"),
    )


def nest_results(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query: query, total_retrieved, documents in rank order, distilled_context. Queries without rows have none."""
    document = F.struct(*[c for c in rows.columns if c not in ("qid", "total_retrieved")])
    nested = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", document.alias("document")))).alias("d"))
    joined = queries.select("qid", "query").join(nested, "qid", "left")
    return joined.select("qid", "query", F.coalesce(F.size(F.when(F.col("d").isNotNull(), F.col("d"))), F.lit(0)).alias("total_retrieved"), F.transform("d", lambda x: x["document"]).alias("documents"), F.lit(None).cast("string").alias("distilled_context"))


def raw_context(rows: DataFrame) -> DataFrame:
    """(qid, context): chunks with their sources in rank order."""
    said = F.concat(F.lit("[Nguồn "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("file_name", F.lit("Unknown")), F.lit("]\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("rank", said.alias("said"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["said"]), "\n\n---\n\n").alias("context"))


def distil(rows: DataFrame, least: int = 3, shorter: float = 0.1) -> DataFrame:
    """Offline stand-in for a distilling model: the sentences that share a term with the query.

    Fewer than ``least`` chunks, or a result not at least ``shorter`` shorter than the raw context, give the raw context.
    """
    raw = raw_context(rows)
    asked = rows.withColumn("asked", terms(F.col("query")))
    sentences = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.arrays_overlap(terms(s), F.col("asked")))
    listed = F.array_sort(F.collect_list(F.struct("rank", F.array_join(sentences, " ").alias("said"))))
    short = asked.groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.filter(F.transform(listed, lambda x: x["said"]), lambda s: s != ""), "\n").alias("short"))
    good = (F.col("n") >= least) & (F.length("short") > 0) & (F.length("short") <= (1 - shorter) * F.length("context"))
    return raw.join(short, "qid").select("qid", F.when(good, F.col("short")).otherwise(F.col("context")).alias("context"), good.alias("distilled"))


def hashing_embeddings(texts: DataFrame, key: str, text: str = "text", size: int = 64) -> DataFrame:
    """(key, embedding): offline stand-in for an embedding model, counts of terms in ``size`` hash buckets, of unit length; zeros for a text without terms.

    ``key`` names a text. Counts are summed by key and bucket, partly before the shuffle, so a text costs by its words and a row by its buckets.
    """
    bucket = F.conv(F.substring(F.md5(F.encode("term", "utf-8")), 1, 8), 16, 10).cast("long") % size
    words = texts.select(key, F.explode_outer(terms(F.col(text))).alias("term"))
    counted = words.groupBy(key, F.when(F.col("term").isNotNull(), bucket).alias("bucket")).agg(F.count("term").alias("n"))
    listed = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    entry = lambda k: F.when(F.col("norm") > 0, F.coalesce(F.get(F.map_values(F.map_filter("m", lambda b, _: b == k)), F.lit(0)), F.lit(0)) / F.col("norm")).otherwise(0.0)
    return listed.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), entry).alias("embedding"))


def embedding_cost(chunks: Column, tokens: int = 200, price: float = 0.02) -> Column:
    return chunks * tokens / 1e6 * price


def hybrid_search(
    queries: DataFrame, corpus: DataFrame, vectors: DataFrame, k: int = 10, min_score: float = 0.15, threshold: float = 0.1, top: int = 3, scorer: Callable[[Column, Column], Column] = lexical_score
) -> DataFrame:
    """Dense and BM25 candidates, blended, reranked and cut to ``top``: qid, rank, chunk_id, score, source, total_retrieved, text.

    queries: (qid, query, query_vector); corpus: (chunk_id, text); vectors: (chunk_id, embedding).
    """
    asked = queries.select("qid", "query")
    found = blend(dense_top_k(queries.where(F.col("query_vector").isNotNull()).select("qid", "query_vector"), vectors, k, min_score), bm25(asked, corpus, k))
    counted = found.withColumn("total_retrieved", F.count("*").over(Window.partitionBy("qid")))
    said = counted.join(asked, "qid").join(corpus.select("chunk_id", "text"), "chunk_id")
    return rerank(said, threshold, scorer).where(F.col("rank") <= top).select("qid", "rank", "chunk_id", "score", "source", "total_retrieved", "text")

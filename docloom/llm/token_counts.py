"""Token counts with a digest cache.

A text is normalised in the one way that can't change its count (null becomes the empty text) and named by the
SHA-256 of its UTF-8 bytes; the tokenizer is named by the SHA-256 of its file. Stored counts are joined by both
digests, only distinct texts without a stored count are encoded, and their counts are appended to the cache.

Only digests are shuffled to find the misses, and texts that several rows have. If those are few, their broadcast picks them out of a scan, and
only repeated texts go through a shuffle; else Spark joins texts and digests by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans import stored as tables
from docloom.plans.stored import new_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.bpe import encoder

        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda text: len(piece.encode(text))
        else:
            ids = encoder(path).ids
            count = lambda text: len(ids(text)) // 4
        for b in batches:
            n = [count(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing is stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _new_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of the different texts (digest, body).

    Digests that several rows have are found first, by a shuffle of digests. All other texts are encoded where they are read; only
    those repeated go through a shuffle, so that each is encoded once.
    """
    repeated = tables.stored(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated-digests")
    schema = "digest binary, n_tokens long"
    often = texts.join(tables.sized(repeated), "digest", "left_semi").groupBy("digest").agg(F.first("body").alias("body"))
    once = texts.join(tables.sized(repeated), "digest", "left_anti")
    return once.select("digest", "body").mapInArrow(_encode(tokenizer), schema).unionAll(often.mapInArrow(_encode(tokenizer), schema))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out`` (and ``n_bytes``) to every row of ``docs``.

    ``cache``: a folder that keeps counts between runs; without one, a new folder in the shared folder is used.
    Null texts count as empty (0 tokens). Repeated rows and equal texts get equal counts and are encoded once.
    An empty table gives an empty result. Other columns pass through, whatever they are named; one that already is named ``out`` or
    ``n_bytes`` is replaced.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.sha2(body.cast("binary"), 256))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    wanted, misses = docs.select(digest.alias("digest"), body.alias("body")), []
    if not stored.isEmpty():  # with an empty cache all texts are misses
        misses = [tables.stored(wanted.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti"), "misses")]
        wanted = wanted.join(tables.sized(misses[0]), "digest", "left_semi")
    _new_counts(wanted, tokenizer).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    tables.drop_stored(*misses)
    # Runs at the same time may both have stored a text. Written down, the counts don't bind the join below to their grouping, so that Spark can split the rows of a
    # text that very many documents have.
    counts = tables.sized(tables.stored(read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n")), "counts"))
    kept = [c for c in docs.columns if c not in (out, "n_bytes")]
    # The document's columns go in a struct, where no name clashes with the join's.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row"), F.octet_length(body).cast("long").alias("bytes"), digest.alias("digest"))
    joined = keyed.join(counts, "digest", "left")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("bytes").alias("n_bytes"), F.col("n").alias(out))

"""The corpus pipeline over ``documents``: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. Null texts go through every stage as empty ones. Rows that share a doc_id are documents
of their own; near-duplicate removal keeps one row of each component of near copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, packing, simhash, suffix_dedup, toxicity
from docloom.llm.bpe import default_tokenizer
from docloom.llm.components import connected_components
from docloom.llm.near_copies import near_copies
from docloom.llm.queries import table
from docloom.plans.stored import drop_stored, free_shuffles, sized, stored

SEQUENCE_TOKENS, WINDOW_WORDS = 1024, 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity says toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: that with the smallest doc_id, then version; null ids last.

    Two texts are linked if their SimHash fingerprints differ in three bits or fewer, or if their five-word shingles have a similarity of 0.8 or
    more. Texts that share a doc_id, or have none, are told apart by their version; only repeats within a component go.
    """
    prints = simhash.near_duplicates(docs.select(_version().alias("version"), "text"), "version")
    alike = stored(prints.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct(), "alike")
    drop_stored(prints)
    free_shuffles(spark)
    near = near_copies(docs)
    found = stored(near, "near_copies")
    drop_stored(near)
    found = stored(_joined(found, alike), "near_copies")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("f")).select("component", "f.doc_id", "f.version")
    same = F.expr("d.doc_id <=> k.doc_id and d.version = k.version")
    # Rows of the kept id and text: where there are several, one of them stays.
    rows = found.alias("d").join(sized(first).alias("k"), same, "left_semi").groupBy("doc_id", "version").agg(F.count("*").alias("rows"))
    kept = stored(rows, "kept")
    keyed = _versions(docs)
    once, often = (keyed.alias("d").join(sized(kept.where(which)).alias("k"), same, "left_semi") for which in ("rows = 1", "rows > 1"))
    return once.unionAll(often.dropDuplicates(["doc_id", "version"])).select("row.*")


def _joined(found: DataFrame, alike: DataFrame) -> DataFrame:
    """``found`` (doc_id, version, component) with components that links (a, b) between versions join made one."""
    own = found.select("version", "component").distinct()
    first = alike.join(own.select(F.col("version").alias("a"), F.col("component").alias("ca")), "a").select("ca", "b").distinct()
    both = first.join(own.select(F.col("version").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb")
    roots = stored(connected_components(both.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "roots")
    placed = found.join(sized(roots), F.col("component") == F.col("node"), "left")
    return placed.select("doc_id", "version", F.coalesce("root", "component").alias("component"))


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _versions(docs: DataFrame) -> DataFrame:
    """(row, doc_id, version): each row whole, apart from the hash that tells texts of one id apart, whatever its columns are named."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", _version().alias("version"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that another document has too are cut from all of them; ``n_chars`` is counted anew.

    What only repeats within one document stays. The length in bytes is that of suffix_dedup.PASSAGE, not of the query of the operator.
    """
    cut = suffix_dedup.remove_repeats(docs, rule=suffix_dedup.PASSAGE, keep_text=True, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    text = F.when(F.col("was_null"), F.lit(None).cast("string")).otherwise(F.col("kept_text"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))}
    return cut.select(*[new.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.contaminated_words(docs, table(spark, sf_dir, "benchmark"), WINDOW_WORDS)
    dirty = found.where("n_hit > 0").select("doc_id", "version").distinct()
    return _versions(docs).alias("d").join(sized(dirty).alias("k"), F.expr("d.doc_id <=> k.doc_id and d.version = k.version"), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_tokenizer(), SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity, fingerprints and tokens can't be had in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

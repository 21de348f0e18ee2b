"""Merkle manifest of a table: leaves of rows, a tree for each source, a tree over the sources' roots, and proofs.

Levels are built upwards as tables: nodes have a number within their source, the number floor-divided by the fanout names
their run, and each run's sorted children are hashed into a parent. Joins of each level with the one above then append the
siblings, from the root down: a node's path is its own siblings and its parent's path, so a level's join touches its
runs only, and all joins together half as many rows again as there are documents.

Numbers come without a window over a whole source: rows are dealt by ranges of their order, numbered within range and source, and
shifted by the counts of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.stored import drop_stored, stored

FANOUT = 3
NODE = "group string, idx long, n long, digest string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's UTF-8 text, a colon and the text."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of the framed fields; ``changed`` has columns in the place of fields."""
    return F.sha2(F.concat(*[framed(changed.get(f, F.col(f))) for f in FIELDS]).cast("binary"), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, from 0 in each ``group`` by ``order``, and ``n``, the group's rows. ``rows`` should be a stored table, as dealing by ranges reads it twice.

    The part of each row is written down before it is used, so a task that runs again finds the same parts.
    """
    parts = stored(rows.repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()), "merkle-parts")
    counts = parts.groupBy("group", "part").agg(F.count("*").alias("rows"))
    by = Window.partitionBy("group")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("group", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"), F.sum("rows").over(by).alias("n"))
    own = Window.partitionBy("group", "part").orderBy(*order)
    ranked = parts.withColumn("row", F.row_number().over(own) - 1).join(shift, ["group", "part"])
    return ranked.select(*rows.columns, (F.col("row") + F.col("shift")).alias("idx"), "n")


def _climb(nodes: DataFrame, fanout: int, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs (group, idx, n, children, digest), lowest first, and the groups' roots (group, level, digest), a node's level being 0 for the lowest ones.

    A run's ``idx`` and ``n`` are those of the parent that it makes. ``carry`` names columns of the lowest nodes that go along in their runs.
    """
    levels, roots = [], None
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most:
        alone = nodes.where("n = 1").select("group", F.lit(len(levels)).alias("level"), "digest")
        roots = alone if roots is None else roots.unionAll(alone)
        if most == 1:
            break
        child = F.struct("idx", "digest", *(carry if not levels else ()))
        parent = F.floor(F.col("idx") / fanout).cast("long")
        runs = nodes.where("n > 1").groupBy("group", parent.alias("idx"), F.floor((F.col("n") + fanout - 1) / fanout).cast("long").alias("n")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        levels.append(stored(runs.withColumn("digest", F.sha2(F.array_join("children.digest", "").cast("binary"), 256)), "merkle-level"))
        nodes, most = levels[-1].select("group", "idx", "n", "digest"), -(-most // fanout)
    return levels, roots


def _descend(nodes: DataFrame, levels: list[DataFrame], roots: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The lowest ``nodes`` (digest, ``carry``) with their group's root as ``top`` and their ``path``: for each level upwards the digests left and right of the way.

    ``roots`` (group, level, digest, path) has the groups' roots and their own paths. Each level's paths are written down, so no plan has more than one join;
    only those of the lowest nodes are left to the caller.
    """
    paths = None
    for level in range(len(levels), 0, -1):
        here = roots.where(F.col("level") == level).select("group", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("top"), "path")
        if paths is not None:
            here = here.unionAll(_beside(levels[level], paths).select("group", "c.idx", "top", "path"))
        here = stored(here, "merkle-paths")
        if paths is not None:
            drop_stored(paths, levels[level])
        paths = here
    lone = nodes.where("n = 1").join(roots.where("level = 0").select("group", "path"), "group").select("digest", *carry, F.col("digest").alias("top"), "path")
    return lone if paths is None else lone.unionAll(_beside(levels[0], paths).select("c.digest", *[f"c.{x}" for x in carry], "top", "path"))


def _beside(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Each child ``c`` of the runs, with the path of its parent after its own siblings."""
    met = runs.select("group", "idx", "children").join(paths, ["group", "idx"]).select("group", "top", "path", "children", F.posexplode("children").alias("at", "c"))
    siblings = F.struct(
        F.array_join(F.slice("children.digest", F.lit(1), F.col("at")), "").alias("left"),
        F.array_join(F.slice("children.digest", F.col("at") + 2, F.size("children")), "").alias("right"),
    )
    return met.select("group", "c", "top", F.concat(F.array(siblings), "path").alias("path"))


def manifest(docs: DataFrame, tampered_text: Column, tampered: Column, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs`` (doc_id, source, lang, n_chars, text).

    Where ``tampered`` holds, ``folded_root`` is folded from the leaf with ``tampered_text`` as its text; elsewhere, and where it is null, from the
    leaf itself. Null fields make leaves of their own; a null source comes before all others, a null doc_id before all others of its source. Rows that share a
    doc_id are leaves of their own, in the order of their digests; wholly equal rows in any order, as they can be exchanged. A table of one row has
    its leaf as root, and the proof is the digest of nothing. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    fields = docs.select(*FIELDS)
    # Sources as group names: null becomes the least name, and the others keep their order.
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    changed = F.when(tampered, leaf_digest(text=tampered_text))
    leaves = stored(fields.select(group.alias("group"), "doc_id", leaf_digest().alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("uid")), "merkle-leaves")
    kept = ("doc_id", "changed")
    nodes = stored(_numbered(leaves, ["doc_id", "digest", "uid"]).select("group", "idx", "n", "digest", *kept), "merkle-nodes")
    drop_stored(leaves)
    levels, subroots = _climb(nodes, fanout, kept)
    if subroots is None:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # The second tree: the sources' roots as the nodes of one group.
    named = stored(subroots.select(F.lit("").alias("group"), F.col("group").alias("source"), "level", "digest"), "merkle-subroots")
    second = stored(_numbered(named, ["source"]), "merkle-nodes")
    drop_stored(named)
    of = ("source", "level")
    upper, root = _climb(second, fanout, of)
    top = root.first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = spark.range(1).select(F.lit("").alias("group"), F.lit(top.level).alias("level"), F.lit(top.digest).alias("digest"), none.alias("path"))
    tops = stored(_descend(second, upper, start, of).select(F.col("source").alias("group"), "level", "digest", "path"), "merkle-tops")
    found = _descend(nodes, levels, tops, kept)
    root = F.lit(top.digest)
    proof = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s.left, s.right))), "")
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda acc, s: F.sha2(F.concat(s.left, acc, s.right).cast("binary"), 256))
    out = found.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Toxicity: severity grades by cumulative-link ordinal regression over words and word beginnings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.ordinal import Ordinal, Sparse, fit
from docloom.llm.samples import least_hashes

GRADES = 4
#: Bounds of the training sample, by label; the labelled rows with the least hashes are taken.
MAX_TOXIC, MAX_CLEAN = 3000, 5000
#: A feature is used if it is so many times likelier in toxic training documents, and that is this significant (log-likelihood ratio).
MIN_LIFT, MIN_EVIDENCE = 5.0, 12.5
#: A marker is so many times likelier in toxic than in clean documents; grades go by how many different ones a document has.
MARKER_LIFT, GRADE_MARKERS = 10.0, (0, 2, 4)
BEGINNING = 4
#: A document is toxic from this probability of any grade above zero; one without toxic features is far below.
TOXIC_FROM = 0.1

_WORD = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> set[int]:
    """Hashes of a text's different words and of the beginnings of the longer ones."""
    words = set(_WORD((text or "").lower()))
    starts = {w[:BEGINNING] for w in words if len(w) > BEGINNING}
    crc = zlib.crc32
    return {crc(w.encode()) for w in words} | {crc(b"\0" + w.encode()) for w in starts}


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return sum(v for v in map(get, features(text)) if v)


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of at most MAX_TOXIC and MAX_CLEAN labelled documents; and what share of its label each is."""
    judged = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {r.toxic: r.n for r in judged.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [least_hashes(judged.where(F.col("toxic") == k), most, F.xxhash64("doc_id"), "doc_id") for k, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = parts[0].unionAll(parts[1])
    share = {k: min(1.0, most / total[k]) for k, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)) if total.get(k)}
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), share  # the broadcast side has MAX_TOXIC + MAX_CLEAN rows at most


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.array(sorted(features(t.as_py())), np.uint32).tobytes() for t in b.column(0)]
        yield pa.record_batch([pa.array(rows, pa.binary()), b.column(1)], names=["features", "toxic"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents.

    Labels say only toxic or not. A toxic document's grade, from 1, goes by how many different markers it has: features
    far likelier in toxic than in clean documents of the sample. Thresholds are then moved by the log odds that
    sampling toxic and clean documents at different rates took away. Without toxic or clean labels every document scores zero.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample, share = _sampled(rows, labels)
    got = sample.mapInArrow(_hashed, "features binary, toxic int").collect()
    toxic = np.array([r.toxic for r in got], int)
    if not len(got) or toxic.min() == toxic.max():
        return Model({}, [40.0] * (GRADES - 1))
    raw = [np.frombuffer(r.features, np.uint32) for r in got]
    names, column = np.unique(np.concatenate(raw), return_inverse=True)
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    by = [np.bincount(column[toxic[row] == k], minlength=len(names)) for k in (0, 1)]
    lift = ((by[1] + 0.5) / (toxic.sum() + 1)) / ((by[0] + 0.5) / (len(toxic) - toxic.sum() + 1))
    both, rate = by[0] + by[1], toxic.mean()
    part = lambda n, share: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(both * share, 1e-9)), 0.0)
    evidence = 2 * (part(by[1], rate) + part(by[0], 1 - rate))
    marker = (lift >= MARKER_LIFT) & (evidence >= MIN_EVIDENCE)
    markers = np.bincount(row, marker[column], len(raw))
    grade = np.where(toxic == 1, sum((markers > m).astype(int) for m in GRADE_MARKERS[1:]) + 1, 0)
    used = np.flatnonzero((lift >= MIN_LIFT) & (evidence >= MIN_EVIDENCE))
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    keep = place[column] >= 0
    counts = np.bincount(row[keep], minlength=len(raw))
    x = Sparse(np.concatenate(([0], np.cumsum(counts))), place[column][keep])
    model: Ordinal = fit(x, grade, len(used), GRADES)
    moved = model.thresholds + np.log(share[1] / share[0])
    return Model({int(names[u]): float(w) for u, w in zip(used, model.weights) if w}, moved.tolist())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = Ordinal(np.zeros(0), np.array(model.thresholds))
        for b in batches:
            scores = np.array([model.score(t.as_py()) for t in b.column(b.num_columns - 1)])
            least = ordinal.grades(scores)
            columns = [pa.array(least.sum(1)), pa.array(least[:, 0]), pa.array((least >= 0.5).sum(1).astype(np.int32))]
            yield pa.record_batch([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], "severity", "p_toxic", "grade"])

    return run


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (median) and toxic (``p_toxic`` from ``toxic_from`` on) for each row of ``docs``.

    Null and empty texts have no features and the score of the thresholds alone. Whole texts of any length are read;
    repeated rows score alike; an empty table gives an empty result; other columns are not read. The model is
    a few thousand weights, whatever the corpus.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"doc_id {kind}, severity double, p_toxic double, grade int").withColumn("toxic", F.col("p_toxic") >= toxic_from)


def _clean(model: Model, place: int, toxic_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = Ordinal(np.zeros(0), np.array(model.thresholds))
        for b in batches:
            scores = np.array([model.score(t.as_py()) for t in b.column(place)])
            yield b.filter(pa.array(ordinal.grades(scores)[:, 0] < toxic_from))

    return run


def keep_clean(docs: DataFrame, model: Model, text: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns; no join and no shuffle."""
    return docs.mapInArrow(_clean(model, docs.columns.index(text), toxic_from), docs.schema)

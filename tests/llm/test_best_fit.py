import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import best_fit, grouping
from docloom.llm.bpe import default_tokenizer

TEXTS = ["", None, " ", "don't  stop", "日本語 🙂", "a<|endoftext|>b", *["same words here"] * 40, "long text " * 900, "x " * 64, "exactly", *[f"{'word ' * n}" for n in range(1, 90)]]


@functools.cache
def library():
    return Tokenizer.from_file(default_tokenizer())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, uid string, salt int")


def check(rows, texts, capacity):
    """Every id in one piece, pieces gapless in their sequences; the number of sequences."""
    seq, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for spans in seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in enumerate(texts):
        ids = [*library().encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(docs[i]) == 1)
    return len(seq)


def test_pieces_and_sequences(spark):
    rows = best_fit.pack_best_fit(frame(spark, TEXTS), default_tokenizer(), 64).collect()
    n = check(rows, TEXTS, 64)
    total = sum(r.length for r in rows)
    assert n <= total / 64 * 1.05 + 1
    assert best_fit.pack_best_fit(frame(spark, TEXTS).limit(0), default_tokenizer(), 64).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "d"), (1, "d"), (1, None)], "doc_id long, text string")
    rows = best_fit.pack_best_fit(df, default_tokenizer(), 64).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2, 1: 3} and len({(r.sequence_id, r.offset) for r in rows}) == 5


def test_slots_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "sized", lambda df: df)
    check(best_fit.pack_best_fit(frame(spark, TEXTS), default_tokenizer(), 64).collect(), TEXTS, 64)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 99), st.integers(1, 5000), min_size=1, max_size=30), st.integers(0, 99))
def test_every_step_holds_all_documents(histogram, seed):
    rng = random.Random(seed)
    a, b = grouping.first(histogram, 100, rng, 0.0), grouping.first(histogram, 100, rng, 0.5)
    child = grouping.crossover(histogram, a, b, 100, rng)
    changed = grouping.mutate(child, 100, rng)
    for groups in (a, b, child, changed, *grouping.evolve(histogram, [a], 100, grouping.Setting(generations=2), rng)):
        assert grouping.held(groups) == histogram
        assert all(grouping.load(kind) <= 100 for kind in groups)
        assert grouping.count(groups) >= grouping.least_bins(histogram, 100)


def fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[at]:
                left = list(rooms)
                left.remove(room)
                place(at + 1, [*left, room - lengths[at]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_near_the_fewest_bins(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(3, 20) for _ in range(10)), reverse=True)
    found = grouping.evolve(Counter(lengths), [], 30, grouping.Setting(generations=10), rng)[0]
    assert grouping.count(found) == fewest(lengths, 30)
    assert grouping.least_bins(Counter(lengths), 30) <= fewest(lengths, 30)


def test_crossover_keeps_whole_bins_of_the_giver():
    histogram = {60: 2, 40: 2, 50: 4}
    giver = {((60, 1), (40, 1)): 2, ((50, 2),): 2}
    taker = {((50, 1), (40, 1)): 2, ((60, 1),): 2, ((50, 1),): 2}
    assert any(grouping.crossover(histogram, giver, taker, 100, random.Random(k)) == giver for k in range(20))


def test_islands_pass_their_best_on(spark, monkeypatch):
    """With no solution at the bound all rounds run, and the packing is not worse than best-fit decreasing."""
    histogram = {n: 1 + n % 3 for n in range(20, 90)}
    monkeypatch.setattr(grouping, "least_bins", lambda h, c: 0)
    setting = grouping.Setting(islands=3, members=3, generations=2, rounds=3)
    found = best_fit.pack_on_islands(spark, histogram, 128, setting)
    assert grouping.held(found) == histogram
    assert grouping.count(found) <= grouping.count(grouping.first(histogram, 128, random.Random(0), 0.0))
    assert best_fit.pack_on_islands(spark, histogram, 128, setting) == found

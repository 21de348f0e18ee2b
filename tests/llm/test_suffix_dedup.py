import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import suffix_dedup
from docloom.llm.suffix_array import suffix_array
from docloom.llm.suffix_dedup import PASSAGE, Repeat, remove_repeats, whole_words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int)) == -1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    texts = [None, "", "short", "z" * 500, "ab" * 300, passages[0], passages[0]]
    for _ in range(40):
        parts = [rng.choice([" ".join(word() for _ in range(rng.randint(0, 9))), rng.choice(passages)[rng.randint(0, 20) :], rng.choice(passages)]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    copy = list(texts[20])
    for k in range(5):
        copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts


@pytest.mark.parametrize("seed,wide", [(1, 4096), (3, 2)])
def test_removes_exactly_the_repeats(spark, seed, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "BATCH", 16)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    rows = {r.doc_id: r for r in remove_repeats(docs, length=60, gram=16).collect()}
    for i, want in enumerate(brute(texts, 60)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i])


def test_null_and_repeated_ids(spark):
    text = "".join(random.Random(5).choices("abcdefgh ", k=900))
    rows = [(None, text), (None, text), (7, "other " + text[:500]), (7, "x"), (8, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert [r.n_removed for r in got if r.doc_id is None] == [900, 900]
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == [0, 500]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_is_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghij ", k=5000))
    texts = [text, "y" + text[700:1500], text[990:1010]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    for i, want in enumerate(brute(texts, 400)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want


def word_runs(data, words):
    """Where each ``words`` words in a row start and stop; none for no words."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    return [(spans[k][0], spans[k + words - 1][1]) for k in range(len(spans) - words + 1)] if words else []


def brute_runs(texts, rule):
    """Runs of bytes that ``rule`` finds, document by document."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for k in range(len(d) - rule.length + 1):
            seen.setdefault(d[k : k + rule.length], []).append(i)
    spoken = {}
    for i, d in enumerate(data):
        for start, stop in word_runs(d, rule.words):
            spoken.setdefault(d[start:stop], []).append(i)
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, int)
        for k in range(len(d) - rule.length + 1):
            places = seen[d[k : k + rule.length]]
            if len(set(places) if rule.across else places) > 1:
                gone[k + 1 : k + 1 + rule.length] = 1
        for start, stop in word_runs(d, rule.words):
            places = spoken[d[start:stop]]
            if len(set(places) if rule.across else places) > 1:
                gone[start + 1 : stop + 1] = 1
        edges = np.flatnonzero(np.diff(gone)).tolist()
        out.append([r for r in zip(edges[::2], edges[1::2]) if not rule.words or whole_words(d, *r) >= rule.words])
    return out


@pytest.mark.parametrize("wide", [3])
def test_two_rules_at_once(spark, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    texts = [t for t in corpus(6) if t != "z" * 500] + ["q" * 400, "r " * 300]
    rule, report = Repeat(90), Repeat(40, across=True, words=7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(docs, rule=rule, report=report).collect()}
    for i, (spans, reported) in enumerate(zip(brute_runs(texts, rule), brute_runs(texts, report))):
        assert [tuple(s) for s in rows[i].spans] == spans
        assert [tuple(s) for s in rows[i].reported] == reported
    assert rows[len(texts) - 1].n_removed == 600 and not rows[len(texts) - 1].reported


def test_words_cut_at_an_edge_are_not_whole():
    assert [whole_words(b"one two three", *r) for r in ((0, 13), (1, 13), (0, 5), (3, 8), (4, 7), (1, 2), (0, 0))] == [3, 2, 1, 1, 1, 0, 0]


def test_passages_of_over_50_words_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(51)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n))
    passages, texts = [], []
    for words in range(51, 61):
        passages += [prose(words)] * 3
        texts += [f"{prose(70)} {passages[-1]} {prose(9)}", f"{passages[-1]} {prose(60)}", f"{prose(200)} {passages[-1]}"]
    shorter, line = prose(40), prose(60)
    texts += [f"{prose(30)} {shorter} {prose(50)}", f"{shorter} {prose(99)}", f"{line} {prose(9)} {line}", prose(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(docs, rule=PASSAGE).collect()}
    for i, passage in enumerate(passages):
        assert passage not in rows[i].kept_text and len(passage) <= rows[i].n_removed <= len(passage) + 6, i
    assert all(rows[i].kept_text == texts[i] for i in range(len(passages), len(texts)))


def test_passages_of_short_words_are_found_by_their_words(spark):
    """Seven words in a row that another document has are covered though they are shorter than the bytes of the rule; six, or parts of words, are not."""
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))
    seven, six = some(7), some(6)
    texts = [f"{some(9)}\n{seven} {some(4)}", f"{seven}", f"x{seven} {some(3)}", f"{some(2)} {six} {some(3)}", f"{some(3)} {six}x {some(5)}", f"{some(1)}  {seven}\t{some(30)}", seven.replace(" ", "  "), None, "", " \n ", "a " * 40]
    rule = Repeat(60, across=True, words=7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(docs, rule=rule).collect()}
    expected = brute_runs(texts, rule)
    assert [[tuple(x) for x in rows[i].spans] for i in range(len(texts))] == expected
    assert [bool(e) for e in expected] == [True, True, False, False, False, True, False, False, False, False, False]

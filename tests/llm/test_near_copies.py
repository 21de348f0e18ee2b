"""Near copies built by edits, against brute force over five-word shingles."""

import random

import corpus_pipeline
from docloom.llm.near_copies import near_copies
from docloom.llm.simhash import fingerprint


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts = [None, "", " \n", "one two", "One  two", "one two three four five"]
    for words, edits in [(100, 1), (100, 2), (100, 4), (200, 1), (200, 2), (200, 4), (400, 8), (400, 14), (1000, 8), (1000, 20)] * 2:
        base = [word() for _ in range(words)]
        texts.append(" ".join(base))
        copy = list(base)
        for k in rng.sample(range(words), edits):
            copy[k] = word()
        texts.append(" ".join(copy))
    base = [word() for _ in range(150)]  # a group of near copies of each other
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]  # each like the next, the ends unlike
    for k in range(8):
        texts.append(" ".join(chain))
        chain[10 * k : 10 * k + 2] = [word(), word()]
    return texts


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_components_are_those_of_all_pairs(spark):
    texts = edited()
    want = brute(texts)
    got = {r.doc_id: r.component for r in near_copies(rows_of(spark, enumerate(texts))).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == want
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, rows_of(spark, enumerate(texts)), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_texts_without_an_id_or_of_one_id_are_told_apart(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (2, texts[4]), (7, texts[4] + " end"), (7, texts[5]), (None, texts[5])]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, rows_of(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3]), (2, texts[4]), (7, texts[5])])


def test_crowded_keys_are_compared_in_chunks(spark, monkeypatch):
    from docloom.llm import near_copies as module

    monkeypatch.setattr(module, "CHUNK", 3)
    monkeypatch.setattr(module, "MATRIX_BYTES", 0)  # sets are compared pair by pair then
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    base, texts = [word() for _ in range(100)], []
    for k in range(40):  # copies of a text that is not there, more unlike each other than links allow, but for some
        copy = list(base)
        for _ in range(1 if k % 4 else 3):
            copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    want = brute(texts)
    got = {r.doc_id: r.component for r in near_copies(rows_of(spark, enumerate(texts))).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == want


def test_fingerprints_within_three_bits_link_too(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    line, ends = "alpha beta gamma ", [" ".join(word() for _ in range(30)) for _ in range(4)]
    often = [line * 300 + e for e in ends[:3]]  # repeats decide the fingerprint, but count once in a set of shingles
    texts = [often[0], often[1], line * 3 + ends[1], often[2], line * 3 + ends[3], None, ""]
    bits = [fingerprint(t or "") for t in texts]
    assert all((bits[0] ^ bits[i]).bit_count() <= 3 and similarity(texts[0], texts[i]) < 0.8 for i in (1, 3))
    assert similarity(texts[1], texts[2]) >= 0.8 and (bits[1] ^ bits[2]).bit_count() > 3
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, rows_of(spark, enumerate(texts)), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5]

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import bpe, packing, token_counts
from docloom.llm.bpe import WordEncoder, default_tokenizer

ODD = [
    "", " ", "  two  spaces ", "don't we'll I'd they've", "a\n\n\n b\t\tc \n", "naïve façade – “quoted” … 100€ ½ x²", "日本語 text 🙂 ok", "a<|endoftext|>b",
    "\x85next\x1cfield", "x  ", "\xa0\xa0nbsp \xa0y", "'S 's ''s", "word" * 300, "Ünïcödé ßtraße ǅ", "​zero", "tab\there  \r\n end", "1234567890 12ab34", "a\x00b",
]


@functools.cache
def library():
    return Tokenizer.from_file(default_tokenizer())


def exact(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_word_cache_gives_the_librarys_ids(spark):
    fast = WordEncoder(default_tokenizer())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for text in [*ODD, *(r.text for r in rows if r.text)]:
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == exact(text), text[:80]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")


def test_counts_use_and_fill_the_cache(spark, tmp_path):
    docs = frame(spark, [*ODD, None, ODD[3], ODD[3]])
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, default_tokenizer(), cache).collect()}
        assert got == {i: (len((t or "").encode()), len(exact(t))) for i, t in enumerate([*ODD, None, ODD[3], ODD[3]])}
    assert token_counts.read_cache(spark, cache).count() == len(set(ODD))  # the second run encodes nothing
    assert token_counts.count_tokens(docs.limit(0), default_tokenizer(), cache).count() == 0


def check_packing(rows, texts, capacity):
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
        ids = [*exact(t), 0]
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = sum(r.length for r in rows)
    return used / (capacity * len(seq)) if seq else 1


def test_packing_is_gapless_and_whole(spark):
    texts = [*ODD, None, *["same words here"] * 40, "long text " * 900]
    rows = packing.pack_documents(frame(spark, texts), default_tokenizer(), 64).collect()
    assert check_packing(rows, texts, 64) > 0.9
    assert packing.pack_documents(frame(spark, texts).limit(0), default_tokenizer(), 64).count() == 0


@pytest.mark.parametrize("histogram", [{1: 1000}, {1024: 3, 1: 5}, {700: 10, 300: 10, 24: 9}, {513: 4, 511: 1, 3: 100}])
def test_patterns_hold_every_length(histogram):
    patterns = packing.pack_histogram(histogram, 1024)
    held = Counter()
    for runs, packs in patterns:
        assert sum(n * k for n, k in runs) <= 1024
        for n, k in runs:
            held[n] += k * packs
    assert held == histogram


def test_a_filled_cache_leaves_only_new_texts(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/counts"
    assert token_counts.count_tokens(frame(spark, ODD[:9]), default_tokenizer(), cache).count() == 9
    for few in (True, False):  # the misses are broadcast, or joined by a shuffle
        monkeypatch.setattr(token_counts.tables, "small", lambda df, few=few: few)
        texts = [*ODD, f"new text {few}", f"new text {few}"]
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, texts), default_tokenizer(), cache).collect()}
        assert got == {i: len(exact(t)) for i, t in enumerate(texts)}
    stored = [r.digest for r in token_counts.read_cache(spark, cache).collect()]
    assert len(stored) == len(set(stored)) == len(set(ODD)) + 2


def test_full_caches_and_long_words(monkeypatch):
    """Words go from one generation to the next, and long ones aren't kept; the ids stay those of the library."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_CHARS", 6)
    fast = WordEncoder(default_tokenizer())
    for text in ["one two three four five six", "one six", "abcdefghijkl one\tabcdefghijkl", "seven eight one two", *ODD, *ODD]:
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == exact(text)
        assert all(len(w) <= 6 for w in [*fast.known, *fast.before])


def test_characters_are_judged_once_a_word():
    """A text of known words isn't scanned again; a word that the pattern may cut otherwise is never kept, so its texts go to the library each time."""
    fast, seen = WordEncoder(default_tokenizer()), []
    judge = fast.uncertain
    fast.uncertain = lambda s: seen.append(s) or judge(s)
    odd = ["one two \u043e\u0434\u0438\u043d three", "one\x1ctwo", "one two<|endoftext|> one", "one \u0661\u0662 two"]
    for text in ["one two, one two", "two one", *odd, *odd, "one three two"]:
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == exact(text)
    assert "one two, one two" not in seen and "two one" not in seen
    assert [seen.count(w) for w in ("one", " two", ",", " one")] == [1, 1, 1, 1]
    assert not any(judge(w) for w in fast.known)


def test_columns_of_any_name_pass_through(spark):
    names = ["__n", "__digest", "digest", "n", "body", "row", "key", "rows", "version", "bytes", "tokenizer"]
    df = frame(spark, ["a b", "a b", None, "c"])
    for name in names:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    got = token_counts.count_tokens(df, default_tokenizer()).collect()
    assert sorted((r.doc_id, r.n_tokens, *(r[n] for n in names)) for r in got) == [(i, k, *(f"{n}{i}" for n in names)) for i, k in enumerate([2, 2, 0, 1])]

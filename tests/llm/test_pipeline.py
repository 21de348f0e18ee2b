"""The pipeline against a plain version of each stage."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import best_fit, decontamination, license_scan, media, merkle, packing, simhash, suffix_dedup, toxicity
from docloom.llm.bpe import default_tokenizer
from docloom.llm.simhash import fingerprint
from docloom.llm.suffix_dedup import PASSAGE
from tests.llm.test_suffix_dedup import brute_runs
from tests.llm.test_tokens import check_packing


def word(rng):
    return "".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(5, 400)) for _ in range(120)]
    bad = [f"{prose(rng, 60)} you idiot {prose(rng, 20)} moron {prose(rng, 5)}" for _ in range(30)]
    passage = prose(rng, 90)
    bench = [prose(rng, 30) for _ in range(4)] + [prose(rng, 6)]
    texts += bad + [texts[3], texts[3] + " end", texts[5]] + [f"{prose(rng, 50)} {passage} {prose(rng, 40)}" for _ in range(3)] + [f"{prose(rng, 40)} {b} {prose(rng, 9)}" for b in bench] + [None, ""]
    at = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    labels = [(i, 1, int(120 <= i < 150)) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}", docs, bench


def brute(docs, bench, model):
    thresholds, texts = model.thresholds, {}
    from docloom.llm.ordinal import Ordinal

    import numpy as np

    ordinal = Ordinal(np.zeros(0), np.array(thresholds))
    texts = {i: t for i, t, *_ in docs if ordinal.grades(np.array([model.score(t)]))[0, 0] < toxicity.TOXIC_FROM}
    after_toxic = set(texts)
    prints = {i: fingerprint(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    texts = {i: t for i, t in texts.items() if find(i) == i}
    runs = dict(zip(texts, brute_runs(list(texts.values()), PASSAGE)))
    cut = {}
    for i, t in texts.items():
        d = (t or "").encode()
        left = b"".join(d[a:b] for a, b in zip([0, *(stop for _, stop in runs[i])], [*(start for start, _ in runs[i]), len(d)]))
        cut[i] = None if t is None else left.decode("utf-8", "ignore")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(w[k : k + min(10, len(w))]) for w in map(split, bench) for k in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(w) for w in windows}
    clean = {i: t for i, t in cut.items() if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))}
    return after_toxic, set(texts), cut, clean


def test_stages(spark, folder):
    sf_dir, docs, bench = folder
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    after_toxic, kept, cut, clean = brute(docs, bench, model)
    assert {i for i, *_ in docs} - after_toxic == set(range(120, 150))
    now, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        results.append({r.doc_id: r for r in now.collect()})
        if name != "packing":
            assert now.columns == columns
    assert set(results[0]) == after_toxic
    assert set(results[1]) == kept
    assert {i: r.text for i, r in results[2].items()} == cut and sum(cut[i] != docs[i][1] for i in cut) == 3
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in results[2].values())
    assert {i: r.text for i, r in results[3].items()} == clean and len(clean) < len(cut)
    full = [clean.get(i, "absent") for i in range(len(docs))]
    rows = now.collect()
    ids = sorted(clean)
    renumbered = {i: k for k, i in enumerate(ids)}
    assert {r.doc_id for r in rows} == set(ids) and full
    check_packing([type("R", (), {**r.asDict(), "doc_id": renumbered[r.doc_id]})() for r in rows], [clean[i] for i in ids], 1024)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_repeated_rows_and_empty_tables(spark, folder):
    sf_dir, docs, _ = folder
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    twice = base.where("doc_id < 9").unionAll(base.where("doc_id < 9")).unionAll(base.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    once = corpus_pipeline.keep_one_of_near_duplicates(spark, twice, sf_dir)
    assert sorted(r.doc_id for r in once.collect()) == list(range(9))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.limit(0), sf_dir).count() == 0


def test_hashes_are_the_contracts():
    assert fingerprint("one") == xxhash.xxh64_intdigest(b"one", 42)


def test_stages_keep_columns_of_any_name(spark, folder):
    sf_dir, _, _ = folder
    base, names = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 200"), ["version", "__n", "__digest", "key", "rows", "row", "digest", "component", "d", "k", "node", "rest", "n_hit"]
    docs = base.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == [*base.columns, *names], name
        for r in docs.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names), name
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() >= docs.count()


def test_operators_take_columns_of_any_name(spark, folder):
    """Every operator over documents gives the same rows with columns that are named like those inside it."""
    sf_dir, _, _ = folder
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    odd = base.withColumns({n: F.lit("x") for n in ["version", "__n", "__digest", "key", "rows", "digest", "uid", "part", "length", "token", "node", "component", "fingerprint", "n_bytes", "grade", "w", "pos"]})
    bench, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    licences = license_scan.train(["some words of the corpus", "and other lines"])
    path = default_tokenizer()
    for run in (
        lambda d: decontamination.contaminated_words(d, bench, 10), lambda d: packing.pack_documents(d, path, 64).select("doc_id", "start", "length"), lambda d: best_fit.pack_best_fit(d, path, 64).select("doc_id", "start", "length"),
        lambda d: toxicity.score_toxicity(d, model), lambda d: license_scan.scan_licenses(d, licences).select("doc_id", "families"), lambda d: simhash.near_duplicates(d), lambda d: media.media_digests(d).select("doc_id", "payload_sha256"),
        lambda d: suffix_dedup.remove_repeats(d, length=60).select("doc_id", "n_removed"), lambda d: merkle.manifest(d, F.col("text"), F.lit(False)),
    ):
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(base).collect()))

import random

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash
from docloom.llm.bitslice import lanes_within_three, planes_of, spanning_links, within_three
from docloom.llm.components import connected_components
from docloom.llm.simhash import fingerprint, near_duplicates, near_links


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    out = {0, 2**64 - 1}
    while len(out) < n:
        x = rng.choice([*centres, rng.getrandbits(64)])
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def all_links(words):
    return [(a, b) for i, a in enumerate(words) for b in words[:i] if (a ^ b).bit_count() <= 3]


def test_bit_planes_count_like_popcounts():
    words = clustered(1, 300)
    planes, everyone = planes_of(np.array(words, np.uint64)), (1 << len(words)) - 1
    for q in words[:60]:
        near = within_three(planes, everyone, q)
        assert [near >> i & 1 for i in range(len(words))] == [int((q ^ w).bit_count() <= 3) for w in words]
    x = np.array([a ^ b for a, b in zip(words, words[1:])], np.uint64)
    assert lanes_within_three(x).tolist() == [int(d).bit_count() <= 3 for d in x]
    links = spanning_links(np.array(words, np.uint64))
    assert roots(words, links) == roots(words, all_links(words)) and len(links) < len(words)


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO", "a b c", "a  b\tc\nd É x", "a\x1cb c\xa0d e f g"])
def test_fingerprint(text):
    assert fingerprint(text or "") == slow_fingerprint(text)


@pytest.mark.parametrize("chunk", [2048, 20])
def test_links_join_what_all_pairs_join(spark, chunk):
    words = clustered(2, 400)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    prints = spark.createDataFrame([(s,) for s in signed], "print long").repartition(3)
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(prints, chunk).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert roots(words, got) == roots(words, all_links(words))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(200)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for e in real for x in e}
    assert {r.node: r.root for r in connected_components(df).collect()} == roots(nodes, real)
    assert connected_components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(400)) for _ in range(4)]
    texts = [None, "", base[0], base[0].upper(), base[0] + " tail", base[1], base[1].replace("a", "b", 1), base[2], base[3] + " x y", base[3], "one", "one"]
    ids = [50, 3, 9, 2, 30, 31, 32, 33, 34, None, 36, 35]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, component_id string")
    rows = near_duplicates(docs).collect()
    prints = {i: slow_fingerprint(t) for i, t in zip(ids, texts)}
    words = sorted(set(prints.values()))
    root = roots(words, all_links(words))
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == min(i for i in ids if i is not None and root[prints[i]] == root[prints[r.doc_id]])
    assert len(rows) == len(ids)
    assert near_duplicates(docs.limit(0)).count() == 0

import random
import re

import pytest

from docloom.llm import decontamination
from docloom.llm.decontamination import contaminated_words


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        size = min(10, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[k : k + size]:
                    hit.update(range(i, i + size))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), ",".join(sorted(ids))


@pytest.mark.parametrize("part", [100_000, 7])
def test_hits_match_brute_force(spark, part):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "Été", "x1", "rare%d" % rng.randint(0, 30), "ÀB"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40, 0, 12])]
    items += [(20, None), (21, items[6][1]), (3, "the of the of the of the of the of the of")]
    texts = [None, "", "...", "the", "x1 THE, of!"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            v = words(rng.choice(items)[1])
            at = rng.randint(0, max(0, len(v) - 10))
            parts += ["\n".join(v[at : at + rng.randint(5, 30)]), word()]
        texts.append(" - ".join(parts))
    texts.append(texts[-1])
    docs = spark.createDataFrame([(i if i != 9 else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = {r.doc_id: r for r in contaminated_words(docs, bench, part_windows=part).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i if i != 9 else None]
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == brute(t, items), (i, t)


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "B")], "item_id long, text string")
    assert sorted(r.n_hit for r in contaminated_words(docs, bench).collect()) == [0, 1, 1]
    assert [r.n_hit for r in contaminated_words(docs, bench.limit(0)).collect()] == [0, 0, 0]
    assert contaminated_words(docs.limit(0), bench).count() == 0


def test_separators_are_the_contracts():
    assert re.split(decontamination.SEPARATORS, "a-b\x7fc\x80d") == ["a", "b", "c\x80d"]


def test_query_matches_its_sql(spark):
    from docloom.llm import queries
    from tests.oracle import compare

    sf = "/root/testdata/sf0.001"
    assert compare(queries.op2_decontamination(spark, sf), sf, queries.oracle_sql()["op2_decontamination"]) == ""

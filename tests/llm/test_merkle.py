import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest("".join(map(framed, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))


def climb(nodes, paths):
    """The root of ``nodes``, appending to each node's path the digests left and right of its way."""
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run, p = nodes[at[k] // 3 * 3 : at[k] // 3 * 3 + 3], at[k] % 3
            path.append((run[:p], run[p + 1 :]))
            at[k] //= 3
        nodes = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0]


def plain_manifest(rows):
    """Every row's leaf, subroot, root, proof, folded root and verdict, by one list for each source."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    paths, subroots = {}, []
    for s in names:
        found = sorted(sources[s], key=lambda x: x[:3])
        paths[s] = [[] for _ in found]
        subroots.append(climb([x[2] for x in found], paths[s]))
        sources[s] = found
    tops = [[] for _ in names]
    root = climb(subroots, tops)
    out = []
    for s, subroot, top in zip(names, subroots, tops):
        for (_, _, own, r), path in zip(sources[s], paths[s]):
            whole = path + top
            touched = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            folded = leaf(r, r["text"].replace("\n", "")) if touched else own
            for left, right in whole:
                folded = digest("".join([*left, folded, *right]))
            proof = digest("".join("".join(left + right) for left, right in whole))
            out.append((r["doc_id"], own, subroot, root, proof, folded, folded == root))
    return out


def run(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(df, F.translate("text", "\n", ""), tampered)


def held(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], SCHEMA)
    assert Counter(tuple(r) for r in run(df).collect()) == Counter(plain_manifest(rows))


def row(doc_id, text="a\nb", lang="en", source="s", n_chars=3):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": n_chars}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82])
def test_sizes_of_one_source(spark, n):
    held(spark, [row(i * 7, f"line {i}\nmore") for i in range(n)])


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [row(i, f"t{i}\n", source=s) for i in range(20) for s in ("hot", "hot", "é", "Z", None)]
    rows += [row(None), row(None, None), row(None, "x", source=None), row(3, None, None, None, None), row(5, "", "", "", 0), row(1, "y" * 300_000 + "\n" + "z" * 300_000, source="one")]
    rows += [row(6, "only lines\n\n", source="-"), row(6, "only lines\n\n", source="=")]
    held(spark, rows)


def test_every_source_is_alone(spark):
    held(spark, [row(i, f"x{i}\n", source=f"s{i}") for i in range(11)])


def test_empty_table(spark):
    out = run(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_columns_that_clash_are_not_read(spark):
    rows = [row(i, f"x{i}\n") for i in range(7)]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], SCHEMA)
    for name in ("digest", "group", "idx", "n", "part", "uid", "path", "leaf", "root", "children", "version"):
        df = df.withColumn(name, F.lit("clash"))
    assert Counter(tuple(r) for r in run(df).collect()) == Counter(plain_manifest(rows))


def test_documents_of_the_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held(spark, [r.asDict() for r in df.collect()])

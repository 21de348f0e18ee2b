"""The stemmer against published pairs and a plain version, and stemmed search against plain sums."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from docloom.functions import stemming
from docloom.functions.fixed_values import ENGLISH_STOP, STEM_ENDINGS, STEM_INVARIANT, STEM_KEPT_ING, STEM_PREFIXES, STEM_R1, STEM_R2, STEM_SPECIAL
from docloom.operators import retrieval

#: The sample vocabulary published with the algorithm.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort
consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
MORE = "ties cries gas this gaps kiwis hopped hoping agreed feed luxuriated hopping falling by say enjoy yes youth beautiful relational conditional rationalization generously communism arsenal hopefulness operator sensibility apologi triplicate formative electrical replacement adoption controll rate skis news inning exceed dying only a is 42nd naïve abruptly cease bled red sing singing flies died us bus pass y yy ay".split()

V, C = "aeiouy", "[^aeiouy]"


def region(w, start):
    m = re.search(f"[{V}]{C}", w[start:])
    return start + m.end() if m else len(w)


def short_end(w):
    return bool(re.search(f"(^[{V}]{C}$)|({C}[{V}][^aeiouywxY]$)", w))


def plain_stem(w):
    if len(w) <= 2 or w in STEM_INVARIANT:
        return w
    if w in STEM_SPECIAL:
        return STEM_SPECIAL[w]
    chars = list(w)
    for i, ch in enumerate(chars):
        if ch == "y" and (i == 0 or chars[i - 1] in V):
            chars[i] = "Y"
    w = "".join(chars)
    r1 = next((len(p) for p in STEM_PREFIXES if w.startswith(p)), None) or region(w, 0)
    r2 = region(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in STEM_KEPT_ING:
        return w.lower()
    for s in ("eedly", "eed"):
        if w.endswith(s):
            w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in V for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif short_end(w) and len(w) <= r1:
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for number, rules in enumerate([STEM_R1[0], STEM_R1[1], dict.fromkeys(STEM_R2, "")]):
        for s in sorted(rules, key=len, reverse=True):
            if w.endswith(s):
                stem = w[: -len(s)]
                ok = len(stem) >= (r2 if number == 2 or s == "ative" else r1)
                if number == 0 and s == "ogi":
                    ok = ok and stem.endswith("l")
                if number == 0 and s == "li":
                    ok = ok and stem[-1:] != "" and stem[-1] in STEM_ENDINGS
                if s == "ion":
                    ok = ok and stem.endswith(("s", "t"))
                w = stem + rules[s] if ok else w
                break
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not short_end(w[:-1]))) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.lower()


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemming.stem(F.col("w")).alias("s"))
    return {r.w: r.s for r in df.collect()}


def test_published_vocabulary(spark):
    pairs = dict(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert stems(spark, pairs) == pairs
    assert {w: plain_stem(w) for w in pairs} == pairs
    known = {"generously": "generous", "communism": "communism", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "by": "by", "say": "say", "falling": "fall", "skies": "sky"}
    assert stems(spark, known) == known


def test_every_word_of_the_corpus_as_the_plain_stemmer_says(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select(F.explode(retrieval.terms(F.col("text"))).alias("w")).distinct()
    words = [r.w for r in texts.collect()][:6000] + MORE + [a + b for a in ("ra", "gener", "absolut", "hap", "y", "bl") for b in (*STEM_R1[0], *STEM_R1[1], *STEM_R2, "eed", "eedly", "ed", "ingly", "ies", "ied", "y", "e", "ll")]
    got = stems(spark, set(words) | {None})
    assert got.pop(None) is None
    assert {w: s for w, s in got.items() if s != plain_stem(w)} == {}


def test_stemmed_search(spark):
    corpus = [("a", "Running runners run in the rain"), ("b", "The rains of autumn"), ("c", "nothing here"), ("d", "run run run rain"), ("e", ""), ("f", None)]
    asked = [(1, "the running rain"), (2, "of the"), (3, "autumnal nothings")]
    got = retrieval.bm25(spark.createDataFrame(asked, "qid int, query string"), spark.createDataFrame(corpus, "chunk_id string, text string"), 3, split=retrieval.english_terms, stem=stemming.stem)
    words = lambda t: [plain_stem(w) for w in re.split(r"[\W_]+", (t or "").lower()) if len(w) > 1 and w not in ENGLISH_STOP]
    listed = {k: words(t) for k, t in corpus}
    average = sum(map(len, listed.values())) / sum(t is not None for _, t in corpus)
    expected = []
    for qid, q in asked:
        scored = []
        for key, w in listed.items():
            tf = Counter(w)
            parts = [(math.log(1 + (len(corpus) - df + 0.5) / (df + 0.5)), tf[t]) for t in set(words(q)) if tf[t] for df in [sum(t in x for x in listed.values())]]
            if parts:
                scored.append((-round(sum(i * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(w) / average)) for i, n in parts), 6), key))
        expected += [(qid, key, -s, r) for r, (s, key) in enumerate(sorted(scored)[:3], 1)]
    assert sorted((r.qid, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == sorted(expected)

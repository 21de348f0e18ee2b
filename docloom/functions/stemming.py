"""English stems by suffix rules (Porter2), as a column expression over single lower-case words.

Each step is an expression on the word before it, so a stem costs some dozen patterns: apply it to the distinct words of a corpus, not to every
occurrence. Words have no apostrophes here, as terms are letters and digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed_values import STEM_ENDINGS, STEM_INVARIANT, STEM_KEPT_ING, STEM_PREFIXES, STEM_R1, STEM_R2, STEM_SPECIAL
from docloom.functions.text import let

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT = f"^{VOWEL}{OTHER}$|{OTHER}{VOWEL}[^aeiouywxY]$"


def _cut(w: Column, n: int, add: str = "") -> Column:
    return F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(add))


def _suffixes(w: Column, rules: dict[str, str], allowed: Callable[[str, Column], Column]) -> Column:
    """The longest suffix of ``rules`` that the word has, replaced if ``allowed``; others aren't tried then."""
    out = w
    for suffix in sorted(rules, key=len):
        out = F.when(F.endswith(w, F.lit(suffix)), F.when(allowed(suffix, w), _cut(w, len(suffix), rules[suffix])).otherwise(w)).otherwise(out)
    return out


def _after(w: Column, skip: Column) -> Column:
    """Where the region after the first consonant that follows a vowel begins, looked for from ``skip`` on."""
    rest = F.substring(w, skip + 1, F.length(w))
    found = F.regexp_extract(rest, f"^.*?{VOWEL}{OTHER}", 0)
    return F.when(found != "", skip + F.length(found)).otherwise(F.length(w))


def _plural(w: Column) -> Column:
    short = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    return (
        F.when(F.endswith(w, F.lit("sses")), _cut(w, 2)).when(w.rlike("ie[ds]$"), short).when(w.rlike("(us|ss)$"), w)
        .when(F.endswith(w, F.lit("s")) & w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w)
    )


def _past(w: Column, r1: Column) -> Column:
    def mended(x: Column) -> Column:
        return (
            F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(x, 1))
            .when(x.rlike(SHORT) & (F.length(x) <= r1), F.concat(x, F.lit("e"))).otherwise(x)
        )

    eed = F.regexp_extract(w, "eed(ly)?$", 0)
    cut = F.regexp_extract(w, "(?:ed|ing)(?:ly)?$", 0)
    stem = F.substring(w, F.lit(1), F.length(w) - F.length(cut))
    return F.when(eed != "", F.when(F.length(w) - F.length(eed) >= r1, F.concat(F.substring(w, F.lit(1), F.length(w) - F.length(eed)), F.lit("ee"))).otherwise(w)).when((cut != "") & stem.rlike(VOWEL), let(stem, mended)).otherwise(w)


def _last(w: Column, r1: Column, r2: Column) -> Column:
    at = F.length(w) - 1
    drop_e = F.endswith(w, F.lit("e")) & ((at >= r2) | ((at >= r1) & ~_cut(w, 1).rlike(SHORT)))
    return F.when(drop_e | (F.endswith(w, F.lit("ll")) & (at >= r2)), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay. Null gives null."""

    def rest(w: Column, r1: Column, r2: Column) -> Column:
        in_r1 = lambda s, x: F.length(x) - len(s) >= r1
        in_r2 = lambda s, x: F.length(x) - len(s) >= r2
        ending = lambda s, x: F.length(x) - len(s) >= r1 if s not in ("ogi", "li") else (F.length(x) - len(s) >= r1) & (x.rlike("logi$") if s == "ogi" else x.rlike(f"[{STEM_ENDINGS}]li$"))
        third = lambda s, x: in_r2(s, x) if s == "ative" else in_r1(s, x)
        fourth = lambda s, x: in_r2(s, x) & x.rlike("[st]ion$") if s == "ion" else in_r2(s, x)
        steps = [
            lambda x: _past(x, r1),
            lambda x: F.when(x.rlike(f".{OTHER}[yY]$"), _cut(x, 1, "i")).otherwise(x),
            lambda x: _suffixes(x, STEM_R1[0], ending),
            lambda x: _suffixes(x, STEM_R1[1], third),
            lambda x: _suffixes(x, dict.fromkeys(STEM_R2, ""), fourth),
            lambda x: _last(x, r1, r2),
        ]

        def walk(x: Column, left: list) -> Column:
            return let(left[0](x), lambda y: walk(y, left[1:])) if left else x

        return F.when(w.isin(STEM_KEPT_ING), w).otherwise(walk(w, steps))

    def regions(w: Column) -> Column:
        prefix = F.length(F.regexp_extract(w, f"^({'|'.join(STEM_PREFIXES)})", 0))
        return let(F.when(prefix > 0, prefix).otherwise(_after(w, F.lit(0))), lambda r1: let(_after(w, r1), lambda r2: let(_plural(w), lambda x: rest(x, r1, r2))))

    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    special = F.create_map(*[F.lit(x) for kv in STEM_SPECIAL.items() for x in kv])
    return F.when((F.length(word) <= 2) | word.isin(STEM_INVARIANT), word).otherwise(F.coalesce(F.try_element_at(special, word), F.lower(let(marked, regions))))

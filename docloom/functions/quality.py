"""Content quality of a text: hard rules, a score out of 100, and the figures behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed_values import ERROR_KEYWORDS, LETTERS, MAX_HEADER_SHARE, MAX_LINK_SHARE, MIN_LENGTH, MIN_SCORE, NAVIGATION_KEYWORDS, STOP_WORDS, USEFUL_KEYWORDS
from docloom.functions.text import SPACES, let, lines, strip, words


def _present(low: Column, keywords: list[str]) -> Column:
    """How many of the keywords a lower-cased text has as substrings."""
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def _class(characters: str) -> str:
    """A pattern class of lower-case letters in few ranges: a gap that has upper-case letters only is taken in, as lower-cased texts have none."""
    codes = sorted({ord(x) for x in characters.lower()})
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and all(chr(x).lower() != chr(x) for x in range(ranges[-1][1] + 1, code)):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


_KNOWN = "a-z" + _class(LETTERS.replace("a-zA-Z", ""))
_SIMPLE = _class("".join(x for x in LETTERS.replace("a-zA-Z", "") if ord(x) < 256))


#: ASCII characters that are neither letters nor white space.
_MARKS = "".join(x for x in map(chr, range(128)) if not x.isalpha() and x not in SPACES)


def _meaningful(low: Column) -> Column:
    """Words of more than three known letters that aren't stop words; other characters than letters and white space don't count at all.

    Most of those go as the text is split; only words that still have others than simple letters are looked at by a pattern of all.
    """
    stops = [w for w in STOP_WORDS if len(w) > 3]
    listed = F.array_remove(F.split(F.translate(low, SPACES + _MARKS, " " * len(SPACES)), " "), "")
    known = lambda w: F.when(w.rlike(f"^[a-z{_SIMPLE}]+$"), w).otherwise(F.regexp_replace(w, f"[^{_KNOWN}]+", ""))
    return F.size(F.filter(F.transform(listed, known), lambda w: (F.length(w) > 3) & ~w.isin(stops)))


def paragraph_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\n\n")) + 1


def _measures(c: Column, s: Column, low: Column) -> Column:
    blank = SPACES.replace("\n", "")
    return F.struct(
        F.length(c).alias("length"), F.length(s).alias("own_length"), paragraph_count(c).alias("paragraphs"), paragraph_count(s).alias("own_paragraphs"),
        F.size(words(s)).alias("words"), _meaningful(low).alias("meaningful"),
        _present(low, USEFUL_KEYWORDS).alias("useful"), _present(low, ERROR_KEYWORDS).alias("errors"), _present(low, NAVIGATION_KEYWORDS).alias("navigation"),
        F.regexp_count(s, F.lit(r"\[.*?\]\(.*?\)")).alias("links"), F.regexp_count(s, F.lit(f"[^{SPACES}][^\n]*")).alias("filled"), F.regexp_count(s, F.lit(f"(?<![^\n])[{blank}]*+#[^\n]*")).alias("headers"),
    )


def measures(c: Column) -> Column:
    """What the rules and the score need of a text, each figure computed once, as a struct; ``own_`` is without white space at the ends."""
    return let(strip(c), lambda s: let(F.lower(s), lambda low: _measures(c, s, low)))


def _rule(m: Column) -> Column:
    return (
        F.when(F.coalesce(m["own_length"], F.lit(0)) == 0, "empty_content")
        .when(m["own_length"] < MIN_LENGTH, "too_short")
        .when(m["errors"] > 0, "error_page")
        .when(m["navigation"] >= 3, "navigation_page")
        .when((m["words"] > 0) & (m["links"] / m["words"] > MAX_LINK_SHARE), "too_many_links")
        .when((m["filled"] > 0) & (m["headers"] / m["filled"] > MAX_HEADER_SHARE), "only_headers")
    )


def _density(m: Column) -> Column:
    return F.when(m["words"] > 0, m["meaningful"] / m["words"]).otherwise(0.0)


def _points(m: Column, paragraphs: str = "paragraphs") -> Column:
    points = F.least(m["words"] / 300, F.lit(1.0)) * 30 + F.least(m[paragraphs] / 10, F.lit(1.0)) * 20 + _density(m) * 30 + F.least(m["useful"] / 5, F.lit(1.0)) * 20
    return F.least(points, F.lit(100.0))


def _reason(m: Column, min_score: float) -> Column:
    return F.coalesce(_rule(m), let(_points(m, "own_paragraphs"), lambda s: F.when(s < min_score, F.format_string("low_score_%.1f", s))))


def hard_rule(c: Column) -> Column:
    """The first rule that a stripped text breaks, else null."""
    return let(measures(c), _rule)


def score(c: Column) -> Column:
    """Words (30 points at 300), paragraphs (20 at 10), density of meaningful words (30), keywords (20 at 5)."""
    return let(measures(c), lambda m: _points(m))


def rejection(c: Column, min_score: float = MIN_SCORE) -> Column:
    """Why a text is rejected; null if it is accepted."""
    return let(measures(c), lambda m: _reason(m, min_score))


def stats(c: Column) -> Column:
    """The figures of a text as a struct."""
    return let(
        measures(c),
        lambda m: F.struct(
            m["length"].alias("length"), m["words"].alias("word_count"), m["paragraphs"].alias("paragraph_count"), m["meaningful"].alias("meaningful_words"),
            _density(m).alias("information_density"), _points(m).alias("score"), _reason(m, MIN_SCORE).isNull().alias("is_useful"),
        ),
    )


def is_index_page(c: Column, share: float = 0.5) -> Column:
    """Whether most of a page's filled lines are links; a rule of our own in place of a judgement."""
    filled = F.filter(F.transform(lines(c), lambda x: strip(x)), lambda x: x != "")
    links = F.filter(filled, lambda x: x.rlike(r"^[-*\s]*\[[^\]]*\]\([^)]*\)"))
    return (F.size(filled) > 0) & (F.size(links) / F.greatest(F.size(filled), F.lit(1)) >= share)


def worth_distilling(total_chars: Column, least: int = 2000) -> Column:
    return total_chars >= least

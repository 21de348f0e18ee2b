"""Column functions on text: stripping, normalisation, spelling, truncation, acronyms, parsing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions.fixed_values import SPELLING


#: The characters of Unicode's White_Space property.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` has it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim knows blanks only unless told)."""
    return F.trim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Words between white space; an empty array for an empty text. Splitting at one character is far cheaper than by a pattern."""
    return F.array_remove(F.split(F.translate(c, SPACES, " " * len(SPACES)), " "), "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def collapse(c: Column) -> Column:
    """Words joined by one blank; null for null or empty, empty for white space alone."""
    return F.when(c != "", strip(F.regexp_replace(c, r"(?U)\s+", " ")))


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, for which Spark has no function; plain ASCII is passed through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@pandas_udf(T.IntegerType())
def nfc_changes(s: pd.Series) -> pd.Series:
    """Places at which a text and its NFC differ, as far as the shorter goes."""
    return s.map(lambda x: 0 if x is None or x.isascii() else sum(a != b for a, b in zip(x, unicodedata.normalize("NFC", x)))).astype("int32")


def modernise(c: Column, pairs: Sequence[tuple[str, str]] = SPELLING) -> tuple[Column, list[Column]]:
    """Whole words replaced in order, and the count of each replacement."""
    counts = []
    for old, new in pairs:
        pattern = rf"(?U)\b{old}\b"
        counts.append(F.regexp_count(c, F.lit(pattern)))
        c = F.regexp_replace(c, pattern, new)
    return c, counts


def strip_fence(c: Column) -> Column:
    """Without an opening code fence line and a bare closing one."""
    opened = F.regexp_replace(strip(c), r"(?s)^```[^\n]*\n", "")
    return F.when(F.startswith(strip(c), F.lit("```")), F.regexp_replace(opened, r"\n```\s*$", "")).otherwise(c)


def parse_fenced_json(c: Column, schema: str) -> Column:
    return F.from_json(F.regexp_replace(strip(c), r"(?s)^```(?:json)?\s*|\s*```$", ""), schema)


def clean_null(c: Column) -> Column:
    """Null for the words that stand for it."""
    return F.when(~F.lower(c).isin("null", "none", "n/a"), c)


def parse_int(c: Column) -> Column:
    """An integer with white space around it, else null."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def parse_float(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def strip_metadata(c: Column, mode: str = "block") -> Column:
    """What follows prepended metadata.

    ``first_dashes``: after the first ``---`` wherever it stands, so a table is cut at its separator. ``block`` (default): only after
    a line of its own.
    """
    mark = "---" if mode == "first_dashes" else "\n---\n"
    return F.when(F.instr(c, mark) > 0, strip(F.substring(c, F.instr(c, mark) + len(mark), F.length(c)))).otherwise(c)


def session_title(c: Column, size: int = 50) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def word_title(c: Column, size: int = 50) -> Column:
    """Cut at the last blank within ``size`` characters."""
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size), " [^ ]*$", ""), F.lit("..."))).otherwise(c)


def truncate_header(c: Column, category: Column | str = "regulation", size: int = 80) -> Column:
    """Short name of a header: article, chapter, numbered and lettered clause of a regulation; else cut to ``size``."""
    category = F.lit(category) if isinstance(category, str) else category
    cut = F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size), F.lit("...")))
    article, chapter = F.regexp_extract(c, r"(?U)^(Điều\s+\d+)", 1), F.regexp_extract(c, r"(?U)^(CHƯƠNG\s+[IVXLCDM0-9]+)", 1)
    clause, letter = F.regexp_extract(c, r"(?U)^(\d+)\.", 1), F.regexp_extract(c, r"^([a-z])[).]", 1)
    return (
        F.when(category == "curriculum", cut)
        .when(article != "", article)
        .when(chapter != "", chapter)
        .when(clause != "", F.concat(F.lit("Khoản "), clause))
        .when(letter != "", F.concat(F.lit("Mục "), letter))
        .otherwise(cut)
    )


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def title_of(c: Column) -> Column:
    """The first top header of a markdown text, else empty."""
    return strip(F.regexp_extract(c, r"(?m)^# (.*)$", 1))


ACRONYM = r"(?U)\b([A-ZĐÂĂÊÔƠƯa-zđâăêôơư]{2,})\b"


def _candidates(c: Column, known: Column) -> Column:
    """Words that may be acronyms: all upper case, or short, all lower case and known."""
    found = F.regexp_extract_all(c, F.lit(ACRONYM), F.lit(1))
    upper = lambda w: F.upper(w)
    return F.filter(found, lambda w: ((w == upper(w)) & (w != F.lower(w))) | ((w == F.lower(w)) & (F.length(w) <= 5) & F.array_contains(F.map_keys(known), upper(w))))


def expand_acronyms(c: Column, meanings: dict[str, str], partial: bool = True) -> Column:
    """Every known acronym followed by its meaning in brackets; null if some are unknown and ``partial`` is off.

    An acronym is handled once, in the form first met; other spellings by case are replaced by that form too.
    """
    known = F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv])
    found = _candidates(c, known)
    meaning = lambda w: F.try_element_at(known, F.upper(w))
    good = F.filter(found, lambda w: F.coalesce(meaning(w), F.lit("")) != "")
    first = F.filter(good, lambda w, i: (i == 0) | ~F.array_contains(F.transform(F.slice(good, F.lit(1), i), F.upper), F.upper(w)))
    expanded = F.aggregate(
        first,
        c,
        lambda text, w: F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b"), w, F.lit(r"\b")), F.concat(w, F.lit(" ("), meaning(w), F.lit(")"))),
    )
    if partial:
        return expanded
    return F.when(F.size(good) == F.size(found), expanded)


def unknown_acronyms(c: Column, meanings: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(_candidates(c, known), lambda w: ~F.array_contains(F.map_keys(known), F.upper(w)))))

"""Metadata from names and texts: codes, dates, semesters, student ids, cookies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed_values import ANY_YEAR, BARE_STUDENT, INTAKE_YEAR, MAJOR_CODES, NAME_CODE, NAME_DATE, NAMED_STUDENT, SEMESTER, TEXT_CODE
from docloom.functions.text import strip


def regulation_code_of_name(c: Column) -> Column:
    """``n/TYPE-ORG`` after ``__``, or at the start of a name without ``__``; else null."""
    after, start = f"(?i)__{NAME_CODE}", f"(?i)^{NAME_CODE}"
    has_after, has_start = c.rlike(after), (F.instr(c, "__") == 0) & c.rlike(start)
    part = lambda k: F.when(has_after, F.regexp_extract(c, after, k)).otherwise(F.regexp_extract(c, start, k))
    return F.when(has_after | has_start, F.concat(part(1), F.lit("/"), F.upper(part(2)), F.lit("-"), F.upper(part(3))))


def regulation_code_of_text(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, TEXT_CODE, 1), F.lit(""))


def date_of_name(c: Column) -> Column:
    """``YYYY-MM-DD`` of a day-month-year in a name; not checked against a calendar."""
    day, month, year = (F.regexp_extract(c, NAME_DATE, k) for k in (1, 2, 3))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(day != "", F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def year_of_name(c: Column) -> Column:
    return F.substring_index(date_of_name(c), "-", 1).cast("int")


def curriculum_year(name: Column, text: Column) -> Column:
    """Year of an intake from the file name, else the first such in the text's first 8000 characters."""
    return F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")).cast("int") for x, p in ((name, INTAKE_YEAR), (F.substring(text, 1, 8000), ANY_YEAR))])


def major_code(c: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in MAJOR_CODES.items() for x in kv])
    return F.try_element_at(codes, c)


def document_type(c: Column) -> Column:
    return F.when(c == "supplement", "update").otherwise(c)


def semester(c: Column) -> Column:
    n, first, last = (F.regexp_extract(strip(c), SEMESTER, k) for k in (1, 2, 3))
    return F.when(n != "", F.concat(F.lit("HK"), n, F.lit(" năm học "), first, F.lit("-"), last))


def student_id(c: Column) -> Column:
    named, bare = F.regexp_extract(c, NAMED_STUDENT, 1), F.regexp_extract(c, BARE_STUDENT, 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit("")))


def parse_cookies(c: Column) -> Column:
    """Name and value of each ``name=value`` item of a cookie string."""
    items = F.transform(F.split(c, ";"), lambda x: strip(x))
    kept = F.filter(items, lambda x: F.instr(x, "=") > 0)
    return F.transform(kept, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))


def format_cookies(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ")


def context_header(document_id: Column, title: Column, header: Column, category: Column, meta: dict[str, Column], text: Column) -> Column:
    """A text with what is known of its document before it; ``meta`` has effective_date, document_type, major, year, program_type and program_name."""
    from docloom.functions.fixed_values import DOCUMENT_TYPES

    def line(label: str, value: Column, when: Column | None = None) -> Column:
        given = value.isNotNull() & (value.cast("string") != "")
        return F.when(given if when is None else given & when, F.concat(F.lit(f"{label}: "), value.cast("string")))

    names = F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(names, meta["document_type"]), meta["document_type"])
    regulation, curriculum = category == "regulation", category == "curriculum"
    shown = F.initcap(F.replace(F.replace(document_id, F.lit(".md"), F.lit("")), F.lit("-"), F.lit(" ")))
    parts = [
        line("Tài liệu", shown), line("Tiêu đề", title), line("Phần", header, header != "TITLE"),
        line("Ngày hiệu lực", meta["effective_date"], regulation), line("Loại", kind, regulation),
        line("Ngành", meta["major"], curriculum), line("Năm", meta["year"], curriculum), line("Hệ", meta["program_type"], curriculum), line("Chương trình", meta["program_name"], curriculum),
    ]
    head = F.concat_ws("\n", *parts)
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n---\n"), text))

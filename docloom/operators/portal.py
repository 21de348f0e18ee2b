"""Portal pages: HTML tables and schedule cards to rows; grades, averages, exams.

Pages are parsed by the standard library's HTML parser in Arrow batches; all later steps are DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed_values import STUDENT_FIELDS, STUDENT_TABLE
from docloom.functions.metadata import semester
from docloom.functions.text import collapse, parse_float, parse_int


class _Tables(HTMLParser):
    """Tables as rows of cells (text, colspan, rowspan), outer ones first, with their attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            table = {"attrs": a, "rows": [], "text": []}
            self.tables.append(table)
            self.open.append(table)
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            span = lambda k: int(a[k]) if a.get(k, "").isdigit() else 1
            self.open[-1]["rows"][-1].append({"tag": tag, "text": [], "rowspan": span("rowspan"), "colspan": span("colspan")})

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        for t in self.open:
            t["text"].append(data)
            if t["rows"] and t["rows"][-1]:
                t["rows"][-1][-1]["text"].append(data)


def tables_of(page: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return parser.tables


def find_table(page: str | None, keywords: list[str]) -> dict | None:
    """The first table whose text has all keywords, by case-insensitive substring."""
    return next((t for t in tables_of(page) if all(k.lower() in "".join(t["text"]).lower() for k in keywords)), None)


def find_table_by_attributes(page: str | None, attributes: dict[str, str]) -> dict | None:
    """The first table that has all of ``attributes`` with just these values."""
    return next((t for t in tables_of(page) if all(t["attrs"].get(k) == v for k, v in attributes.items())), None)


def table_rows(table: dict | None) -> list[list[str]]:
    """Cell texts by row; the first row goes if there are several; rows without cells go."""
    rows = table["rows"] if table else []
    rows = rows[1:] if len(rows) > 1 else rows
    return [["".join(c["text"]).strip() for c in r] for r in rows if r]


def expanded_rows(table: dict) -> list[list[str]]:
    """All rows with cells repeated over their row and column spans."""
    held: dict[tuple[int, int], str] = {}
    out = []
    for y, row in enumerate(table["rows"]):
        x = 0
        for cell in row:
            while (y, x) in held:
                x += 1
            text = "".join(cell["text"]).strip()
            for dy in range(cell["rowspan"]):
                for dx in range(cell["colspan"]):
                    held[y + dy, x + dx] = text
            x += cell["colspan"]
        width = max((k[1] for k in held if k[0] == y), default=-1) + 1
        out.append([held.get((y, k), "") for k in range(width)])
    return out


def _rows(keywords: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [table_rows(find_table(p.as_py(), keywords)) for p in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], pa.array(rows, pa.list_(pa.list_(pa.string())))], names=[*b.schema.names[:-1], "rows"])

    return run


def html_table_rows(pages: DataFrame, keywords: list[str], key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, rn from 0, cells) of each page's first table with all keywords. Pages without one give no rows."""
    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, page).mapInArrow(_rows(keywords), f"{key} {kind}, rows array<array<string>>")
    return found.select(key, F.posexplode("rows").alias("rn", "cells"))


def html_links(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, n from 0, href) of a page's links, by regular expression."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(page, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("n", "href"))


def _cell(k: int) -> Column:
    return F.get("cells", F.lit(k))


def grade_courses(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Course rows of a grade table (key, rn, cells), each with the semester whose header row came last."""
    is_header = (F.size("cells") == 1) & F.contains(_cell(0), F.lit("Học kỳ")) & ~F.contains(collapse(_cell(0)), F.lit("Trung bình học kỳ"))
    own = Window.partitionBy(key).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    # A header that names no semester ends the one before: the struct is not null even if its name is.
    filled = rows.withColumn("h", F.last(F.when(is_header, F.struct(semester(collapse(_cell(0))).alias("s"))), ignorenulls=True).over(own))
    exempt = F.coalesce(F.contains(F.lower(collapse(_cell(8))), F.lit("miễn")), F.lit(False))
    mark = lambda k: F.when(~exempt, parse_float(_cell(k)))
    return filled.where(~is_header & collapse(_cell(0)).rlike(r"^\d+$")).select(
        key, "rn", F.col("h.s").alias("semester"), parse_int(_cell(0)).alias("stt"), collapse(_cell(1)).alias("course_code"), collapse(_cell(2)).alias("course_name"), F.coalesce(parse_int(_cell(3)), F.lit(0)).alias("credits"),
        mark(4).alias("attendance_score"), mark(5).alias("midterm_score"), mark(6).alias("practice_score"), mark(7).alias("final_score"), mark(8).alias("average_score"), exempt.alias("is_exempt"),
    )


def averages(courses: DataFrame, by: list[str], credits: str = "credits", mark: str = "average_score") -> DataFrame:
    """Credits and credit-weighted averages out of 10 and 4. An average of zero has none out of 4."""
    counts = F.col(mark).isNotNull() & (F.col(credits) > 0)
    exact = F.col(mark).cast("decimal(10,4)")  # decimals: averages don't hang on the order of summing
    summed = courses.groupBy(*by).agg(
        F.sum(credits).alias("total_registered_credits"), F.coalesce(F.sum(F.when(counts, F.col(credits))), F.lit(0)).alias("gpa_credits"), F.sum(F.when(counts, exact * F.col(credits).cast("decimal(10,0)"))).alias("points")
    )
    ten = F.when(F.col("gpa_credits") > 0, F.round(F.col("points") / F.col("gpa_credits").cast("decimal(19,0)"), 2))
    averaged = summed.withColumn("gpa_10", ten).withColumn("gpa_4", F.when(F.col("gpa_10") != 0, F.round(F.col("gpa_10") * F.lit("0.4").cast("decimal(2,1)"), 2)))
    return averaged.withColumn("gpa_10", F.col("gpa_10").cast("double")).withColumn("gpa_4", F.col("gpa_4").cast("double")).drop("points")


def exam_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Exams of an exam table: rows of three cells or more with a number, and a course or a date."""
    given = lambda k: F.when(~collapse(_cell(k)).isin("", "-"), collapse(_cell(k)))
    out = rows.where(F.size("cells") >= 3).select(
        key, "rn", parse_int(_cell(0)).alias("stt"), given(1).alias("course_code"), given(1).alias("course_name"), given(2).alias("class_code"), given(3).alias("exam_period"), given(4).alias("day_of_week"),
        given(5).alias("exam_date"), given(6).alias("room"), given(7).alias("exam_form"),
    )
    return out.where(F.col("stt").isNotNull() & (F.col("course_code").isNotNull() | F.col("exam_date").isNotNull()))


class _Cards(HTMLParser):
    """Schedule cards with their titles, subtitles, kind, and their place in the table around them."""

    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.stack: list[tuple[str, str | None]] = []
        self.card: dict | None = None
        self.rows: list[list[dict]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "").split()
        part = None
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append({"text": [], "rowspan": int(a["rowspan"]) if a.get("rowspan", "").isdigit() else 1})
        if tag == "div" and "tkb-card" in names:
            self.card = {"titles": [], "subs": [], "kind": next((k for k in ("lt", "ht1", "ht2") if k in names), None), "row": len(self.rows) - 1, "column": len(self.rows[-1]) - 1 if self.rows else -1}
            self.cards.append(self.card)
            part = "card"
        elif self.card is not None and any("title" in n for n in names):
            self.card["titles"].append([])
            part = "title"
        elif self.card is not None and any("sub" in n for n in names):
            self.card["subs"].append([])
            part = "sub"
        if tag not in self.VOID:
            self.stack.append((tag, part))

    def handle_endtag(self, tag):
        while self.stack:
            name, part = self.stack.pop()
            if part == "card":
                self.card = None
            if name == tag:
                break

    def handle_data(self, data):
        if self.rows and self.rows[-1]:
            self.rows[-1][-1]["text"].append(data)
        if self.card is not None:
            part = next((p for _, p in reversed(self.stack) if p in ("title", "sub")), None)
            if part:
                self.card[f"{part}s"][-1].append(data)


_DATES = re.compile(r"\d{1,2}/\d{1,2}(?:/\d{2,4})?\s*[,;]\s*\d{1,2}/\d{1,2}")


def schedule_cards(page: str | None) -> list[dict]:
    """Raw cards of a page: code, name, kind, subtitles, day and period by their place in the table."""
    parser = _Cards()
    parser.feed(page or "")
    parser.close()
    text = lambda x: " ".join("".join(x).split())
    head = [text(c["text"]) for c in parser.rows[0]] if parser.rows else []
    out = []
    for card in parser.cards:
        if len(card["titles"]) < 2:
            continue
        code, name, subs = text(card["titles"][0]), text(card["titles"][1]), [text(s) for s in card["subs"]]
        day = period = None
        if not (subs and _DATES.search(subs[0])) and "Đồ án" not in name and card["row"] >= 0:
            row = parser.rows[card["row"]]
            first = re.search(r"Tiết\s*(\d+)", text(row[0]["text"]))
            if first:
                start = int(first[1])
                span = row[card["column"]]["rowspan"]
                period = f"{start}" if span == 1 else f"{start}-{start + span - 1}"
            if 0 <= card["column"] < len(head) and re.match(r"Thứ\s*\d|CN", head[card["column"]]):
                day = head[card["column"]]
        out.append({"code": code, "name": name, "kind": card["kind"], "subs": subs, "day": day, "period": period})
    return out


def _schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("code", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("subs", pa.list_(pa.string())), ("day", pa.string()), ("period", pa.string())]))
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([schedule_cards(p.as_py()) for p in b.column(1)], kind)], names=[b.schema.names[0], "cards"])


def schedule_rows(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Classes of schedule pages, the first of each code and kind."""
    kind = pages.schema[key].dataType.simpleString()
    cards = pages.select(key, page).mapInArrow(_schedule, f"{key} {kind}, cards array<struct<code:string,name:string,kind:string,subs:array<string>,day:string,period:string>>")
    rows = cards.select(key, F.posexplode("cards").alias("n", "c"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(key, "c.code", "c.kind").orderBy("n"))).where("k = 1")
    return first.select(
        key, "n", F.col("c.code").alias("subject_code"), F.col("c.name").alias("subject"), F.col("c.kind").alias("type"), F.get("c.subs", F.lit(0)).alias("date_range"), F.get("c.subs", F.lit(1)).alias("room"), F.col("c.day").alias("day_of_week"), F.col("c.period").alias("period"),
    )


def student_fields(page: str | None) -> dict[str, str | None]:
    """The fields of a page's student table by their places; a field whose row has too few data cells, or whose cell is empty, is null."""
    table = find_table_by_attributes(page, STUDENT_TABLE)
    rows = [[" ".join("".join(c["text"]).split()) or None for c in r if c["tag"] == "td"] for r in (table["rows"] if table else [])]
    return {name: rows[y][x] if y < len(rows) and len(rows[y]) >= least else None for name, (y, x, least) in STUDENT_FIELDS.items()}


def _students(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [student_fields(p.as_py()) for p in b.column(1)]
        yield pa.record_batch([b.column(0), *[pa.array([f[name] for f in found], pa.string()) for name in STUDENT_FIELDS]], names=[b.schema.names[0], *STUDENT_FIELDS])


def student_info(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """The eight fields of each page's student table, one row a page; a page without the table, or a null one, has nulls."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, page).mapInArrow(_students, f"{key} {kind}, " + ", ".join(f"{name} string" for name in STUDENT_FIELDS))

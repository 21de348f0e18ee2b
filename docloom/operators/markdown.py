"""Cleaning and repair of markdown documents.

Per-document rules that look at neighbouring lines work on the line table (:func:`line_table`), a row for each line, by
windows over a document; rules that find a first or last line work on the array of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed_values import CONTENT_END, CONTENT_START, LETTERHEAD, PREAMBLE, TABLE_CAPTION
from docloom.functions.text import let, lines, strip


def _first(array: Column, test) -> Column:
    """Place from 1 of the first element that passes, 0 for none."""
    return F.coalesce(F.array_position(F.transform(array, test), True), F.lit(0)).cast("int")


def remove_letterhead(c: Column) -> Column:
    """Everything before the first content marker goes, if one of the first ten lines is of a letterhead.

    A letterhead without a marker leaves an empty text; no letterhead leaves the text as it is.
    """
    head, start = "(?iu)" + "|".join(LETTERHEAD), "(?iu)" + CONTENT_START

    def cut(line: Column) -> Column:
        has_head = F.exists(F.slice(line, 1, 10), lambda x: strip(x).rlike(head))
        kept = lambda at: F.when(at > 0, strip(F.array_join(F.slice(line, F.greatest(at, F.lit(1)), F.size(line)), "\n"))).otherwise("")
        return F.when(has_head, let(_first(line, lambda x: strip(x).rlike(start)), kept)).otherwise(c)

    return let(lines(c), cut)


def main_content(c: Column, ends: list[str] = CONTENT_END) -> Column:
    """From the first top header to before the first later line with an end text, without blank lines; empty if there is no header."""
    has_end = lambda x: F.exists(F.array(*map(F.lit, ends)), lambda e: F.contains(x, e))

    def before_end(body: Column) -> Column:
        end = _first(F.slice(body, 2, F.greatest(F.size(body), F.lit(1))), has_end)
        kept = lambda n: F.when(n > 0, F.slice(body, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(body)
        return strip(F.array_join(F.filter(let(end, kept), lambda x: x != ""), "\n"))

    def from_header(line: Column) -> Column:
        at = _first(line, lambda x: F.startswith(x, F.lit("# ")))
        return let(at, lambda n: F.when(n > 0, let(F.slice(line, F.greatest(n, F.lit(1)), F.size(line)), before_end)).otherwise(""))

    return let(F.transform(lines(c), lambda x: strip(x)), from_header)


def clean(c: Column, category: Column) -> Column:
    """Regulations and curricula are cleaned; other categories pass through."""
    return F.when(category.isin("regulation", "curriculum"), main_content(remove_letterhead(c))).otherwise(c)


def preprocess(c: Column) -> Column:
    """Without empty headers; headers that are list items become list items."""
    kept = F.filter(lines(c), lambda x: ~x.rlike(r"^#{1,6}\s*$"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"^#{1,6}\s*(-|\*)\s+(.+)", "$1 $2")), "\n")


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """A row for each line: the key, ``ln`` from 0, ``line``."""
    return docs.select(key, *keep, F.posexplode(lines(F.col(text))).alias("ln", "line"))


def join_lines(table: DataFrame, key: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """Documents of a line table, their lines in order; null lines are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(line).isNotNull(), F.struct("ln", F.col(line).alias("x")))))
    return table.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n").alias(text))


_SEPARATOR = r"^[\s|:-]+$"


def blank_before_tables(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """A blank line before a table's first line unless there is one."""
    own = Window.partitionBy(key).orderBy("ln")
    before, after = F.lag("line").over(own), F.lead("line").over(own)
    starts = (F.instr("line", "|") > 0) & after.rlike(_SEPARATOR) & (F.instr(after, "-") > 0)
    wanted = before.isNotNull() & (strip(before) != "") & ~before.rlike(_SEPARATOR)
    return table.withColumn("line", F.when(F.coalesce(starts & wanted, F.lit(False)), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line")))


_ARTICLE, _CHAPTER = r"(?U)^(?:\*\*)?Điều\s+\d+", r"(?U)^CHƯƠNG\s+[IVXLCDM0-9]+"


def heading_levels(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chapters, articles, numbered and lettered clauses as headers of level 1 to 4.

    Clauses become headers only where one of their article (letters: of their clause) has ten words or more; then all of them
    do. Bold articles lose their stars. Other lines and those that are headers already stay.
    """
    own = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    s = strip(F.col("line"))
    plain = ~F.startswith(s, F.lit("#"))
    article, chapter = s.rlike(r"(?U)^(?:#+\s*)?(?:\*\*)?Điều\s+\d+") & True, plain & s.rlike(_CHAPTER)
    number, letter = plain & s.rlike(r"^\d+\.\s"), plain & s.rlike(r"^[a-zđ][.)]\s")
    marked = table.withColumn("s", s).withColumn("article_no", F.sum(article.cast("int")).over(own))
    marked = marked.withColumn("clause_no", F.sum((number | article).cast("int")).over(own))
    many = F.size(F.split("s", r"\s+")) >= 10
    by_article, by_clause = Window.partitionBy(key, "article_no"), Window.partitionBy(key, "article_no", "clause_no")
    long_number = F.max((number & many).cast("int")).over(by_article) == 1
    long_letter = F.max((letter & many).cast("int")).over(by_clause) == 1
    line = (
        F.when(chapter, F.concat(F.lit("# "), s))
        .when(plain & article, F.concat(F.lit("## "), F.regexp_replace(s, r"\*\*", "")))
        .when(number & long_number, F.concat(F.lit("### "), s))
        .when(letter & long_letter, F.concat(F.lit("#### "), s))
        .otherwise(F.col("line"))
    )
    return marked.withColumn("line", line).drop("s", "article_no", "clause_no")


def table_levels(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Captions of tables as headers by their place: level 4 after a clause, 3 after an article, 2 where neither is open. Blank lines go.

    A caption is the line right above a run of table lines that starts with the word for tables. Articles and clauses are those that
    :func:`heading_levels` has marked; a chapter or another header of the first two levels closes them. Before the first article or chapter, the first
    line of each run of preamble lines of one kind becomes a header of level 2.
    """
    own = Window.partitionBy(key).orderBy("ln")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    s = strip(F.col("line"))
    filled = table.withColumn("s", s).where(F.col("s") != "")
    bar = F.startswith("s", F.lit("|")) | F.startswith(F.lower("s"), F.lit("<table"))
    article, chapter = F.col("s").rlike(r"(?U)^##\s+Điều\s+\d+"), F.col("s").rlike(r"(?U)^#\s+CHƯƠNG\s")
    opened = F.when(article, 3).when(F.col("s").rlike(r"^###\s+\d+\.\s|^####\s+[a-zđ][.)]\s"), 4).when(F.col("s").rlike(r"^##?\s"), 2)
    plain = ~F.startswith("s", F.lit("#")) & ~bar
    kind = F.when(plain, F.regexp_extract("s", rf"^(?:\*\*)?({'|'.join(PREAMBLE)})", 1))
    marked = filled.withColumns({
        "caption": ~bar & F.col("s").rlike(rf"(?U)^(#+\s*)?(\*\*)?{TABLE_CAPTION}(\s|$)") & F.coalesce(F.lead(bar).over(own), F.lit(False)),
        "open": opened, "kind": F.nullif(kind, F.lit("")), "body": F.max((article | chapter).cast("int")).over(so_far) == 1,
    })
    # A caption that is a header already doesn't close what it belongs to.
    level = F.coalesce(F.last(F.when(~F.col("caption"), F.col("open")), ignorenulls=True).over(so_far), F.lit(2))
    first = F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.lag("kind").over(own)) & ~F.col("body")
    bare = F.regexp_replace(F.regexp_replace("s", r"^#+\s*", ""), r"\*\*", "")
    line = F.when(F.col("caption"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), bare)).when(first, F.concat(F.lit("## "), bare)).otherwise(F.col("line"))
    return marked.withColumn("line", line).drop("s", "caption", "open", "kind", "body")


def chapter_titles(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """A chapter header and the header right after it in one, upper-cased."""
    own = Window.partitionBy(key).orderBy("ln")
    filled = table.where(strip(F.col("line")) != "")
    after, before = F.lead("line").over(own), F.lag("line").over(own)
    chapter = lambda c: c.rlike(r"(?U)^#\s*CHƯƠNG\s+[IVXLCDM0-9]+\s*$")
    title = lambda c: c.rlike(r"^#{1,2}\s") & ~c.rlike(r"(?U)^#+\s*(CHƯƠNG|Điều)\s")
    joined = F.upper(F.concat(F.col("line"), F.lit(" - "), F.regexp_replace(after, r"^#+\s*", "")))
    out = filled.select(
        key, "ln", F.when(chapter(F.col("line")) & title(after), joined).when(title(F.col("line")) & chapter(before), F.lit(None)).otherwise(F.col("line")).alias("line")
    )
    return out.where(F.col("line").isNotNull())


def title_block(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Several top headers at a document's start, blank lines apart, as one upper-cased header."""
    own = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    filled = table.where(strip(F.col("line")) != "")
    head = F.col("line").rlike(r"^#\s") & ~F.col("line").rlike(r"(?U)^#\s*CHƯƠNG\s")
    led = filled.withColumn("led", F.min(head.cast("int")).over(own) == 1)
    joined = F.upper(F.concat(F.lit("# "), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("led"), F.struct("ln", "line"))).over(Window.partitionBy(key))), lambda s: F.regexp_replace(s["line"], r"^#\s*", "")), " ")))
    first = F.col("ln") == F.min("ln").over(Window.partitionBy(key))
    said = led.withColumn("line", F.when(F.col("led"), F.when(first, joined)).otherwise(F.col("line")))
    return said.where(F.col("line").isNotNull()).drop("led")


def tidy(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without empty headers and without a rule right after a rule, blank lines apart."""
    own = Window.partitionBy(key).orderBy("ln")
    kept = table.where(~F.col("line").rlike(r"^#{1,6}\s*$") & (strip(F.col("line")) != ""))
    rule = lambda c: c.rlike(r"^\s*---+\s*$")
    return kept.withColumn("again", rule(F.col("line")) & F.coalesce(rule(F.lag("line").over(own)), F.lit(False))).where(~F.col("again")).drop("again")


def curriculum_lines(c: Column) -> Column:
    """Linked section titles and bold sub-headings as headers, dashes of lists as hyphens; one line."""
    number = F.regexp_extract(c, r"^\s*\[((?:\d+\.)*\d+)\.?\s+[^\]]*\]\([^)]*\)\s*$", 1)
    title = F.regexp_extract(c, r"^\s*\[([^\]]*)\]\([^)]*\)\s*$", 1)
    level = F.least(F.lit(6), F.size(F.split(number, r"\.")))
    bold = F.regexp_extract(c, r"^\s*\*\*((?:Về|Nhóm)\s[^*]*?):?\*\*:?\s*$", 1)
    return (
        F.when(number != "", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title))
        .when(bold != "", F.concat(F.lit("### "), bold))
        .otherwise(F.regexp_replace(c, r"^(\s*)‒", "$1-"))
    )


def complete_rows(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Table rows with as many cells as their header row, and merged cells (a row that starts with a bar) filled from above.

    A header line within a table becomes a bold row. Tables are runs of lines with a bar whose second line is a separator.
    """
    own = Window.partitionBy(key).orderBy("ln")
    s = strip(F.col("line"))
    bar = (F.instr("line", "|") > 0) | s.rlike(r"^#{1,6}\s")
    flagged = table.withColumn("bar", bar).withColumn("new", (F.col("bar") & ~F.coalesce(F.lag(bar).over(own), F.lit(False))).cast("int"))
    flagged = flagged.withColumn("run", F.when(F.col("bar"), F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))))
    by = Window.partitionBy(key, "run")
    separator = s.rlike(_SEPARATOR) & (F.instr(s, "-") > 0) & (F.instr(s, "|") > 0)
    at = F.min(F.when(separator, F.col("ln"))).over(by)
    width = F.max(F.when(F.col("ln") == at - 1, F.size(F.split(F.regexp_replace(s, r"^\||\|$", ""), r"\|")))).over(by)
    flagged = flagged.withColumn("at", at).withColumn("width", width)
    body = F.col("bar") & (F.col("ln") > F.col("at")) & F.col("width").isNotNull()
    bold = F.concat(F.lit("**"), F.regexp_replace(s, r"^#{1,6}\s+", ""), F.lit("**"))
    cells = F.transform(F.split(F.when(s.rlike(r"^#{1,6}\s"), bold).otherwise(F.regexp_replace(s, r"^\||\|$", "")), r"\|"), lambda x: strip(x))
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("width") - F.size(cells))))
    flagged = flagged.withColumn("cells", F.when(body, padded)).withColumn("first", F.when(body & (F.get("cells", F.lit(0)) != ""), F.get("cells", F.lit(0))))
    above = F.last("first", ignorenulls=True).over(Window.partitionBy(key, "run").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))
    merged = F.when(F.get("cells", F.lit(0)) == "", F.concat(F.array(F.coalesce(above, F.lit(""))), F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))))).otherwise(F.col("cells"))
    line = F.when(body, F.concat(F.lit("| "), F.array_join(merged, " | "), F.lit(" |"))).otherwise(F.col("line"))
    return flagged.select(key, "ln", line.alias("line"))


def flatten_rows(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each data row of the tables in a line table as one bullet of ``header: cell`` pairs: key, ln, text."""
    s = F.regexp_replace(strip(F.col("line")), r"^\||\|$", "")
    own = Window.partitionBy(key).orderBy("ln")
    is_separator = s.rlike(_SEPARATOR) & (F.instr(s, "-") > 0) & (F.instr("line", "|") > 0)
    flagged = table.withColumn("cells", F.transform(F.split(s, r"\|"), lambda x: strip(x))).withColumn("sep", is_separator).withColumn("has", F.instr("line", "|") > 0)
    head = F.when(F.lead("sep").over(own), F.col("cells"))
    flagged = flagged.withColumn("head", head)
    held = flagged.withColumn("headers", F.last("head", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = held.where(F.col("has") & ~F.col("sep") & F.col("head").isNull() & F.col("headers").isNotNull())
    pairs = F.zip_with("headers", "cells", lambda h, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws(": ", h, c)))
    return rows.select(key, "ln", F.concat(F.lit("- "), F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "; ")).alias("text"))

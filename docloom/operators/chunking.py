"""Chunks of markdown documents by headers and tables, all by windows over the line table.

A header line starts a chunk. A header is on the stack of a line if no header of a smaller level came after it, which two
running maxima for each level tell; the last one alive is the chunk's own header, the others are its ancestors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed_values import GROUP_ROWS, SECTION_MARKERS, SPECIAL_SECTIONS, TABLE_TYPES
from docloom.functions.text import let, strip, truncate_header, words
from docloom.operators.markdown import line_table, preprocess

LEVELS = 6
HEADER = r"^(#{1,6})\s+(.+)"


def header_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", max_level: int = 3, category: str = "regulation", first_line_markers: bool = True) -> DataFrame:
    """Chunks of documents: key, chunk_no, level, header, full_header, ancestors, full_ancestors, text.

    Headers deeper than ``max_level`` are body. Lines before the first header are a chunk with no header, of level 0. With
    ``first_line_markers`` an unmarked chapter or article on a document's first line counts as a header of level 2.
    Curricula take ``category="curriculum"`` and ``max_level=6``: their headers aren't shortened.
    """
    table = line_table(docs.select(key, preprocess(F.col(text)).alias("__t")), key, "__t")
    own = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.length(F.regexp_extract("line", HEADER, 1))
    marker = (F.col("ln") == 0) & strip(F.col("line")).rlike("(?U)" + "|".join(SECTION_MARKERS)) if first_line_markers else F.lit(False)
    level = F.when((depth > 0) & (depth <= max_level), depth).when(marker & (depth == 0), F.lit(2))
    said = F.when(depth > 0, strip(F.regexp_extract("line", HEADER, 2))).otherwise(strip(F.col("line")))
    marked = table.withColumn("lvl", level).withColumn("said", F.when(F.col("lvl").isNotNull(), said)).withColumn("chunk_no", F.sum(F.col("lvl").isNotNull().cast("int")).over(own))
    short = F.when(F.col("lvl").isNotNull(), truncate_header(F.col("said"), category))
    marked = marked.withColumn("short", short)
    alive = []
    for k in range(1, max_level + 1):
        at = F.max(F.when(F.col("lvl") == k, F.col("ln"))).over(own)
        killed = F.max(F.when(F.col("lvl") < k, F.col("ln"))).over(own)
        names = F.last(F.when(F.col("lvl") == k, F.struct("short", "said")), ignorenulls=True).over(own)
        alive.append(F.when(at.isNotNull() & (killed.isNull() | (at > killed)), names))
    # All windows share one order, and the chunks are groups within a document: one shuffle by document serves the whole plan.
    stacked = marked.withColumn("stack", F.when(F.col("lvl").isNotNull(), F.filter(F.array(*alive), lambda x: x.isNotNull())))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda s: s["line"]), "\n")
    chunks = stacked.groupBy(key, "chunk_no").agg(listed.alias("text"), F.first("stack", ignorenulls=True).alias("stack"), F.max("lvl").alias("level"))
    above = F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    return chunks.select(
        key, F.col("chunk_no").cast("int").alias("chunk_no"), F.coalesce("level", F.lit(0)).alias("level"), F.element_at("stack.short", -1).alias("header"), F.element_at("stack.said", -1).alias("full_header"),
        F.coalesce(F.transform(above, lambda x: x["short"]), none).alias("ancestors"), F.coalesce(F.transform(above, lambda x: x["said"]), none).alias("full_ancestors"), "text",
    )


def hierarchy(ancestors: Column, header: Column) -> Column:
    return F.concat_ws(" > ", ancestors, header)


def clause_context(chunks: DataFrame) -> DataFrame:
    """A numbered clause's text after the full name of its article."""
    article = F.get(F.filter("full_ancestors", lambda x: x.rlike(r"(?U)^Điều\s+\d+")), F.lit(0))
    wanted = F.col("header").rlike(r"(?U)^Khoản\s+\d+") & article.isNotNull()
    return chunks.withColumn("text", F.when(wanted, F.concat(F.lit("## "), article, F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


def title_context(text: Column, title: Column) -> Column:
    return F.when(F.coalesce(strip(title), F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), text)).otherwise(text)


def merge_titles(chunks: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """The short title chunks at a document's start as one.

    They are the longest run, of up to ``most``, of chunks that name no special section and have fewer than three plain lines with fewer
    than 150 characters. A run of one stays as it is.
    """
    plain = F.filter(F.transform(F.split("text", "\n"), lambda x: strip(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    special = sum((F.contains(F.upper(F.coalesce("header", F.lit(""))), F.lit(s)).cast("int") for s in SPECIAL_SECTIONS), F.lit(0)) > 0
    fits = ~special & (F.length(F.array_join(plain, "\n")) < 150) & (F.size(plain) < 3)
    own, whole = Window.partitionBy(key).orderBy("chunk_no"), Window.partitionBy(key)
    placed = chunks.withColumn("idx", F.row_number().over(own) - 1).withColumn("fits", fits & (F.col("idx") < most))
    placed = placed.withColumn("run", F.coalesce(F.min(F.when(~F.col("fits"), F.col("idx"))).over(whole), F.count("*").over(whole)))
    merging = (F.col("run") >= 2) & (F.col("idx") < F.col("run"))
    parts = placed.withColumn("slot", F.when(merging, F.lit(0)).otherwise(F.col("idx"))).withColumn("merged", merging)
    order = F.array_sort(F.collect_list(F.struct("idx", "header", "full_header", "text", "level", "ancestors", "full_ancestors")))
    grouped = parts.groupBy(key, "slot", "merged").agg(order.alias("o"))
    named = F.array_join(F.filter(F.transform("o", lambda x: x["header"]), lambda x: x.isNotNull()), " ")
    one = F.get("o", F.lit(0))
    none = F.array().cast("array<string>")
    out = grouped.select(
        key, "slot", "merged", F.when(F.col("merged"), F.lit(0)).otherwise(one["level"]).alias("level"),
        F.when(F.col("merged"), F.coalesce(F.nullif(named, F.lit("")), F.lit("TITLE"))).otherwise(one["header"]).alias("header"),
        F.when(F.col("merged"), F.lit(None)).otherwise(one["full_header"]).alias("full_header"),
        F.when(F.col("merged"), none).otherwise(one["ancestors"]).alias("ancestors"), F.when(F.col("merged"), none).otherwise(one["full_ancestors"]).alias("full_ancestors"),
        F.array_join(F.transform("o", lambda x: x["text"]), "\n").alias("text"), F.when(F.col("merged"), F.size("o")).otherwise(F.lit(0)).alias("titles_merged"),
    )
    return out.withColumn("chunk_no", (F.row_number().over(Window.partitionBy(key).orderBy("slot")) - 1).cast("int")).drop("slot", "merged")


def has_table(c: Column) -> Column:
    return c.rlike(r"\|?\s*---+\s*\|")


def table_type(header: Column) -> Column:
    out = F.lit("unknown")
    for name, kind in reversed(TABLE_TYPES):
        out = F.when(F.contains(F.upper(header), F.lit(name)), kind).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def group_chunks(chunks: DataFrame, keys: list[str], kind: str, group_rows: str | None = None, header_word: str | None = None) -> DataFrame:
    """A chunk for each group row of a table (``kind``: plo or study_plan): keys, group_no, header, text.

    A group has the table's header and separator before its rows. Rows before the first group go; a table without groups
    gives one row, group 0, with its whole text and no header.
    """
    group_rows = group_rows or GROUP_ROWS[kind]
    header_word = header_word if header_word is not None else ("Mã" if kind == "study_plan" else "")
    table = chunks.select(*keys, F.col("text").alias("whole"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    by = Window.partitionBy(*keys)
    own = by.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    separates = F.contains("line", F.lit("---|")) | F.contains("line", F.lit("|---"))
    at = F.min(F.when(separates, F.col("ln"))).over(by)
    head = F.contains("line", F.lit("|")) & F.contains("line", F.lit(header_word)) & ~separates & (F.col("at").isNull() | (F.col("ln") < F.col("at")))
    marked = table.withColumn("at", at).withColumn("is_head", head).withColumn("is_sep", F.coalesce(F.col("ln") == F.col("at"), F.lit(False)))
    group = F.col("line").rlike("(?u)" + group_rows) & ~F.col("is_head") & ~F.col("is_sep")
    marked = marked.withColumn("group_no", F.sum(group.cast("int")).over(own))
    marked = marked.withColumn("head_line", F.max_by("line", F.when(F.col("is_head"), F.col("ln"))).over(by)).withColumn("sep_line", F.max(F.when(F.col("is_sep"), F.col("line"))).over(by))
    marked = marked.withColumn("groups", F.max("group_no").over(by))
    rows = marked.where((F.col("group_no") > 0) & ~F.col("is_head") & ~F.col("is_sep"))
    listed = F.array_sort(F.collect_list(F.struct("ln", "line")))
    grouped = rows.groupBy(*keys, "group_no").agg(listed.alias("o"), F.first("head_line").alias("h"), F.first("sep_line").alias("s"))
    found = grouped.select(*keys, F.col("group_no").cast("int").alias("group_no"), strip(F.get("o", F.lit(0))["line"]).alias("header"), F.concat_ws("\n", "h", "s", F.array_join(F.transform("o", lambda x: x["line"]), "\n")).alias("text"))
    alone = marked.where((F.col("groups") == 0) & (F.col("ln") == 0)).select(*keys, F.lit(0).alias("group_no"), F.lit(None).cast("string").alias("header"), F.col("whole").alias("text"))
    return found.unionByName(alone)


def row_chunks(chunks: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    """Tables of more than ``most`` lines cut into groups of that many data rows, each after the header and separator.

    Columns: keys, part, header (``Rows a-b``), text. A smaller table is one part, its whole text, with no header. Lines without a bar are lost when a
    table is cut.
    """
    split = chunks.withColumn("rows", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))))
    small = split.where(F.size("rows") <= most).select(*keys, F.lit(0).alias("part"), F.lit(None).cast("string").alias("header"), "text")
    data = F.size("rows") - 2
    large = split.where(F.size("rows") > most).select(*keys, "rows", F.explode(F.sequence(F.lit(0), F.ceil(data / most).cast("int") - 1)).alias("part"))
    first, last = F.col("part") * most + 1, F.least((F.col("part") + 1) * most, data)
    cut = F.concat(F.slice("rows", 1, 2), F.slice("rows", first + 2, F.lit(most)))
    large = large.select(*keys, "part", F.concat(F.lit("Rows "), first.cast("string"), F.lit("-"), last.cast("string")).alias("header"), F.array_join(cut, "\n").alias("text"))
    return small.unionByName(large)


def sub_chunks(docs: DataFrame, keys: list[str], text: str = "text", limit: int = 8000, size: int = 1024, overlap: int = 200, split: Callable[[Column], Column] = words) -> DataFrame:
    """Texts over ``limit`` tokens in overlapping parts of ``size`` tokens, each after the context before the first rule line.

    Columns: keys, sub_no, sub_total, tokens, text. Tokens are what ``split`` makes of a text (an array of strings), words between white
    space unless told otherwise; the tokens of a part are joined by blanks.
    """
    whole = docs.select(*keys, F.col(text).alias("__t"), split(F.col(text)).alias("w"))
    small = whole.where(F.size("w") <= limit).select(*keys, F.lit(0).alias("sub_no"), F.lit(1).alias("sub_total"), F.size("w").alias("tokens"), F.col("__t").alias("text"))
    at = F.instr("__t", "\n---\n")
    large = whole.where(F.size("w") > limit).select(
        *keys, F.when(at > 0, F.substring(F.col("__t"), F.lit(1), at - 1)).alias("context"), split(F.when(at > 0, F.substring(F.col("__t"), at + 5, F.length("__t"))).otherwise(F.col("__t"))).alias("w")
    )
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step).cast("int"))
    parts = large.select(*keys, "context", "w", count.alias("sub_total"), F.explode(F.sequence(F.lit(0), count - 1)).alias("sub_no"))
    part = F.slice("w", F.col("sub_no") * step + 1, F.lit(size))
    return small.unionByName(parts.select(*keys, "sub_no", "sub_total", F.size(part).alias("tokens"), F.concat_ws("\n", "context", F.array_join(part, " ")).alias("text")))


#: A sentence ends after its last mark and the white space there, or at a blank line; U+001E marks the ends.
SENTENCE_END = r"([.!?\u2026]+[\"'\u201d\u2019)\]]*[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*)"


def sentences(text: Column) -> Column:
    """The sentences of a text, each with the white space after it, so that they join to the text again (but for U+001E, which ends one)."""
    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, "$1\u001e"), "\u001e"), lambda s: s != "")


def _pieces(text: Column, size: int, split: Callable[[Column], Column]) -> Column:
    """Sentences as (n tokens, text); one of more than ``size`` tokens is cut into parts of that many, joined by blanks."""

    def cut(s: Column) -> Column:
        part = lambda w: lambda k: F.struct(F.size(F.slice(w, k * size + 1, F.lit(size))).alias("n"), F.concat(F.array_join(F.slice(w, k * size + 1, F.lit(size)), " "), F.lit(" ")).alias("s"))
        return let(split(s), lambda w: F.when(F.size(w) > size, F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / size).cast("int") - 1), part(w))).otherwise(F.array(F.struct(F.size(w).alias("n"), s.alias("s")))))

    return F.flatten(F.transform(sentences(text), cut))


def _spans(counts: Column, size: int, overlap: int) -> Column:
    """(start, stop, tokens) of greedy chunks over token counts: a fold that keeps the counts of the open chunk.

    A count that doesn't fit closes the chunk; the next one starts with as many of its last counts as ``overlap`` and the new count leave room for.
    """
    span = "array<struct<start:int,stop:int,tokens:int>>"
    zero = F.struct(F.array().cast(span).alias("out"), F.lit(0).alias("start"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("open"), F.lit(0).alias("used"))

    def step(acc: Column, t: Column) -> Column:
        fits = (acc["used"] + t <= size) | (acc["i"] == acc["start"])
        room = F.least(F.lit(overlap), F.lit(size) - t)
        # From the front of the open chunk goes what is more than there is room for.
        kept = F.aggregate(acc["open"], F.struct(acc["used"].alias("left"), F.lit(0).alias("gone")), lambda a, x: F.when(a["left"] > room, F.struct((a["left"] - x).alias("left"), (a["gone"] + 1).alias("gone"))).otherwise(a))
        more = F.struct(acc["out"].alias("out"), acc["start"].alias("start"), (acc["i"] + 1).alias("i"), F.concat(acc["open"], F.array(t)).alias("open"), (acc["used"] + t).alias("used"))
        closed = F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["i"].alias("stop"), acc["used"].alias("tokens"))))
        new = let(
            kept,
            lambda k: F.struct(closed.alias("out"), (acc["start"] + k["gone"]).alias("start"), (acc["i"] + 1).alias("i"), F.concat(F.slice(acc["open"], k["gone"] + 1, F.size(acc["open"])), F.array(t)).alias("open"), (k["left"] + t).alias("used")),
        )
        return F.when(fits, more).otherwise(new)

    last = lambda acc: F.when(acc["i"] > acc["start"], F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["i"].alias("stop"), acc["used"].alias("tokens"))))).otherwise(acc["out"])
    return F.aggregate(counts, zero, step, last)


def sentence_chunks(docs: DataFrame, keys: list[str], text: str = "text", limit: int = 8000, size: int = 1024, overlap: int = 200, split: Callable[[Column], Column] = words) -> DataFrame:
    """Texts over ``limit`` tokens in chunks of whole sentences, each after the context before the first rule line.

    Columns: keys, sub_no, sub_total, tokens, text. Sentences are packed greedily up to ``size`` tokens, and a chunk starts with the sentences at the end of the
    one before that have ``overlap`` tokens at most. A sentence over ``size`` is cut at tokens. Tokens are what ``split`` makes of a text. A text without
    tokens after its rule line is one chunk; a null one is none. A text is one row all the way, so its chunks cost by its own length.
    """
    whole = docs.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("t"), F.size(split(F.col(text))).alias("n"))
    small = whole.where(F.col("n") <= limit).select(*keys, F.lit(0).alias("sub_no"), F.lit(1).alias("sub_total"), F.col("n").alias("tokens"), F.col("t").alias("text"))
    at = F.instr("t", "\n---\n")
    large = whole.where(F.col("n") > limit).select(*keys, F.when(at > 0, F.substring(F.col("t"), F.lit(1), at - 1)).alias("context"), F.when(at > 0, F.substring(F.col("t"), at + 5, F.length("t"))).otherwise(F.col("t")).alias("body"))
    cut = large.select(*keys, "context", _pieces(F.col("body"), size, split).alias("p")).withColumn("spans", _spans(F.col("p.n"), size, overlap))
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).alias("tokens")))
    spans = F.when(F.size("spans") > 0, F.col("spans")).otherwise(none)
    parts = cut.select(*keys, "context", "p", F.size(spans).alias("sub_total"), F.posexplode(spans).alias("sub_no", "c"))
    body = strip(F.array_join(F.slice(F.col("p.s"), F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")), ""))
    return small.unionByName(parts.select(*keys, "sub_no", "sub_total", F.col("c.tokens").alias("tokens"), F.concat_ws("\n", "context", body).alias("text")))


def chunk_id(document_id: Column, chunk_no: Column, sub_no: Column) -> Column:
    return F.sha2(F.concat_ws("|", document_id.cast("string"), chunk_no.cast("string"), F.coalesce(sub_no, F.lit(-1)).cast("string")), 256)


def splitter_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks, headed chunks, chunks with a table and words by document."""
    return chunks.groupBy(key).agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("header").isNotNull()).alias("headed_chunks"), F.count_if(has_table(F.col("text"))).alias("tables_detected"), F.sum(F.size(words(F.col("text")))).alias("words")
    )


def splitting_report(chunks: DataFrame, merged: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The seven figures of splitting a document: total_chunks, large_chunks_split, final_nodes, title_chunks_merged, patterns_detected, tables_detected, table_chunks_created.

    ``chunks`` are those by headers; ``merged`` has ``titles_merged`` (see :func:`merge_titles`); ``nodes`` are the final ones, with ``chunk_no``, ``sub_total`` and ``kind``
    (``table`` for parts of tables). Patterns are sections that only their wording, not a header mark, told. Documents are those of ``chunks``.
    """
    bare = F.split_part("text", F.lit("\n"), F.lit(1)).rlike("(?U)" + "|".join(SECTION_MARKERS)) & ~F.startswith("text", F.lit("#"))
    base = chunks.groupBy(key).agg(F.count("*").alias("total_chunks"), F.count_if(F.col("header").isNotNull() & bare).alias("patterns_detected"), F.count_if(has_table(F.col("text"))).alias("tables_detected"))
    titles = merged.groupBy(key).agg(F.sum("titles_merged").cast("long").alias("title_chunks_merged"))
    final = nodes.groupBy(key).agg(F.count("*").alias("final_nodes"), F.count_if(F.col("kind") == "table").alias("table_chunks_created"), F.count_distinct(F.when(F.col("sub_total") > 1, F.col("chunk_no"))).alias("large_chunks_split"))
    names = ["total_chunks", "large_chunks_split", "final_nodes", "title_chunks_merged", "patterns_detected", "tables_detected", "table_chunks_created"]
    return base.join(titles, key, "left").join(final, key, "left").select(key, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def flatten_html_tables(docs: DataFrame, render: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every plain ``<table>`` of a text replaced by sentences of its rows, header cells before data cells.

    A replacement under ten characters leaves the table as it is.
    """
    pattern = r"(?s)<table>.*?</table>"

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
        return F.transform(found, lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " ")))

    def flat(table: Column) -> Column:
        rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)
        head = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
        body = F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
        sentence = lambda r: F.concat(F.lit("- "), F.array_join(F.filter(F.zip_with(head, r, lambda h, c: F.when(c != "", F.concat_ws(": ", h, c))), lambda x: x.isNotNull()), "; "))
        said = F.array_join(F.transform(body, sentence), "\n")
        return F.when(F.length(said) >= 10, said).otherwise(table)

    tables = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform(tables, flat), lambda a, b: F.array_compact(F.array(a, b)))), "")
    return docs.withColumn(text, F.when(F.size(tables) > 0, joined).otherwise(F.col(text)))

"""Queries of the chunkers, over markdown derived from ``documents`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import chunking, markdown
from docloom.plans.query import Query, read


def _md() -> Column:
    """Headers whose levels vary by document before its text."""
    k, n = F.col("doc_id") % 5, F.lit("\n")
    one, two = F.concat(F.lit("# "), F.col("source")), F.concat(F.lit("## Điều "), F.col("doc_id"), F.lit(". "), F.col("lang"))
    three, four = F.concat(F.lit("### 1. "), F.substring(F.translate("text", "\n", " "), 1, 60)), F.lit("#### a. deep")
    return (
        F.when(k == 0, F.concat(one, n, two, n, three, n, F.col("text")))
        .when(k == 1, F.concat(F.lit("before\n"), three, n, four, n, one, n, F.col("text"), n, two))
        .when(k == 2, F.concat(F.lit("Điều 7. first\nbody\n"), two, n, three, n, two, n, F.lit("## \n# - item\n"), F.col("text")))
        .when(k == 3, F.concat(one, n, three, n, F.col("text"), n, two, n, F.lit("x\n"), one, n, F.lit("y")))
        .otherwise(F.col("text"))
    )


MD = r"""(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN one || chr(10) || two || chr(10) || three || chr(10) || text
WHEN 1 THEN 'before' || chr(10) || three || chr(10) || '#### a. deep' || chr(10) || one || chr(10) || text || chr(10) || two
WHEN 2 THEN 'Điều 7. first' || chr(10) || 'body' || chr(10) || two || chr(10) || three || chr(10) || two || chr(10) || '## ' || chr(10) || '# - item' || chr(10) || text
WHEN 3 THEN one || chr(10) || three || chr(10) || text || chr(10) || two || chr(10) || 'x' || chr(10) || one || chr(10) || 'y' ELSE text END AS md
FROM (SELECT doc_id, text, '# ' || source AS one, '## Điều ' || doc_id || '. ' || lang AS two, '### 1. ' || substring(replace(text, chr(10), ' '), 1, 60) AS three FROM documents))"""

SHORT = r"""CASE WHEN regexp_matches(said, '^Điều\s+\d+') THEN regexp_extract(said, '^(Điều\s+\d+)', 1) WHEN regexp_matches(said, '^CHƯƠNG\s+[IVXLCDM0-9]+') THEN regexp_extract(said, '^(CHƯƠNG\s+[IVXLCDM0-9]+)', 1)
WHEN regexp_matches(said, '^\d+\.') THEN 'Khoản ' || regexp_extract(said, '^(\d+)\.', 1) WHEN regexp_matches(said, '^[a-z][).]') THEN 'Mục ' || said[1] WHEN length(said) > 80 THEN said[1:80] || '...' ELSE said END"""

CHUNKS = rf"""md AS {MD},
p AS (SELECT doc_id, list_transform(list_filter(string_split(md, chr(10)), lambda x: NOT regexp_matches(x, '^#{{1,6}}\s*$')), lambda x: regexp_replace(x, '^#{{1,6}}\s*(-|\*)\s+(.+)', '\1 \2')) AS ls FROM md),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln FROM p),
d AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)', 1)) AS depth FROM l),
v AS (SELECT *, CASE WHEN depth BETWEEN 1 AND 3 THEN depth WHEN depth = 0 AND ln = 0 AND regexp_matches(trim(line), '^CHƯƠNG\s+[IVXLCDM0-9]+|^##?\s*Chương\s+\d+|^\*?\*?Điều\s+\d+\.') THEN 2 END AS lvl,
regexp_replace(CASE WHEN depth > 0 THEN regexp_extract(line, '^(#{{1,6}})\s+(.+)', 2) ELSE line END, '^\s+|\s+$', '', 'g') AS said FROM d),
n AS (SELECT *, sum(CASE WHEN lvl IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ln) AS chunk_no FROM v),
h AS (SELECT doc_id, ln, lvl, said, {SHORT} AS short, chunk_no FROM n WHERE lvl IS NOT NULL),
a AS (SELECT *, {", ".join(f"max(CASE WHEN lvl = {k} THEN ln END) OVER w AS p{k}, max(CASE WHEN lvl < {k} THEN ln END) OVER w AS k{k}, last_value(CASE WHEN lvl = {k} THEN short END IGNORE NULLS) OVER w AS s{k}" for k in (1, 2, 3))}
FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, chunk_no, lvl, list_filter([{", ".join(f"CASE WHEN p{k} IS NOT NULL AND (k{k} IS NULL OR p{k} > k{k}) THEN s{k} END" for k in (1, 2, 3))}], lambda x: x IS NOT NULL) AS stack FROM a),
b AS (SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY ln) AS text FROM n GROUP BY ALL),
chunks AS (SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(coalesce(lvl, 0) AS INT) AS level, stack[-1] AS header, CASE WHEN stack IS NULL THEN [] ELSE stack[1:len(stack) - 1] END AS ancestors, text FROM b LEFT JOIN s USING (doc_id, chunk_no))"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.header_chunks(read(spark, d, "documents").select("doc_id", _md().alias("text")))


def header_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "chunk_no", "level", "header", chunking.hierarchy(F.col("ancestors"), F.col("header")).alias("hierarchy"), F.md5("text").alias("text_md5"))


HEADER = f"WITH {CHUNKS} SELECT doc_id, chunk_no, level, header, array_to_string(CASE WHEN header IS NULL THEN ancestors ELSE list_append(ancestors, header) END, ' > ') AS hierarchy, md5(text) AS text_md5 FROM chunks"


def title_merge(spark: SparkSession, d: str) -> DataFrame:
    return chunking.merge_titles(_chunks(spark, d)).select("doc_id", "chunk_no", "level", "header", "titles_merged", F.md5("text").alias("text_md5"))


TITLES = rf"""WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS idx, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS plain FROM chunks),
g AS (SELECT *, idx < 5 AND length(array_to_string(plain, chr(10))) < 150 AND len(plain) < 3 AND NOT regexp_matches(upper(coalesce(header, '')), 'MỤC LỤC|DANH MỤC TỪ VIẾT TẮT|QUYẾT ĐỊNH') AS fits FROM f),
r AS (SELECT *, coalesce(min(CASE WHEN NOT fits THEN idx END) OVER (PARTITION BY doc_id), count(*) OVER (PARTITION BY doc_id)) AS run FROM g),
m AS (SELECT *, run >= 2 AND idx < run AS merged, CASE WHEN run >= 2 AND idx < run THEN 0 ELSE idx END AS slot FROM r),
o AS (SELECT doc_id, slot, merged, CASE WHEN merged THEN 0 ELSE min(level) END AS level, CASE WHEN merged THEN coalesce(string_agg(header, ' ' ORDER BY idx), 'TITLE') ELSE min(header) END AS header, CASE WHEN merged THEN count(*) ELSE 0 END AS titles_merged, string_agg(text, chr(10) ORDER BY idx) AS text FROM m GROUP BY doc_id, slot, merged)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot) - 1 AS INT) AS chunk_no, CAST(level AS INT) AS level, header, CAST(titles_merged AS INT) AS titles_merged, md5(text) AS text_md5 FROM o"""


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.splitter_stats(_chunks(spark, d)).select("doc_id", "total_chunks", "headed_chunks", "tables_detected", F.col("words").cast("long").alias("words"))


STATS = rf"""WITH {CHUNKS} SELECT doc_id, count(*) AS total_chunks, count(header) AS headed_chunks, count(*) FILTER (regexp_matches(text, '\|?\s*---+\s*\|')) AS tables_detected,
CAST(sum(CASE WHEN s = '' THEN 0 ELSE len(string_split_regex(s, '\s+')) END) AS BIGINT) AS words FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM chunks) GROUP BY doc_id"""


def splitting_report(spark: SparkSession, d: str) -> DataFrame:
    """Figures of splitting: chunks of over 150 words go into parts of 100, and those that hold a table count as table chunks."""
    chunks = _chunks(spark, d)
    parts = chunking.sub_chunks(chunks.select("doc_id", "chunk_no", "text"), ["doc_id", "chunk_no"], limit=150, size=100, overlap=0)
    nodes = parts.withColumn("kind", F.when(chunking.has_table(F.col("text")), "table").otherwise("text"))
    return chunking.splitting_report(chunks, chunking.merge_titles(chunks), nodes)


REPORT = rf"""WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS idx, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS plain FROM chunks),
g AS (SELECT *, idx < 5 AND length(array_to_string(plain, chr(10))) < 150 AND len(plain) < 3 AND NOT regexp_matches(upper(coalesce(header, '')), 'MỤC LỤC|DANH MỤC TỪ VIẾT TẮT|QUYẾT ĐỊNH') AS fits FROM f),
r AS (SELECT *, coalesce(min(CASE WHEN NOT fits THEN idx END) OVER (PARTITION BY doc_id), count(*) OVER (PARTITION BY doc_id)) AS run FROM g),
st AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS st FROM r), sized AS (SELECT *, CASE WHEN st = '' THEN 0 ELSE len(string_split_regex(st, '\s+')) END AS n FROM st)
SELECT doc_id, count(*) AS total_chunks, count(*) FILTER (n > 150 AND ceil(n / 100) > 1) AS large_chunks_split, CAST(sum(CASE WHEN n > 150 THEN ceil(n / 100) ELSE 1 END) AS BIGINT) AS final_nodes, CAST(CASE WHEN max(run) >= 2 THEN max(run) ELSE 0 END AS BIGINT) AS title_chunks_merged,
count(*) FILTER (header IS NOT NULL AND NOT starts_with(text, '#') AND regexp_matches(string_split(text, chr(10))[1], '^CHƯƠNG\s+[IVXLCDM0-9]+|^##?\s*Chương\s+\d+|^\*?\*?Điều\s+\d+\.')) AS patterns_detected,
count(*) FILTER (regexp_matches(text, '\|?\s*---+\s*\|')) AS tables_detected, CAST(0 AS BIGINT) AS table_chunks_created FROM sized GROUP BY 1"""


def _tables(spark: SparkSession, d: str, group: bool) -> DataFrame:
    """Markdown tables of 9 and 31 customers, with a group row before every tenth."""
    k = F.col("c_custkey")
    numbered = read(spark, d, "customer").withColumn("table_no", F.floor(k / 40).cast("long") * 2 + (k % 40 < 9).cast("int"))
    c = numbered.withColumn("rn", F.row_number().over(Window.partitionBy("table_no").orderBy("c_custkey")))
    row = F.concat(F.lit("| "), F.col("c_custkey"), F.lit(" | "), F.col("c_name"), F.lit(" |"))
    if group:
        row = F.when(F.col("rn") % 10 == 1, F.concat(F.lit("**PLO"), F.col("rn"), F.lit("** | |\n"), row)).otherwise(row)
    listed = F.array_sort(F.collect_list(F.struct("rn", row.alias("x"))))
    head = "note\n| key | name |\n|---|---|\nlost | row\n" if group else "note\n| key | name |\n|---|---|\n"
    return c.groupBy("table_no").agg(F.concat(F.lit(head), F.array_join(F.transform(listed, lambda s: s["x"]), "\n")).alias("text"))


def table_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.row_chunks(_tables(spark, d, False), ["table_no"]).select("table_no", "part", "header", F.md5("text").alias("text_md5"))


ROWS = r"""WITH c AS (SELECT table_no, c_custkey, '| ' || c_custkey || ' | ' || c_name || ' |' AS x, row_number() OVER (PARTITION BY table_no ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY table_no) AS n FROM (SELECT *, c_custkey // 40 * 2 + CAST(c_custkey % 40 < 9 AS INT) AS table_no FROM customer)),
h AS (SELECT '| key | name |' || chr(10) || '|---|---|' || chr(10) AS h)
SELECT table_no, CAST(CASE WHEN n + 2 <= 15 THEN 0 ELSE (rn - 1) // 15 END AS INT) AS part, CASE WHEN n + 2 <= 15 THEN NULL ELSE 'Rows ' || min(rn) || '-' || max(rn) END AS header,
md5(CASE WHEN n + 2 <= 15 THEN 'note' || chr(10) ELSE '' END || any_value(h) || string_agg(x, chr(10) ORDER BY rn)) AS text_md5 FROM c, h GROUP BY table_no, n, CASE WHEN n + 2 <= 15 THEN 0 ELSE (rn - 1) // 15 END"""


def table_group_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.group_chunks(_tables(spark, d, True), ["table_no"], "plo").select("table_no", "group_no", "header", F.md5("text").alias("text_md5"))


GROUPS = r"""SELECT table_no, CAST((rn - 1) // 10 + 1 AS INT) AS group_no, '**PLO' || min(rn) || '** | |' AS header,
md5('| key | name |' || chr(10) || '|---|---|' || chr(10) || '**PLO' || min(rn) || '** | |' || chr(10) || string_agg(x, chr(10) ORDER BY rn)) AS text_md5
FROM (SELECT table_no, '| ' || c_custkey || ' | ' || c_name || ' |' AS x, row_number() OVER (PARTITION BY table_no ORDER BY c_custkey) AS rn FROM (SELECT *, c_custkey // 40 * 2 + CAST(c_custkey % 40 < 9 AS INT) AS table_no FROM customer)) GROUP BY table_no, (rn - 1) // 10"""


def sub_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit("\n---\n"), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return chunking.sub_chunks(docs, ["doc_id"], limit=200, size=100, overlap=20).select("doc_id", "sub_no", "sub_total", "tokens", F.md5("text").alias("text_md5"))


SUBS = r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || '---' || chr(10) || text ELSE text END AS t FROM documents),
w AS (SELECT *, instr(t, chr(10) || '---' || chr(10)) AS pos, regexp_replace(t, '^\s+|\s+$', '', 'g') AS st FROM t), n AS (SELECT *, CASE WHEN st = '' THEN 0 ELSE len(string_split_regex(st, '\s+')) END AS n FROM w),
b AS (SELECT doc_id, CASE WHEN pos > 0 THEN t[1:pos - 1] END AS context, regexp_replace(CASE WHEN pos > 0 THEN t[pos + 5:] ELSE t END, '^\s+|\s+$', '', 'g') AS body FROM n WHERE n > 200),
l AS (SELECT *, CASE WHEN body = '' THEN [] ELSE string_split_regex(body, '\s+') END AS ws FROM b), c AS (SELECT *, greatest(1, CAST(ceil((len(ws) - 20) / 80) AS INT)) AS total FROM l),
e AS (SELECT *, unnest(range(0, total)) AS k FROM c)
SELECT doc_id, CAST(0 AS INT) AS sub_no, CAST(1 AS INT) AS sub_total, CAST(n AS INT) AS tokens, md5(t) AS text_md5 FROM n WHERE n <= 200
UNION ALL SELECT doc_id, CAST(k AS INT), CAST(total AS INT), CAST(len(ws[k * 80 + 1:k * 80 + 100]) AS INT), md5(concat_ws(chr(10), context, array_to_string(ws[k * 80 + 1:k * 80 + 100], ' '))) FROM e"""


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit("\n---\n"), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return chunking.sentence_chunks(docs, ["doc_id"], limit=200, size=60, overlap=15).select("doc_id", "sub_no", "sub_total", "tokens", F.md5("text").alias("text_md5"))


#: Chunk ends by prefix sums, one chunk a step.
SENTENCES = r"""WITH RECURSIVE t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || '---' || chr(10) || text ELSE text END AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS n, instr(t, chr(10) || '---' || chr(10)) AS pos FROM t),
b AS (SELECT doc_id, CASE WHEN pos > 0 THEN t[1:pos - 1] END AS context, CASE WHEN pos > 0 THEN t[pos + 5:] ELSE t END AS body FROM n WHERE n > 200),
s AS (SELECT doc_id, context, list_filter(string_split(regexp_replace(body, '([.!?\x{2026}]+["''\x{201d}\x{2019})\]]*[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*)', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '') AS s FROM b),
w AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s), v AS (SELECT *, list_filter(string_split_regex(x, '\s+'), lambda y: y <> '') AS ws FROM w),
p AS (SELECT doc_id, i, k, CASE WHEN len(ws) > 60 THEN array_to_string(ws[k * 60 + 1:k * 60 + 60], ' ') || ' ' ELSE x END AS x, CASE WHEN len(ws) > 60 THEN len(ws[k * 60 + 1:k * 60 + 60]) ELSE len(ws) END AS n
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(len(ws) / 60) AS INT)))) AS k FROM v)),
l AS (SELECT doc_id, list(x ORDER BY i, k) AS x, list_prepend(0, list(c ORDER BY i, k)) AS c FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i, k) AS INT) AS c FROM p) GROUP BY 1),
walk AS (SELECT doc_id, 0 AS no, 0 AS start, CAST(greatest(1, len(list_filter(c, lambda y: y <= 60)) - 1) AS INT) AS stop FROM l
  UNION ALL SELECT doc_id, no + 1, a, CAST(greatest(a + 1, len(list_filter(c, lambda y: y <= c[a + 1] + 60)) - 1) AS INT) FROM
  (SELECT walk.doc_id, no, c, CAST(start + len(list_filter(c[start + 1:stop], lambda y: c[stop + 1] - y > least(15, 60 - (c[stop + 2] - c[stop + 1])))) AS INT) AS a FROM walk JOIN l ON l.doc_id = walk.doc_id WHERE stop < len(x)))
SELECT doc_id, CAST(0 AS INT) AS sub_no, CAST(1 AS INT) AS sub_total, CAST(n AS INT) AS tokens, md5(t) AS text_md5 FROM n WHERE n <= 200
UNION ALL SELECT l.doc_id, no, CAST(count(*) OVER (PARTITION BY l.doc_id) AS INT), CAST(c[stop + 1] - c[start + 1] AS INT), md5(concat_ws(chr(10), context, regexp_replace(array_to_string(x[start + 1:stop], ''), '^\s+|\s+$', '', 'g'))) FROM walk JOIN l ON l.doc_id = walk.doc_id JOIN s ON s.doc_id = l.doc_id"""


def _regulation() -> Column:
    """Markdown with chapters, articles, clauses, a preamble and tables at places that vary by document."""
    k, n = F.col("doc_id") % 7, "\n"
    head = F.concat(F.lit("QUYẾT ĐỊNH\nCăn cứ luật "), "source", F.lit("\nCăn cứ nghị định\n\nXét đề nghị của khoa\n"))
    grid = F.concat(F.lit("\nBảng "), F.col("doc_id"), F.lit(". số liệu\n| a | b |\n|---|---|\n| 1 | "), "lang", F.lit(" |\n"))
    articles = F.concat(F.lit("CHƯƠNG I\n## Quy định chung\n**Điều 1. "), "source", F.lit("**\n1. ngắn thôi"), F.when(k > 3, " " + "từ " * 9).otherwise(""), F.lit("\n2. hai\na) chữ\n"), grid, F.lit("##\n---\n---\nĐiều 2. tiếp\n"))
    return (
        F.when(k == 0, F.concat(head, articles, grid, F.col("text"))).when(k == 1, F.concat(articles, F.col("text"), grid, F.lit("# Phụ lục\n"), grid, F.lit("Căn cứ sau")))
        .when(k < 5, F.concat(F.lit("## "), "lang", grid, head, articles, F.lit(n), F.lit("#### **Bảng 9**\n<table><tr></tr></table>\n"), F.col("text"))).otherwise(F.concat(head, F.col("text"), F.lit(n), articles))
    )


def markdown_repair(spark: SparkSession, d: str) -> DataFrame:
    """Header levels, tables' levels, chapter titles and tidying."""
    table = markdown.line_table(read(spark, d, "documents").select("doc_id", _regulation().alias("text")))
    fixed = markdown.tidy(markdown.chapter_titles(markdown.table_levels(markdown.heading_levels(table))))
    return markdown.join_lines(fixed).select("doc_id", F.md5("text").alias("text_md5"))


REPAIR = r"""WITH md AS (SELECT doc_id, CASE WHEN k = 0 THEN head || articles || grid || text WHEN k = 1 THEN articles || text || grid || '# Phụ lục' || chr(10) || grid || 'Căn cứ sau'
  WHEN k < 5 THEN '## ' || lang || grid || head || articles || chr(10) || '#### **Bảng 9**' || chr(10) || '<table><tr></tr></table>' || chr(10) || text ELSE head || text || chr(10) || articles END AS md FROM
  (SELECT *, replace('CHƯƠNG I~## Quy định chung~**Điều 1. ' || source || '**~1. ngắn thôi' || CASE WHEN k > 3 THEN ' ' || repeat('từ ', 9) ELSE '' END || '~2. hai~a) chữ~', '~', chr(10)) || grid || replace('##~---~---~Điều 2. tiếp~', '~', chr(10)) AS articles FROM
  (SELECT *, doc_id % 7 AS k, replace('QUYẾT ĐỊNH~Căn cứ luật ' || source || '~Căn cứ nghị định~~Xét đề nghị của khoa~', '~', chr(10)) AS head, replace('~Bảng ' || doc_id || '. số liệu~| a | b |~|---|---|~| 1 | ' || lang || ' |~', '~', chr(10)) AS grid FROM documents))),
raw AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS ln FROM md), t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM raw),
a AS (SELECT *, NOT starts_with(s, '#') AS plain, regexp_matches(s, '^(?:#+\s*)?(?:\*\*)?Điều\s+\d+') AS article, NOT starts_with(s, '#') AND regexp_matches(s, '^\d+\.\s') AS number, NOT starts_with(s, '#') AND regexp_matches(s, '^[a-zđ][.)]\s') AS letter, len(string_split_regex(s, '\s+')) >= 10 AS many FROM t),
b AS (SELECT *, sum(CAST(article AS INT)) OVER w AS an, sum(CAST(article OR number AS INT)) OVER w AS cn FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
c AS (SELECT *, bool_or(number AND many) OVER (PARTITION BY doc_id, an) AS ln_, bool_or(letter AND many) OVER (PARTITION BY doc_id, an, cn) AS ll FROM b),
h AS (SELECT doc_id, ln, CASE WHEN plain AND regexp_matches(s, '^CHƯƠNG\s+[IVXLCDM0-9]+') THEN '# ' || s WHEN plain AND article THEN '## ' || replace(s, '**', '') WHEN number AND ln_ THEN '### ' || s WHEN letter AND ll THEN '#### ' || s ELSE line END AS line FROM c),
f AS (SELECT *, starts_with(s, '|') OR starts_with(lower(s), '<table') AS bar FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM h) WHERE s <> ''),
g AS (SELECT *, NOT bar AND regexp_matches(s, '^(#+\s*)?(\*\*)?Bảng(\s|$)') AND coalesce(lead(bar) OVER w, false) AS caption, CASE WHEN regexp_matches(s, '^##\s+Điều\s+\d+') THEN 3 WHEN regexp_matches(s, '^###\s+\d+\.\s|^####\s+[a-zđ][.)]\s') THEN 4 WHEN regexp_matches(s, '^##?\s') THEN 2 END AS opened,
  CASE WHEN NOT starts_with(s, '#') AND NOT bar THEN nullif(regexp_extract(s, '^(?:\*\*)?(Căn cứ|Xét đề nghị|QUYẾT ĐỊNH)', 1), '') END AS kind, bool_or(regexp_matches(s, '^##\s+Điều\s+\d+|^#\s+CHƯƠNG\s')) OVER w AS body FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
l AS (SELECT doc_id, ln, CASE WHEN caption THEN repeat('#', coalesce(last_value(CASE WHEN NOT caption THEN opened END IGNORE NULLS) OVER w, 2)) || ' ' || bare WHEN kind IS NOT NULL AND kind IS DISTINCT FROM lag(kind) OVER w AND NOT body THEN '## ' || bare ELSE line END AS line
  FROM (SELECT *, replace(regexp_replace(s, '^#+\s*', ''), '**', '') AS bare FROM g) WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
n AS (SELECT *, lead(line) OVER w AS after, lag(line) OVER w AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
j AS (SELECT doc_id, ln, CASE WHEN regexp_matches(line, '^#\s*CHƯƠNG\s+[IVXLCDM0-9]+\s*$') AND regexp_matches(after, '^#{1,2}\s') AND NOT regexp_matches(after, '^#+\s*(CHƯƠNG|Điều)\s') THEN upper(line || ' - ' || regexp_replace(after, '^#+\s*', ''))
  WHEN regexp_matches(line, '^#{1,2}\s') AND NOT regexp_matches(line, '^#+\s*(CHƯƠNG|Điều)\s') AND coalesce(regexp_matches(before, '^#\s*CHƯƠNG\s+[IVXLCDM0-9]+\s*$'), false) THEN NULL ELSE line END AS line FROM n),
k AS (SELECT *, regexp_matches(line, '^\s*---+\s*$') AS rule FROM j WHERE line IS NOT NULL AND NOT regexp_matches(line, '^#{1,6}\s*$') AND regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''),
z AS (SELECT *, rule AND coalesce(lag(rule) OVER (PARTITION BY doc_id ORDER BY ln), false) AS again FROM k)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY ln)) AS text_md5 FROM z WHERE NOT again GROUP BY 1"""


def blank_before_tables(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d, False).withColumnRenamed("table_no", "doc_id")
    fixed = markdown.join_lines(markdown.blank_before_tables(markdown.line_table(tables)))
    return fixed.select("doc_id", F.md5("text").alias("text_md5"))


BLANKS = r"""SELECT table_no AS doc_id, md5('note' || chr(10) || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' |', chr(10) ORDER BY c_custkey)) AS text_md5 FROM (SELECT *, c_custkey // 40 * 2 + CAST(c_custkey % 40 < 9 AS INT) AS table_no FROM customer) GROUP BY 1"""


def flatten_table_rows(spark: SparkSession, d: str) -> DataFrame:
    tables = _tables(spark, d, False).withColumnRenamed("table_no", "doc_id")
    return markdown.flatten_rows(markdown.line_table(tables)).select("doc_id", "ln", "text")


FLAT = r"""SELECT table_no AS doc_id, CAST(2 + row_number() OVER (PARTITION BY table_no ORDER BY c_custkey) AS INT) AS ln, '- key: ' || c_custkey || '; name: ' || c_name AS text FROM (SELECT *, c_custkey // 40 * 2 + CAST(c_custkey % 40 < 9 AS INT) AS table_no FROM customer)"""

QUERIES = {
    "header_chunks": Query(header_chunks, HEADER),
    "title_merge": Query(title_merge, TITLES),
    "chunk_stats": Query(chunk_stats, STATS),
    "splitting_report": Query(splitting_report, REPORT),
    "table_row_chunks": Query(table_row_chunks, ROWS),
    "table_group_chunks": Query(table_group_chunks, GROUPS),
    "sub_chunks": Query(sub_chunks, SUBS),
    "sentence_chunks": Query(sentence_chunks, SENTENCES),
    "markdown_repair": Query(markdown_repair, REPAIR),
    "blank_before_tables": Query(blank_before_tables, BLANKS),
    "flatten_table_rows": Query(flatten_table_rows, FLAT),
}

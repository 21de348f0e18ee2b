"""Queries of grades, HTML tables and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import evalset, portal
from docloom.plans.query import Query, read


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as courses: a supplier is a student, a year of shipping a term."""
    mark = F.when(F.col("l_returnflag") != "R", F.round(F.col("l_discount") * 100))
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("student_id"), F.year("l_shipdate").alias("term"), F.col("l_linenumber").alias("credits"), mark.alias("average_score"))


def _averages(df: DataFrame, by: list[str]) -> DataFrame:
    return portal.averages(df, by).select(*by, F.col("total_registered_credits").cast("long"), F.col("gpa_credits").cast("long"), F.round(F.col("gpa_10") * 100).cast("long").alias("gpa_10_e2"), F.round(F.col("gpa_4") * 100).cast("long").alias("gpa_4_e2"))


def gpa_by_term(spark: SparkSession, d: str) -> DataFrame:
    return _averages(_marks(spark, d), ["student_id", "term"])


def gpa_overall(spark: SparkSession, d: str) -> DataFrame:
    return _averages(_marks(spark, d), ["student_id"])


def _gpa_sql(by: str) -> str:
    return f"""WITH m AS (SELECT l_suppkey AS student_id, CAST(year(l_shipdate) AS INT) AS term, CAST(l_linenumber AS BIGINT) AS credits, CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_discount * 100) AS BIGINT) END AS mark FROM lineitem),
s AS (SELECT {by}, CAST(sum(credits) AS BIGINT) AS total_registered_credits, CAST(coalesce(sum(CASE WHEN mark IS NOT NULL THEN credits END), 0) AS BIGINT) AS gpa_credits, CAST(sum(mark * credits) AS BIGINT) AS points FROM m GROUP BY ALL),
g AS (SELECT *, CASE WHEN gpa_credits > 0 THEN (200 * points + gpa_credits) // (2 * gpa_credits) END AS t FROM s)
SELECT {by}, total_registered_credits, gpa_credits, CAST(t AS BIGINT) AS gpa_10_e2, CAST(CASE WHEN t <> 0 THEN (8 * t + 10) // 20 END AS BIGINT) AS gpa_4_e2 FROM g"""


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """The driver's pages have lists but no tables: each page's address, with character references, goes into a table of one around it."""
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    table = F.concat(F.lit("<table><tr><th>Mã HP</th><th>n</th></tr><tr><td> "), url, F.lit("</td><td>"), F.col("page_id"), F.lit("</td></tr><tr></tr><tr><td><b>a</b>&lt;b</td></tr></table>"))
    made = read(spark, d, "pages").select("page_id", F.concat(F.lit("<table><tr><td>other</td></tr></table>"), "html", F.when(F.col("page_id") % 3 != 0, table).otherwise("")).alias("html"))
    return portal.html_table_rows(made, ["mã hp"]).select("page_id", "rn", F.array_join("cells", "|").alias("cells"))


TABLES = "SELECT page_id, CAST(n AS INT) AS rn, CASE n WHEN 0 THEN url || '|' || page_id ELSE 'a<b' END AS cells FROM pages, range(2) t(n) WHERE page_id % 3 <> 0"


def _grade_pages(spark: SparkSession, d: str) -> DataFrame:
    """Grade pages of twenty customers each: a student table, and courses under the terms that market segments stand for."""
    k = F.col("c_custkey")
    cell = lambda *xs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.lit(x) if isinstance(x, str) else x.cast("string"), F.lit("</td>")) for x in xs], F.lit("</tr>"))
    c = read(spark, d, "customer").withColumn("page_id", F.floor(k / 20).cast("long")).withColumn("term", F.ascii("c_mktsegment") % 3)
    mark = F.when(k % 7 == 0, "-").otherwise((k % 100 / 10).cast("decimal(4,1)").cast("string"))
    course = cell(k, F.concat(F.lit("IT"), k), F.col("c_name"), k % 5, mark, "8.0", "", mark, F.when(k % 9 == 0, " Miễn ").otherwise(mark), "")
    head = F.concat(F.lit("<tr><td colspan='10'>Học kỳ "), F.col("term") + 1, F.lit(" - Năm học 2020-2021</td></tr>"))
    rows = c.select("page_id", "term", k.alias("n"), course.alias("row")).unionAll(c.select("page_id", "term", F.lit(-1).cast("long"), head).distinct())
    rows = rows.unionAll(c.select("page_id", "term", F.lit(1 << 40).cast("long"), F.lit("<tr><td>Trung bình học kỳ</td><td></td></tr>")).distinct())
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "n", "row"))), lambda s: s["row"]), "\n")
    student = F.concat(
        F.lit('<table width="100%" border="0" cellspacing="0" cellpadding="0" bordercolor="FFFFFF"><tr><td>Họ và tên:</td><td> S '), F.col("page_id"), F.lit("</td><td>Ngày sinh</td><td>01/02/2003</td><td>Giới tính</td><td>Nam &amp;  nữ</td></tr><tr><td>Mã SV</td><td>"),
        F.col("page_id") + 20520000, F.lit("</td><td>Lớp</td><td>"), F.when(F.col("page_id") % 2 == 0, "KHMT").otherwise(""), F.lit("</td><td>Khoa</td>"), F.when(F.col("page_id") % 5 != 0, "<td>KH MT</td>").otherwise(""),
        F.lit("</tr><tr><td>Bậc</td><td>Đại học</td><td>Hệ</td><td>CQ</td></tr></table>"),
    )
    body = F.concat(F.lit("<table><tr><th>STT</th><th>Mã HP</th><th>Tên học phần</th></tr>"), listed, F.lit("</table>"))
    return rows.groupBy("page_id").agg(body.alias("b")).select("page_id", F.concat(F.lit('<table width="100%"><tr><td>menu</td></tr></table>'), student, "b").alias("html"))


def student_info(spark: SparkSession, d: str) -> DataFrame:
    return portal.student_info(_grade_pages(spark, d))


STUDENTS = """SELECT p AS page_id, 'S ' || p AS name, '01/02/2003' AS dob, 'Nam & nữ' AS gender, CASE WHEN p % 5 <> 0 THEN CAST(p + 20520000 AS VARCHAR) END AS student_id, CASE WHEN p % 5 <> 0 AND p % 2 = 0 THEN 'KHMT' END AS class_name, CASE WHEN p % 5 <> 0 THEN 'KH MT' END AS faculty,
'Đại học' AS degree, 'CQ' AS training_system FROM (SELECT DISTINCT c_custkey // 20 AS p FROM customer)"""


def grade_courses(spark: SparkSession, d: str) -> DataFrame:
    return portal.grade_courses(portal.html_table_rows(_grade_pages(spark, d), ["Mã HP", "Tên học phần"])).drop("rn")


GRADES = """SELECT k // 20 AS page_id, 'HK' || (ascii(c_mktsegment) % 3 + 1) || ' năm học 2020-2021' AS semester, CAST(k AS INT) AS stt, 'IT' || k AS course_code, c_name AS course_name, CAST(k % 5 AS INT) AS credits, CASE WHEN k % 9 <> 0 AND k % 7 <> 0 THEN m END AS attendance_score,
CASE WHEN k % 9 <> 0 THEN CAST(8 AS DOUBLE) END AS midterm_score, CAST(NULL AS DOUBLE) AS practice_score, CASE WHEN k % 9 <> 0 AND k % 7 <> 0 THEN m END AS final_score, CASE WHEN k % 9 <> 0 AND k % 7 <> 0 THEN m END AS average_score, k % 9 = 0 AS is_exempt
FROM (SELECT c_custkey AS k, c_name, c_mktsegment, CAST(CAST(c_custkey % 100 / 10 AS DECIMAL(4,1)) AS DOUBLE) AS m FROM customer)"""


def exam_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exam tables of thirty customers each; some rows have no number, no course and date, or too few cells."""
    k = F.col("c_custkey")
    cells = [F.when(k % 11 == 0, "x").otherwise(k.cast("string")), F.when(k % 4 == 0, "-").otherwise(F.concat(F.lit("IT"), k)), F.col("c_mktsegment"), F.lit("1"), F.lit("Thứ 2"), F.when(k % 8 == 0, "").otherwise("05/06/2024"), F.col("c_nationkey").cast("string"), F.lit(" ")]
    whole = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in cells], F.lit("</tr>"))
    row = F.when(k % 13 == 0, F.concat(F.lit("<tr><td>"), k, F.lit("</td><td>IT</td></tr>"))).otherwise(whole)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda s: s["row"]), "")
    pages = read(spark, d, "customer").groupBy(F.floor(k / 30).cast("long").alias("page_id")).agg(F.concat(F.lit("<table><tr><th>STT</th><th>Mã MH</th></tr>"), listed, F.lit("</table>")).alias("html"))
    return portal.exam_rows(portal.html_table_rows(pages, ["Mã MH"])).drop("rn")


EXAMS = """SELECT k // 30 AS page_id, CAST(k AS INT) AS stt, code AS course_code, code AS course_name, c_mktsegment AS class_code, '1' AS exam_period, 'Thứ 2' AS day_of_week, day AS exam_date, CAST(c_nationkey AS VARCHAR) AS room, CAST(NULL AS VARCHAR) AS exam_form
FROM (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'IT' || c_custkey END AS code, CASE WHEN c_custkey % 8 <> 0 THEN '05/06/2024' END AS day FROM customer) WHERE k % 11 <> 0 AND k % 13 <> 0 AND (code IS NOT NULL OR day IS NOT NULL)"""


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evalset.stratified_sample(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 200, 5, 42)


SAMPLE = """WITH r AS (SELECT doc_id, source, md5(doc_id || '|42') AS draw, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|42'), doc_id) AS n FROM documents),
q AS (SELECT least(5, greatest(1, 200 // count(DISTINCT source))) AS quota FROM documents) SELECT doc_id, source FROM r, q ORDER BY n > quota, draw, doc_id LIMIT 200"""


def whitelist_filter(spark: SparkSession, d: str) -> DataFrame:
    return evalset.whitelist(read(spark, d, "documents"), "source", ["src0", "src3", "src7", "none"])[1]


WHITELIST = "SELECT count(*) FILTER (source IN ('src0', 'src3', 'src7', 'none')) AS kept, count(*) FILTER (source NOT IN ('src0', 'src3', 'src7', 'none')) AS dropped FROM documents"


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return evalset.value_counts(read(spark, d, "documents"), "lang")


VALUES = "SELECT lang, count(*) AS n FROM documents GROUP BY 1"


def metric_means(spark: SparkSession, d: str) -> DataFrame:
    means = evalset.metric_means(read(spark, d, "labels"), ["quality", "toxic"])
    return means.select("metric", F.round(F.col("mean") * 1_000_000).cast("long").alias("mean_e6"))


MEANS = "SELECT 'quality' AS metric, CAST(round(avg(coalesce(quality, 0)) * 1000000) AS BIGINT) AS mean_e6 FROM labels UNION ALL SELECT 'toxic', CAST(round(avg(coalesce(toxic, 0)) * 1000000) AS BIGINT) FROM labels"


def test_items(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("role <> 'system'")
    rows = c.select((F.col("conv_id") * 10 + F.col("turn")).alias("i"), F.col("text").alias("q"), F.md5("text").alias("a"), F.when(F.col("turn") == 1, F.lit("yes")).alias("yn"), F.lit(None).cast("string").alias("x"), F.lit("1").alias("article"), F.col("role").alias("doc"))
    items = evalset.as_items(rows, F.col("i"), "q", "a", "yn", "x", "article", "doc")
    return items.groupBy("metadata.question_type", "metadata.document").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("ground_truth").alias("max_truth"))


ITEMS = "SELECT CASE WHEN turn = 1 THEN 'yes_no' ELSE 'open' END AS question_type, role AS document, count(*) AS n, min(printf('reg_%04d', conv_id * 10 + turn)) AS first_id, max(md5(text)) AS max_truth FROM conversations WHERE role <> 'system' GROUP BY ALL"


def answer_f1(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant's turn held against the turn before it."""
    c = read(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evalset.token_f1(F.col("text"), F.col("truth")) * 1_000_000).cast("long").alias("f1_e6"))


WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\pL\pN]+'), lambda w: w <> ''))"
F1 = f"""SELECT a.conv_id, a.turn, CAST(round(1000000 * CASE WHEN len(aw) + len(bw) > 0 THEN 2.0 * len(list_intersect(aw, bw)) / (len(aw) + len(bw)) ELSE 0 END) AS BIGINT) AS f1_e6 FROM (SELECT conv_id, turn, {WORDS.format("text")} AS aw FROM conversations WHERE role = 'assistant') a
JOIN (SELECT conv_id, turn + 1 AS turn, {WORDS.format("text")} AS bw FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn"""


def answers_by_index(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("index"), F.md5("text").alias("question"))
    answers = read(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("index"), F.md5("text").alias("answer"))
    return evalset.join_answers(items, answers)


ANSWERS = "SELECT item_id AS index, md5(b.text) AS question, coalesce(md5(d.text), '') AS answer FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id AND d.lang = 'en'"

QUERIES = {
    "gpa_by_term": Query(gpa_by_term, _gpa_sql("student_id, term")),
    "gpa_overall": Query(gpa_overall, _gpa_sql("student_id")),
    "html_tables": Query(html_tables, TABLES),
    "student_info": Query(student_info, STUDENTS),
    "grade_courses": Query(grade_courses, GRADES),
    "exam_rows": Query(exam_rows, EXAMS),
    "stratified_sample": Query(stratified_sample, SAMPLE),
    "whitelist_filter": Query(whitelist_filter, WHITELIST),
    "value_counts": Query(value_counts, VALUES),
    "metric_means": Query(metric_means, MEANS),
    "test_items": Query(test_items, ITEMS),
    "answer_f1": Query(answer_f1, F1),
    "answers_by_index": Query(answers_by_index, ANSWERS),
}

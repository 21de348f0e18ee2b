"""Queries of single fields and rows: names, codes, scores and contexts, derived from the rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import metadata, urls
from docloom.operators import chunking, retrieval, store
from docloom.plans.chunk_queries import CHUNKS, _chunks
from docloom.plans.query import Query, read
from docloom.plans.retrieval_queries import CANDIDATES, _candidates
from docloom.plans.store_queries import NOW, USERS, _now, _users
from docloom.plans.text_queries import STRIP_SQL, sql_list
from docloom.sources import files
from docloom.streaming import stateful

FOLDERS = [
    ("01-quyet-dinh-", "regulation"), ("x-quy-trinh-", "regulation"), ("thong-bao-lich-thi-", "announcement"), ("content-cu-nhan-", "curriculum"), ("De-An-Song-Nganh-", "curriculum"), ("foo-", "other"), ("a-01-b-", "other"), ("danh-muc-mon-hoc-", "curriculum"),
]


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def folder_category(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "pages").select(F.concat(_pick([n for n, _ in FOLDERS], "page_id"), F.col("page_id")).alias("name"))
    return files.by_category(names, [*V.CATEGORIES, "none"]).groupBy("category").agg(F.count("name").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


FOLDER_CATEGORY = f"""SELECT c.category, count(name) AS n, min(name) AS first, max(name) AS last FROM (SELECT unnest({sql_list([*V.CATEGORIES, "none"])}) AS category) c
LEFT JOIN (SELECT {sql_list([n for n, _ in FOLDERS])}[page_id % 8 + 1] || page_id AS name, {sql_list([c for _, c in FOLDERS])}[page_id % 8 + 1] AS category FROM pages) n USING (category) GROUP BY 1"""


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Codes, dates and years of file names of five kinds."""
    k, day = F.col("doc_id"), F.concat_ws("-", F.col("doc_id") % 28 + 1, F.col("doc_id") % 12 + 1)
    kinds = [
        F.concat(k, F.lit("_qd-dhcntt_"), day, F.lit("-2022_x")), F.concat(k, F.lit("-qd-dhcntt"), day, F.lit("-2019_x")), F.concat(F.lit("05-quy-dinh__"), k, F.lit("-qd-dhcntt_"), day, F.lit("-22_x")), F.concat(F.lit("plain__"), k), F.concat(F.lit("x"), k),
    ]
    names = read(spark, d, "documents").select("doc_id", F.element_at(F.array(*kinds), (k % 5 + 1).cast("int")).alias("name"))
    c = F.col("name")
    return names.select("doc_id", metadata.regulation_code_of_name(c).alias("code"), metadata.date_of_name(c).alias("date"), metadata.year_of_name(c).alias("year"))


FILE_METADATA = """SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN doc_id || '/QD-DHCNTT' END AS code, CASE WHEN doc_id % 5 < 3 THEN printf('%d-%02d-%02d', y, doc_id % 12 + 1, doc_id % 28 + 1) END AS date, CASE WHEN doc_id % 5 < 3 THEN y END AS year
FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 1 THEN 2019 ELSE 2022 END AS INT) AS y FROM documents)"""


def portal_fields(spark: SparkSession, d: str) -> DataFrame:
    """Semesters and student ids of sentences of six kinds."""
    k = F.col("doc_id")
    said = F.when(k % 6 == 0, F.concat(F.lit("Học kỳ "), k % 3 + 1, F.lit(" - Năm học "), k % 9 + 2015, F.lit("-"), k % 9 + 2016)).when(k % 6 == 1, "HK 1 NĂM 2025 - 2026").when(k % 6 == 2, F.concat(F.lit("MSSV: "), k + 20000000))
    said = said.when(k % 6 == 3, F.concat(F.lit("id "), k + 10000000, F.lit(" x"))).when(k % 6 == 4, F.concat(F.lit("tel 09"), k + 12345678)).otherwise(F.col("lang"))
    return read(spark, d, "documents").select("doc_id", metadata.semester(said).alias("semester"), metadata.student_id(said).alias("student_id"))


PORTAL_FIELDS = """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'HK' || (doc_id % 3 + 1) || ' năm học ' || (doc_id % 9 + 2015) || '-' || (doc_id % 9 + 2016) END AS semester,
CASE doc_id % 6 WHEN 2 THEN CAST(doc_id + 20000000 AS VARCHAR) WHEN 3 THEN CAST(doc_id + 10000000 AS VARCHAR) END AS student_id FROM documents"""

MAJORS = [*V.MAJOR_CODES, "Triết học", "công nghệ thông tin"]


def curriculum_fields(spark: SparkSession, d: str) -> DataFrame:
    """Codes of majors, kinds of documents and years of intakes; two majors are unknown, and one spelt otherwise."""
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("khoa-"), k % 10 + 2010)).when(k % 3 == 1, F.concat(F.lit("khoa-15-"), k % 10 + 2010)).otherwise("x")
    said = F.when(k % 2 == 0, F.concat(F.lit("năm "), k % 90 + 2010, F.lit("."))).otherwise("120305 none")
    return read(spark, d, "documents").select(
        "doc_id", metadata.major_code(_pick(MAJORS, "doc_id")).alias("major_code"), metadata.document_type(_pick(["original", "supplement", "update"], "doc_id")).alias("document_type"), metadata.curriculum_year(name, said).alias("year")
    )


CURRICULUM = f"""SELECT doc_id, {sql_list([*V.MAJOR_CODES.values()])}[doc_id % {len(MAJORS)} + 1] AS major_code, ['original', 'update', 'update'][doc_id % 3 + 1] AS document_type,
CAST(CASE WHEN doc_id % 3 < 2 THEN doc_id % 10 + 2010 WHEN doc_id % 2 = 0 THEN doc_id % 90 + 2010 END AS INT) AS year FROM documents"""


def crawl_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores for crawling, and whether the page before has the same host."""
    pages = read(spark, d, "pages").select("page_id", "url")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    rules = {"important": ["/en/", "/de/"], "excluded": [r"\?page=\d+"], "years": [r"\d"]}
    score = urls.crawl_score(F.col("url"), [("/en/", 50), ("/de/", 40)], [("ref=", 5)], **rules)
    return pages.join(before, "page_id", "left").select("page_id", score.alias("score"), urls.same_domain(F.col("url"), F.col("before")).alias("same_domain"))


HOST = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
SCORES = f"""SELECT p.page_id, CASE WHEN regexp_matches(p.url, '\\?page=\\d+') OR NOT regexp_matches(p.url, '(?i)/en/|/de/') THEN 0 ELSE greatest(0, CASE WHEN regexp_matches(p.url, '(?i)/en/') THEN 50 ELSE 40 END + CASE WHEN contains(p.url, 'ref=') THEN 5 ELSE 0 END - CASE WHEN length(p.url) > 150 THEN 20 ELSE 0 END) / 100 END AS score,
{HOST.format("p.url")} = {HOST.format("q.url")} AS same_domain FROM pages p LEFT JOIN pages q ON q.page_id + 1 = p.page_id"""


def chunk_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their article's full name before clauses, their document's title, and the kind of table that a header announces."""
    chunks = chunking.clause_context(_chunks(spark, d))
    title = F.when(F.col("chunk_no") % 2 == 0, F.concat(F.lit("T"), F.col("doc_id"))).when(F.col("chunk_no") % 4 == 1, "  ")
    header = F.concat(_pick(["Chuẩn đầu ra ", "Kế hoạch giảng dạy", "kế hoạch học tập ", ""], "chunk_no"), F.coalesce("header", F.lit("")))
    return chunks.select("doc_id", "chunk_no", F.md5(chunking.title_context(F.col("text"), title)).alias("text_md5"), chunking.table_type(F.when(F.col("chunk_no") != 5, header)).alias("table_type"))


CONTEXTS = f"""WITH {CHUNKS} SELECT doc_id, chunk_no, md5(CASE WHEN chunk_no % 2 = 0 THEN '# T' || doc_id || chr(10) || chr(10) ELSE '' END || CASE WHEN regexp_matches(header, '^Khoản \\d+') AND len(list_filter(ancestors, lambda a: starts_with(a, 'Điều'))) > 0 THEN '## Điều ' || doc_id || '. ' || lang || chr(10) ELSE '' END || chunks.text) AS text_md5,
CASE WHEN chunk_no = 5 THEN 'unknown' ELSE ['plo', 'study_plan', 'study_plan', 'unknown'][chunk_no % 4 + 1] END AS table_type FROM chunks JOIN documents USING (doc_id)"""


def final_top(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.final_top(_candidates(spark, d), 3).select("qid", "rank", "chunk_id", "total_retrieved", "final_count")


TOP = f"WITH {CANDIDATES} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, n AS total_retrieved, least(n, 3) AS final_count FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM cand) WHERE rank <= 3"


def curricula(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select(
        "qid", "rank", F.concat(F.lit("head\n---\n"), "text").alias("text"), F.when(F.col("qid") % 2 == 0, F.col("source")).alias("title"), F.lit("2023").alias("year"), F.col("lang").alias("major"), F.upper("lang").alias("major_code"), F.lit("CQ").alias("program_type"),
        F.lit(None).cast("string").alias("program_name"), F.concat(F.lit("u/"), "chunk_id").alias("source_url"), "score",
    )
    shaped = retrieval.format_curricula(rows)
    return shaped.withColumn("content", F.md5("content")).withColumn("score", F.round(F.col("score") * 100).cast("long"))


CURRICULA = f"""WITH {CANDIDATES} SELECT qid, CAST(rank AS INT) AS rank, md5({STRIP_SQL.format("text")}) AS content, CASE WHEN qid % 2 = 0 THEN source ELSE '' END AS title, CAST(2023 AS INT) AS year, lang AS major, upper(lang) AS major_code, 'CQ' AS program_type, CAST(NULL AS VARCHAR) AS program_name,
'u/' || chunk_id AS source_url, CAST(round(round(score, 2) * 100) AS BIGINT) AS score FROM cand"""


def message_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What messages keep of their sources and tool calls; some have none of either."""
    c = read(spark, d, "conversations")
    sources = F.when(F.col("turn") % 2 == 0, F.array(F.struct("role", "turn"))).otherwise(F.array().cast("array<struct<role:string,turn:int>>"))
    tools = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.col("conv_id").alias("id"))))
    kept = store.message_metadata(sources, tools)
    return c.select("conv_id", "turn", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


MESSAGE = """SELECT conv_id, turn, concat_ws(';', CASE WHEN turn % 2 = 0 THEN 'sources=[{"role":"' || role || '","turn":' || turn || '}]' END, CASE WHEN turn % 3 = 0 THEN 'tools=[{"id":' || conv_id || '}]' END) AS metadata FROM conversations"""


def user_changes(spark: SparkSession, d: str) -> DataFrame:
    """Three users deleted (one was before), one with an avatar, one whose avatar goes, and one with a new name."""
    none = F.lit(None).cast("struct<url:string,public_id:string,uploaded_at:timestamp_ntz>")
    users = _users(spark, d).withColumn("avatar", F.when(F.col("id") == 4, F.struct(F.lit("old").alias("url"), F.lit("p").alias("public_id"), _now().alias("uploaded_at"))).otherwise(none))
    gone = store.soft_delete(users, [1, 2, 11], F.lit("2024-02-02").cast("timestamp_ntz"))
    pictured = store.set_avatar(store.set_avatar(gone, 3, "new", "q", _now()), 4, None, None, _now())
    changed, row = store.update_row(pictured, 5, {"username": F.lit("renamed")})
    return changed.where("id < 200").unionAll(row).select("id", "username", "deleted_at", F.col("avatar.url").alias("avatar"), F.col("avatar.uploaded_at").alias("uploaded_at"))


CHANGES = f"""WITH {USERS}, c AS (SELECT id, CASE WHEN id = 5 THEN 'renamed' ELSE username END AS username, CASE WHEN id IN (1, 2) THEN TIMESTAMP '2024-02-02' ELSE deleted_at END AS deleted_at, CASE WHEN id = 3 THEN 'new' END AS avatar, CASE WHEN id = 3 THEN TIMESTAMP '{NOW}' END AS uploaded_at FROM users)
SELECT * FROM c WHERE id < 200 UNION ALL SELECT * FROM c WHERE id = 5"""


def route_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Notifications of events with the client that the user was connected with then."""
    kind = F.when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "error", "disconnect").otherwise("note")
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("client_id"), F.col("event_type").alias("payload"))
    return stateful.route_at_once(e, 7 * 86400).select("user_id", "seq", "client_id", "payload")


BY_TIME = """WITH e AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
c AS (SELECT user_id, g, event_type AS kind, 'c' || event_id % 5 AS client_id FROM e WHERE event_type IN ('signup', 'error'))
SELECT e.user_id, event_id AS seq, c.client_id, event_type AS payload FROM e JOIN c ON c.user_id = e.user_id AND c.g = e.g WHERE c.kind = 'signup' AND event_type NOT IN ('signup', 'error')"""

def thread_messages(spark: SparkSession, d: str) -> DataFrame:
    """Threads of conversations: every third turn's message comes again with a new text, and every fifth's is removed after that."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.concat(F.lit("m"), F.col("turn")).alias("message_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    first = c.withColumn("removed", F.lit(None).cast("boolean")).withColumn("seq", F.col("turn"))
    again = c.where("turn % 3 = 0").select("thread_id", "message_id", "turn", "role", F.concat(F.lit("new "), "text").alias("text"), F.lit(False).alias("removed"), (F.col("turn") + 1000).alias("seq"))
    gone = c.where("turn % 5 = 0").select("thread_id", "message_id", "turn", "role", "text", F.lit(True).alias("removed"), (F.col("turn") + 2000).alias("seq"))
    found = stateful.thread_messages_at_once(first.unionAll(again).unionAll(gone))
    return found.select("thread_id", "n", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")).alias("messages_md5"))


THREADS = """SELECT conv_id AS thread_id, count(*) FILTER (turn % 5 <> 0) AS n, md5(coalesce(string_agg(role || ':' || CASE WHEN turn % 3 = 0 THEN 'new ' ELSE '' END || text, chr(10) ORDER BY turn) FILTER (turn % 5 <> 0), '')) AS messages_md5 FROM conversations GROUP BY 1"""

QUERIES = {
    "thread_messages": Query(thread_messages, THREADS),
    "folder_category": Query(folder_category, FOLDER_CATEGORY),
    "file_metadata": Query(file_metadata, FILE_METADATA),
    "portal_fields": Query(portal_fields, PORTAL_FIELDS),
    "curriculum_fields": Query(curriculum_fields, CURRICULUM),
    "crawl_scores": Query(crawl_scores, SCORES),
    "chunk_contexts": Query(chunk_contexts, CONTEXTS),
    "final_top": Query(final_top, TOP),
    "curricula": Query(curricula, CURRICULA),
    "message_metadata": Query(message_metadata, MESSAGE),
    "user_changes": Query(user_changes, CHANGES),
    "route_by_time": Query(route_by_time, BY_TIME),
}

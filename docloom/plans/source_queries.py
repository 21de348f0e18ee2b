"""Queries of sources, sinks and small rules; ``documents``, ``benchmark`` and ``pages`` stand for the rows of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import quality, text, urls
from docloom.functions.fixed_values import RAW_EXTENSIONS
from docloom.operators import chunking, evalset, markdown, portal, stage_log
from docloom.plans.chunk_queries import MD, _md
from docloom.plans.log_queries import LOG, REINDEX, TYPES, _log
from docloom.plans.query import Query, read
from docloom.plans.stored import new_path
from docloom.plans.text_queries import STRIP_SQL, sql_list
from docloom.sources import best_first, files, sinks

ACCENT = "é"  # two code points that NFC makes one


def raw_file_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Three files a document id: two of its name and one that starts with it; some are of unknown kinds, some empty."""
    k, m = F.floor(F.col("doc_id") / 3).cast("long"), F.col("doc_id") % 3
    name, category = F.concat(F.lit("d"), F.lpad(k.cast("string"), 9, "0")), F.concat(F.lit("c"), (k % 5).cast("string"))
    ext = F.when(k % 4 == 0, F.when(m == 0, ".bin").otherwise(".log")).when(m == 0, ".docx").when(m == 1, ".pdf").otherwise(".txt")
    docs = read(spark, d, "documents").select(category.alias("category"), name.alias("document_id"), F.when(m == 2, F.concat(name, F.lit("-x"))).otherwise(name).alias("stem"), ext.alias("ext"), F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("n_chars")).alias("size"))
    found = docs.select("category", "stem", "ext", "size", F.concat("category", F.lit("/"), "stem", "ext").alias("path"))
    return files.find_raw(files.valid_files(found), docs.select("category", "document_id").distinct()).select("category", "document_id", "path")


RAW = f"""WITH f AS (SELECT 'c' || (k % 5) AS category, 'd' || lpad(CAST(k AS VARCHAR), 9, '0') AS document_id, CASE WHEN m = 2 THEN '-x' ELSE '' END AS tail, CASE WHEN k % 4 = 0 THEN CASE WHEN m = 0 THEN '.bin' ELSE '.log' END WHEN m = 0 THEN '.docx' WHEN m = 1 THEN '.pdf' ELSE '.txt' END AS ext,
CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars END AS size FROM (SELECT *, doc_id // 3 AS k, doc_id % 3 AS m FROM documents)),
p AS (SELECT *, document_id || tail AS stem, category || '/' || document_id || tail || ext AS path FROM f WHERE size > 0),
r AS (SELECT w.category, w.document_id, path, row_number() OVER (PARTITION BY w.category, w.document_id ORDER BY CASE WHEN stem = w.document_id THEN coalesce(nullif(list_position({sql_list(RAW_EXTENSIONS)}, ext), 0), 1000) ELSE 1000 END, path) AS n
FROM (SELECT DISTINCT category, document_id FROM f) w JOIN p ON p.category = w.category AND starts_with(p.stem, w.document_id)) SELECT category, document_id, path FROM r WHERE n = 1"""


def markdown_load(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents have metadata: with an id if of good quality, broken JSON if toxic."""
    path = lambda ext: F.concat(F.lit("/kb/c"), F.col("doc_id") % 4, F.lit("/d"), F.col("doc_id"), F.lit(ext))
    texts = read(spark, d, "documents").select(path(".md").alias("path"), F.replace("text", F.lit("e"), F.lit(ACCENT)).alias("value"))
    said = F.to_json(F.struct(F.when(F.col("quality") == 1, F.concat(F.lit("id"), F.col("doc_id"))).alias("document_id"), F.col("doc_id").alias("year")))
    meta = read(spark, d, "labels").select(path(".json").alias("path"), F.when(F.col("toxic") == 1, "{broken").otherwise(said).alias("value"))
    found = files.markdown_rows(texts, meta, "document_id string, year long")
    return found.select("category", "document_id", F.md5("text").alias("text_md5"), "year")


MARKDOWN = f"""SELECT 'c' || (doc_id % 4) AS category, CASE WHEN quality = 1 AND toxic <> 1 THEN 'id' || doc_id ELSE 'd' || doc_id END AS document_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS text_md5,
CASE WHEN toxic <> 1 THEN doc_id END AS year FROM documents LEFT JOIN labels USING (doc_id) WHERE {STRIP_SQL.format("text")} <> ''"""


def chunk_load(spark: SparkSession, d: str) -> DataFrame:
    """A chunk file for each document with both ways of naming chunks and documents; files of short texts are broken."""
    none = F.lit(None).cast("string")
    meta = F.struct(F.concat(F.lit("m"), F.col("doc_id")).alias("document_id"))
    chunk = lambda i, c, doc, t, at: F.struct(i.alias("id"), c.alias("chunk_id"), doc.alias("doc_id"), t.alias("text"), meta.alias("metadata"), F.lit(at).alias("start_char_idx"))
    both = F.array(chunk(F.concat(F.lit("a"), F.col("doc_id")), none, none, F.col("text"), 0), chunk(none, F.concat(F.lit("b"), F.col("doc_id")), F.col("source"), F.col("lang"), 5))
    rows = read(spark, d, "documents").select(F.when(F.length("text") < 200, "[{broken").otherwise(F.to_json(both)).alias("value"))
    return files.chunk_rows(rows).select("chunk_id", "document_id", F.md5("text").alias("text_md5"), "start_char_idx")


CHUNK_LOAD = """SELECT 'a' || doc_id AS chunk_id, 'm' || doc_id AS document_id, md5(text) AS text_md5, CAST(0 AS INT) AS start_char_idx FROM documents WHERE length(text) >= 200
UNION ALL SELECT 'b' || doc_id, source, md5(lang), CAST(5 AS INT) FROM documents WHERE length(text) >= 200"""


def test_set_load(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.concat(F.lit("q"), F.col("item_id")).alias("id"), F.col("text").alias("question"), F.upper("text").alias("ground_truth"))
    rows = read(spark, d, "benchmark").select(F.concat(F.lit("/t/group"), F.col("item_id"), F.lit(".json")).alias("path"), F.to_json(F.array(item, item)).alias("value"))
    return files.item_rows(rows.unionAll(spark.createDataFrame([("/t/group0x.json", "not json")], "path string, value string"))).select("file", "id", F.md5("question").alias("question_md5"))


ITEMS = "SELECT 'group' || item_id || '.json' AS file, 'q' || item_id AS id, md5(text) AS question_md5 FROM benchmark, range(2)"


def test_set_union(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select("item_id", "text")
    parts = {"group2.json": items.where("length(text) < 300"), "group1.json": items.where("length(text) >= 300")}
    return evalset.value_counts(evalset.union_files(parts), "file")


UNION = "SELECT CASE WHEN length(text) < 300 THEN 'group2.json' ELSE 'group1.json' END AS file, count(*) AS n FROM benchmark GROUP BY 1"


def nfc_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.nfc_changes(F.replace("text", F.lit("e"), F.lit(ACCENT))).alias("changes"))


CHANGES = """SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_zip(regexp_extract_all(t, '(?s).'), regexp_extract_all(nfc_normalize(t), '(?s).'), true), lambda z: CAST(z[1] <> z[2] AS INT))), 0) AS INT) AS changes
FROM (SELECT doc_id, replace(text, 'e', 'e' || chr(769)) AS t FROM documents)"""


def fences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    fenced = F.when(k == 0, F.concat(F.lit("```markdown\n"), F.col("text"), F.lit("\n```"))).when(k == 1, F.concat(F.lit('```json\n{"a": '), F.col("doc_id"), F.lit("}\n```"))).when(k == 2, F.concat(F.lit('{"a": '), F.col("doc_id"), F.lit("}"))).otherwise(F.col("text"))
    docs = read(spark, d, "documents").select("doc_id", fenced.alias("f"))
    return docs.select("doc_id", F.md5(text.strip_fence(F.col("f"))).alias("bare_md5"), text.parse_fenced_json(F.col("f"), "a long")["a"].alias("a"))


FENCES = """SELECT doc_id, md5(CASE WHEN doc_id % 4 IN (0, 3) THEN text ELSE '{"a": ' || doc_id || '}' END) AS bare_md5, CASE WHEN doc_id % 4 IN (1, 2) THEN doc_id END AS a FROM documents"""


def markdown_preclean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(markdown.preprocess(_md())).alias("text_md5"))


PRECLEAN = rf"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(md, chr(10)), lambda x: NOT regexp_matches(x, '^#{{1,6}}\s*$')), lambda x: regexp_replace(x, '^#{{1,6}}\s*(-|\*)\s+(.+)', '\1 \2')), chr(10))) AS text_md5 FROM {MD}"""


def metadata_flat(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return sinks.flat_metadata(docs.select("doc_id", "lang", F.array("lang", "source").alias("tags"), F.struct("lang", "n_chars").alias("info"), F.lit("2024-01-31").cast("date").alias("day"), (F.col("n_chars") > 500).alias("long")))


FLAT = """SELECT doc_id, lang, lang || ', ' || source AS tags, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS info, '2024-01-31' AS day, n_chars > 500 AS long FROM documents"""


def html_table_flatten(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit("<table><tr><th>Key</th><th>Lang</th></tr>\n<tr><td>"), F.col("doc_id"), F.lit("</td><td> <b>"), F.col("lang"), F.lit("</b></td></tr></table>"))
    rest = '<table><tr><td>x</td></tr></table> <table class="a"><tr><td>h</td></tr><tr><td>long enough text</td></tr></table>'
    docs = read(spark, d, "documents").select("doc_id", F.concat("text", one, "source", F.lit(rest)).alias("text"))
    return chunking.flatten_html_tables(docs).select("doc_id", F.md5("text").alias("text_md5"))


HTML_TABLES = """SELECT doc_id, md5(text || '- Key: ' || doc_id || '; Lang: ' || lang || source || '<table><tr><td>x</td></tr></table> <table class="a"><tr><td>h</td></tr><tr><td>long enough text</td></tr></table>') AS text_md5 FROM documents"""


def table_rows_completed(spark: SparkSession, d: str) -> DataFrame:
    """Tables of fifty customers with short rows, merged cells and headers among the rows."""
    k = F.col("c_custkey")
    row = F.when(k % 4 == 0, F.concat_ws("", F.lit("| "), k, F.lit(" | "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |"))).when(k % 4 == 1, F.concat_ws("", F.lit("| "), k, F.lit(" | "), "c_name", F.lit(" |")))
    row = row.when(k % 4 == 2, F.concat_ws("", F.lit("| | "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |"))).otherwise(F.concat(F.lit("### Title "), k))
    rows = read(spark, d, "customer").select(F.floor(k / 50).cast("long").alias("doc_id"), (k % 50 + 3).alias("ln"), row.alias("line"))
    head = rows.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(F.lit("note"), F.lit("| key | name | seg |"), F.lit("|---|---|---|"))).alias("ln", "line"))
    return markdown.complete_rows(rows.unionByName(head.withColumn("ln", F.col("ln").cast("long"))))


COMPLETED = """WITH c AS (SELECT c_custkey // 50 AS doc_id, c_custkey % 50 + 3 AS ln, c_custkey AS k, c_name AS name, c_mktsegment AS seg, CASE c_custkey % 4 WHEN 2 THEN NULL WHEN 3 THEN '**Title ' || c_custkey || '**' ELSE CAST(c_custkey AS VARCHAR) END AS own FROM customer),
a AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING), '') AS above FROM c)
SELECT doc_id, ln, '| ' || above || CASE k % 4 WHEN 1 THEN ' | ' || name || ' |  |' WHEN 3 THEN ' |  |  |' ELSE ' | ' || name || ' | ' || seg || ' |' END AS line FROM a
UNION ALL SELECT DISTINCT c_custkey // 50, n, CASE n WHEN 0 THEN 'note' WHEN 1 THEN '| key | name | seg |' ELSE '|---|---|---|' END FROM customer, range(3) t(n)"""


def artifact_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts by language written once, then those of one language again; the others stay."""
    path, docs = new_path(spark, "artifact"), read(spark, d, "documents").select("doc_id", "text", "lang")
    sinks.write_artifact(docs, path, "lang")
    sinks.write_artifact(docs.where("lang = 'de'").withColumn("text", F.concat(F.lit("new "), "text")), path, "lang")
    return spark.read.schema("doc_id long, text string, lang string").parquet(path).select("doc_id", "lang", F.md5("text").alias("text_md5"))


ARTIFACT = "SELECT doc_id, lang, md5(CASE WHEN lang = 'de' THEN 'new ' || text ELSE text END) AS text_md5 FROM documents"


def chunk_write(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "chunks")
    sinks.write_chunks(read(spark, d, "documents").select("doc_id", "text", F.array("lang", "source").alias("tags")), path)
    return spark.read.schema("doc_id long, text string, tags array<string>").json(path).select("doc_id", F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"))


CHUNK_WRITE = "SELECT doc_id, md5(text) AS text_md5, lang || ',' || source AS tags FROM documents"


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An index of all documents, then those of low quality put in again with new texts."""
    path, docs = new_path(spark, "index"), read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    low = read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    sinks.upsert_index(docs, path)
    sinks.upsert_index(docs.join(low, "document_id", "left_semi").withColumn("text", F.concat(F.lit("new "), "text")), path)
    return spark.read.schema("document_id long, text string, part int").parquet(path).select("document_id", F.md5("text").alias("text_md5"))


def insert_many(spark: SparkSession, d: str) -> DataFrame:
    now, docs = F.lit("2024-02-01").cast("timestamp_ntz"), read(spark, d, "documents")
    held = docs.select("doc_id", F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return sinks.insert_many(sinks.insert_many(held, read(spark, d, "labels").select("doc_id"), now), sinks.clear(docs.select("doc_id")), now)


INSERT = "SELECT doc_id, CAST(NULL AS TIMESTAMP) AS created_at FROM documents UNION ALL SELECT doc_id, TIMESTAMP '2024-02-01' FROM labels"


#: The crawl's rules on the driver's URLs: what is important, what is not, and the weights of paths.
PATHS = [("/en/", 50), ("/de/", 40), ("/fr/", 30)]


def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """A best-first crawl over the pages: links go to the pages that their hrefs' checksums name, under two domains, to depth 4 and 60 pages."""
    pages = read(spark, d, "pages").select("page_id", "url")
    hrefs = portal.html_links(read(spark, d, "pages")).select("page_id", (F.conv(F.substring(F.md5(F.col("href").cast("binary")), 1, 6), 16, 10).cast("long") % pages.count()).alias("to"))
    links = hrefs.join(pages, "page_id").join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("href")), "to").select("url", "href")
    score = lambda u: urls.priority(u, PATHS, [("ref=", 5)]) / 100
    keep = lambda u: urls.is_important(u, ["/en/", "/de/", "/fr/"], [r"\?page=\d+"], [r"\d"]) & ~urls.is_node(u)
    return best_first.crawl_best_first(pages.where("page_id < 5").select("url"), links, score, 4, 60, 10, best_first.in_domains("example.com", "example.net"), keep)


#: One row a step: what was taken, and the frontier as a list.
FRONTIER = r"""WITH RECURSIVE e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT DISTINCT p.url, t.url AS href FROM (SELECT page_id, CAST('0x' || substr(md5(href), 1, 6) AS BIGINT) % (SELECT count(*) FROM pages) AS k FROM e) x JOIN pages p USING (page_id) JOIN pages t ON t.page_id = k
  WHERE regexp_matches(t.url, '^[A-Za-z]+://([^/?#]*\.)?example\.(com|net)(:\d+)?([/?#]|$)')),
r AS (SELECT url, greatest(0, least(100, CASE WHEN contains(url, '/en/') THEN 50 WHEN contains(url, '/de/') THEN 40 WHEN contains(url, '/fr/') THEN 30 ELSE 0 END + CASE WHEN contains(url, 'ref=') THEN 5 ELSE 0 END - CASE WHEN length(url) > 150 THEN 20 ELSE 0 END)) / 100 AS priority FROM pages),
n AS (SELECT url, priority FROM (SELECT DISTINCT * FROM r)), a AS (SELECT l.url, list(struct_pack(p := -priority, u := href)) AS out FROM l JOIN n ON n.url = href GROUP BY 1),
w AS (SELECT 0 AS step, [struct_pack(p := CAST(NULL AS DOUBLE), d := 0, u := 'x')][1:0] AS taken, list(DISTINCT struct_pack(p := -priority, d := 0, u := pages.url)) AS front FROM pages JOIN n USING (url) WHERE page_id < 5
  UNION ALL SELECT step + 1, taken || list_sort(front)[1:least(10, 60 - len(taken))], (SELECT coalesce(list(struct_pack(p := p, d := d, u := u)), [struct_pack(p := CAST(NULL AS DOUBLE), d := 0, u := 'x')][1:0]) FROM
    (SELECT p, min(d) AS d, u FROM (SELECT unnest(list_sort(front)[least(10, 60 - len(taken)) + 1:], recursive := true) UNION ALL SELECT o.p, o.d, o.u FROM (SELECT unnest(a.out).p AS p, x.d + 1 AS d, unnest(a.out).u AS u FROM (SELECT unnest(list_sort(front)[1:least(10, 60 - len(taken))], recursive := true)) x JOIN a ON a.url = x.u WHERE x.d < 4) o) z
      WHERE NOT list_contains(list_transform(taken || list_sort(front)[1:least(10, 60 - len(taken))], lambda y: y.u), u) GROUP BY p, u))
  FROM w WHERE len(taken) < 60 AND len(front) > 0),
o AS (SELECT unnest(taken) AS t, generate_subscripts(taken, 1) - 1 AS seq FROM w WHERE step = (SELECT max(step) FROM w))
SELECT t.u AS url, CAST(t.d AS INT) AS depth, -t.p AS priority, CAST(seq AS INT) AS seq, true AS fetched, NOT regexp_matches(t.u, '\?page=\d+') AND regexp_matches(t.u, '/(en|de|fr)/') AND NOT regexp_matches(t.u, '/node/\d+') AS kept FROM o"""


def crawled_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("url", F.col("html").alias("text"), F.concat(F.lit("Page "), F.col("page_id")).alias("title"))
    return sinks.crawled_pages(pages, F.lit("2024-02-01").cast("timestamp_ntz")).select("folder", F.md5("text").alias("text_md5"), "metadata.original_url", "metadata.title", "metadata.crawled_at")


CRAWLED = r"""SELECT CASE WHEN p = '' THEN 'root' ELSE replace(p, '/', '-') END AS folder, md5(html) AS text_md5, url AS original_url, 'Page ' || page_id AS title, TIMESTAMP '2024-02-01' AS crawled_at
FROM (SELECT *, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS p FROM pages)"""


def evaluation_json(spark: SparkSession, d: str) -> DataFrame:
    scores = read(spark, d, "labels").select("quality", "toxic")
    means = evalset.metric_means(scores, ["quality", "toxic"]).withColumn("mean", F.round("mean", 3))
    return evalset.evaluation_json(scores, means, "2024-02-01", "http://localhost/ask")


EVALUATION = """SELECT '{"metadata":{"timestamp":"2024-02-01","test_set_size":' || count(*) || ',"api_endpoint":"http://localhost/ask"},"average_scores":{"quality":' || round(avg(coalesce(quality, 0)), 3) || ',"toxic":' || round(avg(coalesce(toxic, 0)), 3) || '}}' AS value FROM labels"""


def stage_range_rows(spark: SparkSession, d: str) -> DataFrame:
    state = stage_log.current_state(_log(spark, d))
    return state.where(F.col("stage").isin(stage_log.stage_range("click", "purchase", TYPES))).groupBy("stage", "status").agg(F.count("*").alias("n"))


RANGE = f"WITH {LOG} SELECT stage, status, count(*) AS n FROM state WHERE stage IN ('click', 'signup', 'purchase') GROUP BY ALL"


def document_gates(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts too short get those of OCR; what is long enough is worth distilling."""
    read_again = files.with_ocr(read(spark, d, "documents").select("doc_id", "text", "lang"), F.concat(F.lit("ocr "), "lang"), 300)
    return read_again.select("doc_id", F.md5("text").alias("text_md5"), quality.worth_distilling(F.length("text")).alias("distil"))


GATES = f"""SELECT doc_id, md5(t) AS text_md5, length(t) >= 2000 AS distil FROM (SELECT doc_id, CASE WHEN length({STRIP_SQL.format("text")}) < 300 THEN 'ocr ' || lang ELSE text END AS t FROM documents)"""


def category_list(spark: SparkSession, d: str) -> DataFrame:
    return files.categories(read(spark, d, "documents").select(F.col("source").alias("category")))


QUERIES = {
    "raw_file_lookup": Query(raw_file_lookup, RAW),
    "markdown_load": Query(markdown_load, MARKDOWN),
    "chunk_load": Query(chunk_load, CHUNK_LOAD),
    "test_set_load": Query(test_set_load, ITEMS),
    "test_set_union": Query(test_set_union, UNION),
    "nfc_change_counts": Query(nfc_change_counts, CHANGES),
    "fences": Query(fences, FENCES),
    "markdown_preclean": Query(markdown_preclean, PRECLEAN),
    "metadata_flat": Query(metadata_flat, FLAT),
    "html_table_flatten": Query(html_table_flatten, HTML_TABLES),
    "table_rows_completed": Query(table_rows_completed, COMPLETED),
    "artifact_overwrite": Query(artifact_overwrite, ARTIFACT),
    "chunk_write": Query(chunk_write, CHUNK_WRITE),
    "index_upsert": Query(index_upsert, REINDEX),
    "insert_many": Query(insert_many, INSERT),
    "crawled_pages": Query(crawled_pages, CRAWLED),
    "crawl_frontier": Query(crawl_frontier, FRONTIER),
    "evaluation_json": Query(evaluation_json, EVALUATION),
    "stage_range_rows": Query(stage_range_rows, RANGE),
    "document_gates": Query(document_gates, GATES),
    "category_list": Query(category_list, "SELECT DISTINCT source AS category FROM documents"),
}

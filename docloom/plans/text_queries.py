"""Queries of text, quality, metadata and URL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import metadata, quality, text, urls
from docloom.operators import markdown
from docloom.plans.query import Query, read

#: Spelling pairs that the driver's data has.
PAIRS = [("the", "THEx"), ("und", "UNDx"), ("de", "DEx"), ("les", "LESx")]
STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def nfc_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = text.nfc("text")
    return read(spark, d, "documents").select("doc_id", F.md5(n).alias("nfc_md5"), F.length(n).alias("n"))


NFC = "SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5, CAST(length(nfc_normalize(text)) AS INT) AS n FROM documents"


def spelling_modernize(spark: SparkSession, d: str) -> DataFrame:
    new, counts = text.modernise(F.col("text"), PAIRS)
    return read(spark, d, "documents").select("doc_id", F.md5(new).alias("text_md5"), sum(counts, F.lit(0)).alias("total_corrections"), (sum(counts, F.lit(0)) > 0).alias("has_changes"))


def _spelling_sql() -> str:
    # RE2 has no look-around: two passes catch neighbours that share a separator.
    inner, counts = "text", []
    for old, new in PAIRS:
        once = "regexp_replace({0}, '(^|[^\\pL\\pN_])" + old + "([^\\pL\\pN_]|$)', '\\1" + new + "\\2', 'g')"
        inner = once.format(once.format(inner))
        counts.append(f"(length(x) - length(replace(x, '{new}', ''))) // {len(new)}")
    total = " + ".join(counts)
    return f"SELECT doc_id, md5(x) AS text_md5, CAST({total} AS INT) AS total_corrections, {total} > 0 AS has_changes FROM (SELECT doc_id, {inner} AS x FROM documents)"


def text_names(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", text.short_hash(c).alias("hash16"), text.session_title(c).alias("title"), text.word_title(c).alias("word_title"), F.md5(text.collapse(c)).alias("collapsed_md5"), F.size(text.words(c)).alias("words"),
        text.truncate_header(c, "curriculum").alias("header"),
    )


TEXT_NAMES = rf"""SELECT doc_id, sha256(text)[1:16] AS hash16, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS title,
CASE WHEN length(text) > 50 THEN regexp_replace(text[1:50], ' [^ ]*$', '') || '...' ELSE text END AS word_title,
md5({STRIP_SQL.format(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS collapsed_md5,
CAST(CASE WHEN {STRIP_SQL.format("text")} = '' THEN 0 ELSE len(string_split_regex({STRIP_SQL.format("text")}, '\s+')) END AS INT) AS words,
CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS header FROM documents"""


def _letterhead(c: Column) -> Column:
    """A notice with or without a letterhead, start marker and end text, by document."""
    kind = F.col("doc_id") % 4
    return F.concat(
        F.when(kind == 0, "Số: 12\n----\n").when(kind == 1, "  ## Trường Đại học X\nrest\n").otherwise("Plain\n"), F.when(kind == 1, "no marker\n").otherwise("# THÔNG BÁO "), F.col("source"), F.lit("\n"), c, F.when(kind == 2, "\nBack to top\nfooter").otherwise("\n\n tail ")
    )


LETTERHEAD_SQL = r"""concat(CASE doc_id % 4 WHEN 0 THEN 'Số: 12' || chr(10) || '----' || chr(10) WHEN 1 THEN '  ## Trường Đại học X' || chr(10) || 'rest' || chr(10) ELSE 'Plain' || chr(10) END,
CASE doc_id % 4 WHEN 1 THEN 'no marker' || chr(10) ELSE '# THÔNG BÁO ' END, source, chr(10), text, CASE doc_id % 4 WHEN 2 THEN chr(10) || 'Back to top' || chr(10) || 'footer' ELSE chr(10) || chr(10) || ' tail ' END)"""


def clean_main_content(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", _letterhead(F.col("text")).alias("md"))
    bare = markdown.remove_letterhead(F.col("md"))
    done = docs.select("doc_id", F.length("md").alias("n_in"), bare.alias("bare")).select("doc_id", "n_in", "bare", markdown.main_content(F.col("bare")).alias("main"))
    return done.select("doc_id", "n_in", F.md5("bare").alias("bare_md5"), F.md5("main").alias("main_md5"), F.length("main").alias("n_out"), (F.col("n_in") - F.length("main")).alias("reduction"))


def _clean_sql() -> str:
    start = "(?i)^#\\s*(QUYẾT ĐỊNH|THÔNG BÁO|CÔNG VĂN|THÔNG TIN|QUY ĐỊNH|QUY CHẾ)"
    head = "(?i)" + "|".join(V.LETTERHEAD)
    ends = " OR ".join(f"contains(x, '{e}')" for e in V.CONTENT_END)
    strip = STRIP_SQL
    return f"""WITH md AS (SELECT doc_id, {LETTERHEAD_SQL} AS md FROM documents), l AS (SELECT *, string_split(md, chr(10)) AS raw, list_transform(string_split(md, chr(10)), lambda x: {strip.format("x")}) AS st FROM md),
s AS (SELECT *, len(list_filter(st[1:10], lambda x: regexp_matches(x, '{head}'))) > 0 AS has_head, coalesce(list_position(list_transform(st, lambda x: regexp_matches(x, '{start}')), true), 0) AS pos FROM l),
b AS (SELECT doc_id, md, CASE WHEN has_head THEN CASE WHEN pos > 0 THEN {strip.format("array_to_string(raw[pos:], chr(10))")} ELSE '' END ELSE md END AS bare FROM s),
t AS (SELECT doc_id, md, bare, list_transform(string_split(bare, chr(10)), lambda x: {strip.format("x")}) AS st FROM b),
h AS (SELECT *, coalesce(list_position(list_transform(st, lambda x: starts_with(x, '# ')), true), 0) AS pos FROM t),
e AS (SELECT *, CASE WHEN pos > 0 THEN st[pos:] END AS body, coalesce(list_position(list_transform(st[pos + 1:], lambda x: ({ends})), true), 0) AS fin FROM h),
m AS (SELECT doc_id, length(md) AS n_in, bare, CASE WHEN pos > 0 THEN {strip.format("array_to_string(list_filter(CASE WHEN fin > 0 THEN body[1:fin] ELSE body END, lambda x: x <> ''), chr(10))")} ELSE '' END AS main FROM e)
SELECT doc_id, CAST(n_in AS INT) AS n_in, md5(bare) AS bare_md5, md5(main) AS main_md5, CAST(length(main) AS INT) AS n_out, CAST(n_in - length(main) AS INT) AS reduction FROM m"""


def content_hard_rules(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.coalesce(quality.hard_rule(F.col("text")), F.lit("passed")).alias("reason"))


def _rules_sql() -> str:
    any_of = lambda ks: " + ".join(f"CAST(contains(lower(c), '{k}') AS INT)" for k in ks)
    return rf"""SELECT doc_id, CASE WHEN c = '' THEN 'empty_content' WHEN length(c) < {V.MIN_LENGTH} THEN 'too_short' WHEN {any_of(V.ERROR_KEYWORDS)} > 0 THEN 'error_page' WHEN {any_of(V.NAVIGATION_KEYWORDS)} >= 3 THEN 'navigation_page'
WHEN len(regexp_extract_all(c, '\[.*?\]\(.*?\)')) / len(string_split_regex(c, '\s+')) > {V.MAX_LINK_SHARE} THEN 'too_many_links'
WHEN len(list_filter(l, lambda x: starts_with(x, '#'))) / len(list_filter(l, lambda x: x <> '')) > {V.MAX_HEADER_SHARE} THEN 'only_headers' ELSE 'passed' END AS reason
FROM (SELECT doc_id, c, list_transform(string_split(c, chr(10)), lambda x: {STRIP_SQL.format("x")}) AS l FROM (SELECT doc_id, {STRIP_SQL.format("text")} AS c FROM documents))"""


def content_score(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "documents").select("doc_id", quality.stats(F.col("text")).alias("s"))
    return m.select("doc_id", "s.length", "s.word_count", "s.paragraph_count", "s.meaningful_words", F.round(F.col("s.score") * 10000).cast("long").alias("score_e4"))


def _score_sql() -> str:
    stops = sql_list([w for w in V.STOP_WORDS if len(w) > 3])
    keys = " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in V.USEFUL_KEYWORDS)
    return rf"""SELECT doc_id, CAST(length(text) AS INT) AS length, CAST(n AS INT) AS word_count, CAST(p AS INT) AS paragraph_count, CAST(m AS INT) AS meaningful_words,
CAST(round(10000 * least(least(n / 300, 1.0) * 30 + least(p / 10, 1.0) * 20 + CASE WHEN n > 0 THEN m / n ELSE 0 END * 30 + least(k / 5, 1.0) * 20, 100.0)) AS BIGINT) AS score_e4
FROM (SELECT doc_id, text, CASE WHEN {STRIP_SQL.format("text")} = '' THEN 0 ELSE len(string_split_regex({STRIP_SQL.format("text")}, '\s+')) END AS n, len(regexp_extract_all(text, '\n\n')) + 1 AS p,
len(list_filter(string_split_regex(regexp_replace(lower(text), '[^{V.LETTERS}\s]', '', 'g'), '\s+'), lambda w: length(w) > 3 AND NOT list_contains({stops}, w))) AS m, {keys} AS k FROM documents)"""


def content_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    why = F.coalesce(F.regexp_extract(quality.rejection(F.col("text")), "^([a-z_]+?)(?:_[0-9.]+)?$", 1), F.lit("accepted"))
    return read(spark, d, "documents").groupBy("lang", why.alias("reason")).agg(F.count("*").alias("n"))


def _summary_sql() -> str:
    return f"""SELECT lang, CASE WHEN r.reason <> 'passed' THEN r.reason WHEN s.score_e4 < 400000 THEN 'low_score' ELSE 'accepted' END AS reason, count(*) AS n
FROM documents JOIN ({_rules_sql()}) r USING (doc_id) JOIN ({_score_sql().replace("FROM documents)", "FROM (SELECT doc_id, " + STRIP_SQL.format("text") + " AS text FROM documents))")}) s USING (doc_id) GROUP BY ALL"""


IMPORTANT, EXCLUDED, YEARS = ["/en/", "/de/"], [r"\?page=\d+", r"\.html"], ["2022", "2023", "2024", "2025"]
WEIGHTS, BONUS = [("/en/", 50), ("/de/", 45), ("/fr/", 95)], [("25", 30), ("24", 20)]


def url_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    pages = read(spark, d, "pages").select("page_id", "url")
    host = urls.netloc(u)
    return pages.select(
        "page_id", urls.is_important(u, IMPORTANT, EXCLUDED, YEARS).alias("important"), urls.priority(u, WEIGHTS, BONUS, 40).alias("priority"), urls.is_node(u).alias("is_node"), urls.folder_name(u).alias("folder"), host.alias("host"),
        (host == F.lit("tionsh.example.net")).alias("same"), urls.category(urls.folder_name(u)).alias("category"),
    )


def _urls_sql() -> str:
    path = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g')"
    folder = f"CASE WHEN {path} = '' THEN 'root' ELSE replace({path}, '/', '-') END"
    host = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    weight = " ".join(f"WHEN regexp_matches(url, '(?i){p}') THEN {w}" for p, w in WEIGHTS)
    bonus = " ".join(f"WHEN contains(url, '{y}') THEN {b}" for y, b in BONUS)
    category = " ".join(f"WHEN regexp_matches(lower({folder}), '{'|'.join(ps)}') THEN '{c}'" for c, ps in V.CATEGORY_PATTERNS)
    return rf"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i){"|".join(EXCLUDED)}') THEN false WHEN regexp_matches(url, '(?i){"|".join(IMPORTANT)}') THEN NOT regexp_matches(url, '\d{{4}}') OR regexp_matches(url, '{"|".join(YEARS)}') ELSE false END AS important,
CAST(greatest(0, least(100, CASE {weight} ELSE 0 END + CASE {bonus} ELSE 0 END - CASE WHEN length(url) > 40 THEN 20 ELSE 0 END)) AS INT) AS priority,
regexp_matches(url, '/node/\d+') AS is_node, {folder} AS folder, {host} AS host, {host} = 'tionsh.example.net' AS same, CASE {category} ELSE 'other' END AS category FROM pages"""


def absolutize_links(spark: SparkSession, d: str) -> DataFrame:
    from docloom.operators.portal import html_links

    pages = read(spark, d, "pages")
    links = html_links(pages).join(pages.select("page_id", urls.netloc(F.col("url")).alias("host")), "page_id")
    return links.select("page_id", "n", urls.absolute(F.col("href"), F.col("host")).alias("href"), urls.is_download(F.col("href")).alias("download"))


LINKS = r"""SELECT page_id, CAST(i - 1 AS INT) AS n, CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN 'https://' || host || h ELSE 'https://' || host || '/' || h END AS href, regexp_matches(h, '(?i)\.(pdf|docx?|xlsx?)$') AS download
FROM (SELECT page_id, host, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages))"""

def number_parsing(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.regexp_extract("url", r"([0-9.]*)(?:\.html|/)?(?:[?#].*)?$", 1), F.lit("\n"))
    pages = read(spark, d, "pages").select("page_id", raw.alias("raw"))
    return pages.select("page_id", text.parse_int(F.col("raw")).alias("as_int"), text.parse_float(F.col("raw")).alias("as_float"), text.clean_null(F.when(F.col("page_id") % 3 == 0, "N/A").otherwise(text.strip(F.col("raw")))).alias("cleaned"))


NUMBERS = rf"""SELECT page_id, CASE WHEN regexp_full_match(s, '[+-]?\d+') THEN CAST(s AS INT) END AS as_int, CASE WHEN regexp_full_match(s, '[+-]?(\d+\.?\d*|\.\d+)') THEN CAST(s AS DOUBLE) END AS as_float, CASE WHEN page_id % 3 = 0 THEN NULL ELSE s END AS cleaned
FROM (SELECT page_id, {STRIP_SQL.format(r"' ' || regexp_extract(url, '([0-9.]*)(?:\.html|/)?(?:[?#].*)?$', 1) || chr(10)")} AS s FROM pages)"""


def context_headers(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    none = F.lit(None).cast("string")
    meta = {"effective_date": none, "document_type": F.when(F.col("doc_id") % 2 == 0, "update").otherwise("other"), "major": F.col("lang"), "year": F.lit(2024), "program_type": none, "program_name": F.lit("")}
    category = F.when(F.col("doc_id") % 3 == 0, "regulation").when(F.col("doc_id") % 3 == 1, "curriculum").otherwise("other")
    said = metadata.context_header(F.concat(F.col("source"), F.lit("-one.md")), none, F.when(F.col("doc_id") % 5 == 0, "TITLE").otherwise(F.col("lang")), category, meta, F.col("text"))
    return docs.select("doc_id", F.md5(said).alias("said_md5"))


CONTEXT = """SELECT doc_id, md5(concat_ws(chr(10), 'Tài liệu: ' || upper(source[1]) || source[2:] || ' One', CASE WHEN doc_id % 5 <> 0 THEN 'Phần: ' || lang END,
CASE WHEN doc_id % 3 = 0 THEN 'Loại: ' || CASE WHEN doc_id % 2 = 0 THEN 'Văn bản sửa đổi' ELSE 'other' END END, CASE WHEN doc_id % 3 = 1 THEN 'Ngành: ' || lang END, CASE WHEN doc_id % 3 = 1 THEN 'Năm: 2024' END) || chr(10) || '---' || chr(10) || text) AS said_md5 FROM documents"""


MEANINGS = {"THE": "definite article", "OF": "belonging to", "DER": "Artikel", "QUE": "", "UIT": "University"}


def acronym_expand(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark")
    return items.select("item_id", F.md5(text.expand_acronyms(F.col("text"), MEANINGS)).alias("expanded_md5"), F.array_join(text.unknown_acronyms(F.col("text"), MEANINGS), ",").alias("unknown"))


def _acronym_sql() -> str:
    """Every word by itself: no meaning has an acronym among its words, so the order of replacing doesn't matter."""
    word = "regexp_full_match(w, '[A-ZĐÂĂÊÔƠƯa-zđâăêôơư]{2,}')"
    known = sql_list(list(MEANINGS))
    first = ", ".join(f"list_filter(c, lambda w: upper(w) = '{k}')[1] AS f{i}" for i, (k, m) in enumerate(MEANINGS.items()) if m)
    cases = " ".join(f"WHEN upper(w) = '{k}' AND f{i} IS NOT NULL THEN f{i} || ' ({m})'" for i, (k, m) in enumerate(MEANINGS.items()) if m)
    return rf"""WITH p AS (SELECT item_id, string_split(regexp_replace(text, '([\pL\pM\pN_]+)', chr(31) || '\1' || chr(31), 'g'), chr(31)) AS parts FROM benchmark),
c AS (SELECT *, list_filter(parts, lambda w: {word} AND ((w = upper(w) AND w <> lower(w)) OR (w = lower(w) AND length(w) <= 5 AND list_contains({known}, upper(w))))) AS c FROM p), f AS (SELECT *, {first} FROM c)
SELECT item_id, md5(array_to_string(list_transform(parts, lambda w: CASE {cases} ELSE w END), '')) AS expanded_md5, array_to_string(list_sort(list_distinct(list_filter(c, lambda w: NOT list_contains({known}, upper(w))))), ',') AS unknown FROM f"""


def cookie_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", F.concat(F.lit(" a="), F.col("user_id"), F.lit("; bad; t = x=y;e="), F.col("event_type")).alias("c"))
    parsed = rows.withColumn("p", metadata.parse_cookies(F.col("c")))
    return parsed.select("event_id", F.size("p").alias("n"), metadata.format_cookies(F.col("p")).alias("cookies"))


COOKIES = "SELECT event_id, CAST(3 AS INT) AS n, 'a=' || user_id || '; t = x=y; e=' || event_type AS cookies FROM events"

QUERIES = {
    "nfc_normalize": Query(nfc_normalize, NFC),
    "spelling_modernize": Query(spelling_modernize, _spelling_sql()),
    "text_names": Query(text_names, TEXT_NAMES),
    "clean_main_content": Query(clean_main_content, _clean_sql()),
    "content_hard_rules": Query(content_hard_rules, _rules_sql()),
    "content_score": Query(content_score, _score_sql()),
    "content_filter_summary": Query(content_filter_summary, _summary_sql()),
    "url_rules": Query(url_rules, _urls_sql()),
    "absolutize_links": Query(absolutize_links, LINKS),
    "number_parsing": Query(number_parsing, NUMBERS),
    "context_headers": Query(context_headers, CONTEXT),
    "acronym_expand": Query(acronym_expand, _acronym_sql()),
    "cookie_fields": Query(cookie_fields, COOKIES),
}

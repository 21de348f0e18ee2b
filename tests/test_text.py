"""Expected values of text, quality, metadata and URL functions."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import metadata, quality, text, urls
from docloom.operators import retrieval


@pytest.fixture
def one(spark):
    def run(value, f, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y

    return run


@pytest.mark.parametrize(
    "value,category,want",
    [
        ("Điều 1. Phạm vi điều chỉnh", "regulation", "Điều 1"), ("1. Văn bản này quy định...", "regulation", "Khoản 1"), ("a. Short text", "regulation", "Mục a"), ("CHƯƠNG IV - X", "regulation", "CHƯƠNG IV"), ("x" * 90, "regulation", "x" * 80 + "..."),
        ("1.1. Mục tiêu đào tạo", "curriculum", "1.1. Mục tiêu đào tạo"), ("y" * 81, "curriculum", "y" * 80 + "..."),
    ],
)
def test_truncate_header(one, value, category, want):
    assert one(value, lambda c: text.truncate_header(c, category)) == want


@pytest.mark.parametrize("name,want", [("01-quyet-dinh-ve-viec", "regulation"), ("thongbao-quy-trinh-bao-nghi", "regulation"), ("thong-bao-lich-thi", "announcement"), ("x", "other")])
def test_category(one, name, want):
    assert one(name, urls.category) == want


@pytest.mark.parametrize("url,want", [("/thong-bao/2019/x", False), ("/thong-bao/2024/x", True), ("/node/12", False), ("/thong-bao/x", True), ("/x", False)])
def test_importance(one, url, want):
    assert one(url, urls.is_important) is want


def test_priority(one):
    assert one("/thong-bao/2025/x", urls.priority) == 80
    assert one("/x/" + "a" * 200, urls.priority) == 0
    assert one("/quy-dinh/2024/2025", urls.priority) == 75


def test_folder_names_and_links(one):
    assert one("https://a.b:80/x/y/?q#f", urls.folder_name) == "x-y"
    assert one("https://a.b", urls.folder_name) == "root"
    assert one("https://a.b:80/x", urls.netloc) == "a.b:80"
    assert [one(h, lambda c: urls.absolute(c, F.lit("d"))) for h in ("http://x", "/y", "z")] == ["http://x", "https://d/y", "https://d/z"]
    assert one("A.PDF", urls.is_download) and not one("a.pdf.html", urls.is_download)


def test_small_parsers(one):
    assert [one(x, text.parse_int) for x in ("12", " 12\n", "", "-", "1.5", None)] == [12, 12, None, None, None, None]
    assert [one(x, text.parse_float) for x in ("8.5", " 7 ", "-", "x", None)] == [8.5, 7.0, None, None, None]
    assert [one(x, text.clean_null) for x in ("None", "n/a", "NULL", "x")] == [None, None, None, "x"]
    assert [one(x, text.collapse) for x in ("", " a \n b ", "  ", None)] == [None, "a b", "", None]
    assert one("abc", text.short_hash) == "ba7816bf8f01cfea"
    assert one("# T one \n# U", text.title_of) == "T one"
    assert one("```json\n{\"a\": 3}\n```", lambda c: text.parse_fenced_json(c, "a int")["a"]) == 3
    assert one("```\nx\ny\n```", text.strip_fence) == "x\ny" and one("x", text.strip_fence) == "x"


def test_nfc(one):
    assert one("é", text.nfc) == "é" and one("é", text.nfc_changes) == 1 and one("plain", text.nfc_changes) == 0


def test_spelling(one):
    got = one("khoá học toá Khoá khoác", lambda c: F.struct(text.modernise(c)[0].alias("t"), sum(text.modernise(c)[1], F.lit(0)).alias("n")))
    assert (got.t, got.n) == ("khóa học tóa Khóa khoác", 3)


def test_strip_metadata(one):
    assert one("Tài liệu: x\n---\nBody", text.strip_metadata) == "Body"
    table = "# T\n\n|a|b|\n|---|---|\n|1|2|"
    assert one(table, lambda c: text.strip_metadata(c, "first_dashes")) == "|---|\n|1|2|"
    assert one(table, text.strip_metadata) == table


def test_acronyms(one):
    meanings = {"TN": "Tốt nghiệp", "UIT": "Trường", "XX": ""}
    assert one("điều kiện TN", lambda c: text.expand_acronyms(c, meanings)) == "điều kiện TN (Tốt nghiệp)"
    assert one("uit và UIT", lambda c: text.expand_acronyms(c, meanings)) == "uit (Trường) và uit (Trường)"
    assert one("TN ZZZ", lambda c: text.expand_acronyms(c, meanings, partial=False)) is None
    assert one("TN XX ZZZ", lambda c: text.unknown_acronyms(c, meanings)) == ["ZZZ"]
    assert one("no such", lambda c: text.expand_acronyms(c, meanings)) == "no such"


@pytest.mark.parametrize(
    "name,code,date", [("828_qd-dhcntt_04-10-2022_x", "828/QD-DHCNTT", "2022-10-04"), ("108-qd-dhcntt15-3-2019_x", "108/QD-DHCNTT", "2019-03-15"), ("790-qd-dhcntt_28-9-22_x", "790/QD-DHCNTT", "2022-09-28"), ("x__y", None, None)]
)
def test_file_names(one, name, code, date):
    assert one(name, metadata.regulation_code_of_name) == code and one(name, metadata.date_of_name) == date


def test_portal_fields(one):
    assert one("HK 1 NĂM 2025 - 2026", metadata.semester) is None
    assert one("Học kỳ 2 - Năm học 2024-2025", metadata.semester) == "HK2 năm học 2024-2025"
    assert one("MSSV: 23520819", metadata.student_id) == "23520819"
    assert one("Theo 35/QĐ-ĐHCNTT ngày", metadata.regulation_code_of_text) == "35/QĐ-ĐHCNTT"
    assert one("khoa-19-2024", lambda c: metadata.curriculum_year(c, F.lit("năm 2020"))) == 2024
    assert one("x", lambda c: metadata.curriculum_year(c, F.lit("năm 2020"))) == 2020
    assert one("Khoa học Máy tính", metadata.major_code) == "KHMT" and one("?", metadata.major_code) is None
    assert one("a=1; b = 2=3;bad", metadata.parse_cookies) == [("a", "1"), ("b ", " 2=3")]


@pytest.mark.parametrize(
    "query,want",
    [
        ("điều kiện TN ngành Khoa học máy tính", "khoa-hoc-may-tinh"), ("CTDT KHMT năm 2022", "khoa-hoc-may-tinh"), ("số tín chỉ ngành Hệ thống thông tin trường Đại học Công nghệ Thông tin", "he-thong-thong-tin"), ("học phí năm 2024", None),
        ("có hai học kỳ", "tri-tue-nhan-tao"),
    ],
)
def test_programs(one, query, want):
    assert one(query, retrieval.detect_program) == want


@pytest.mark.parametrize(
    "value,want",
    [("", "empty_content"), ("x" * 99, "too_short"), ("Page not found " * 10, "error_page"), ("login sitemap đăng nhập " * 6, "navigation_page"), ("[a](b) " * 40, "too_many_links"), ("# a b c d e\n" * 20, "only_headers"), ("word " * 40, None)],
)
def test_hard_rules(one, value, want):
    assert one(value, quality.hard_rule) == want


def test_score(one):
    assert one("word " * 300, quality.score) == pytest.approx(30 + 2 + 30)
    assert one("the is a " * 50, quality.rejection) == "low_score_17.0"
    assert one(None, quality.hard_rule) == "empty_content"


def test_python_gets_long_texts_in_small_batches(spark, tmp_path):
    from docloom.plans.query import read

    @F.pandas_udf("int")
    def rows_of_batch(s):
        return s.str.len() * 0 + len(s)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.range(3000).selectExpr("id doc_id", "'abc' text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = read(spark, str(tmp_path), "documents").coalesce(1)
    assert docs.select(rows_of_batch("text").alias("n")).agg(F.max("n")).first()[0] <= 512

"""Markdown, chunks, tables and portal pages on small fixtures."""

import heapq
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import quality
from docloom.operators import chunking, markdown, portal, stage_log
from docloom.sources import best_first, files, sinks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def fixed(spark, text, *steps):
    table = markdown.line_table(docs(spark, text))
    for step in steps:
        table = step(table)
    return markdown.join_lines(table).first().text


def test_letterhead_and_main_content(spark):
    text = "## TRƯỜNG ĐẠI HỌC X\nSố: 12\n# QUYẾT ĐỊNH về\n\n body \nTrang 3\nBài viết liên quan\nmore"
    df = docs(spark, text, "plain\ntext", "Số: 1\nnothing")
    bare = [r.t for r in df.orderBy("doc_id").select(markdown.remove_letterhead(F.col("text")).alias("t")).collect()]
    assert bare == ["# QUYẾT ĐỊNH về\n\n body \nTrang 3\nBài viết liên quan\nmore", "plain\ntext", ""]
    assert df.select(markdown.clean(F.col("text"), F.lit("regulation")).alias("t")).first().t == "# QUYẾT ĐỊNH về\nbody\nTrang 3"
    assert df.select(markdown.clean(F.col("text"), F.lit("other")).alias("t")).first().t == text


def test_levels_follow_the_longest_clause(spark):
    text = "CHƯƠNG I\n**Điều 1.** Phạm vi\n1. ngắn\n2. " + "từ " * 12 + "\na. x\nĐiều 2. Y\n1. ngắn"
    assert fixed(spark, text, markdown.heading_levels).split("\n") == ["# CHƯƠNG I", "## Điều 1. Phạm vi", "### 1. ngắn", "### 2. " + ("từ " * 12).strip(), "a. x", "## Điều 2. Y", "1. ngắn"]


def test_chapter_titles_and_tidying(spark):
    assert fixed(spark, "# CHƯƠNG I\n\n## Quy định chung\nx\n#\n---\n---\ny", markdown.chapter_titles, markdown.tidy) == "# CHƯƠNG I - QUY ĐỊNH CHUNG\nx\n---\ny"


def test_title_block(spark):
    assert fixed(spark, "# Quy chế\n\n# đào tạo\n*note*\n# Later", markdown.title_block) == "# QUY CHẾ ĐÀO TẠO\n*note*\n# Later"
    assert fixed(spark, "x\n# One", markdown.title_block) == "x\n# One"


def test_index_pages(spark):
    got = docs(spark, "- [a](b)\n[c](d)\ntext", "text\n\nmore [x](y)", "").orderBy("doc_id").select(quality.is_index_page(F.col("text")).alias("i"))
    assert [r.i for r in got.collect()] == [True, False, False]


def test_curriculum_lines(spark):
    lines = ["[1.2. Mục](http://x)", "**Về kiến thức:**", "‒ item", "plain"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(markdown.curriculum_lines(F.col("x")).alias("y"))
    assert [r.y for r in got.collect()] == ["## 1.2. Mục", "### Về kiến thức", "- item", "plain"]


def test_rows_are_completed(spark):
    text = "| a | b | c |\n|---|---|---|\n| 1 | 2 |\n|  | 5 | 6 |\n## Nhóm\nafter"
    assert fixed(spark, text, markdown.complete_rows).split("\n") == ["| a | b | c |", "|---|---|---|", "| 1 | 2 |  |", "| 1 | 5 | 6 |", "| **Nhóm** |  |  |", "after"]


def test_blank_line_before_tables(spark):
    assert fixed(spark, "x\n|a|b|\n|---|---|\n|1|2|", markdown.blank_before_tables) == "x\n\n|a|b|\n|---|---|\n|1|2|"


def test_header_stack(spark):
    text = "pre\n# A\n## Điều 1. One\n### 1. Clause text\nbody\n#### deep\n## Điều 2. Two\n# B\n"
    rows = chunking.header_chunks(docs(spark, text)).orderBy("chunk_no").collect()
    assert [(r.header, list(r.ancestors), r.level) for r in rows] == [(None, [], 0), ("A", [], 1), ("Điều 1", ["A"], 2), ("Khoản 1", ["A", "Điều 1"], 3), ("Điều 2", ["A"], 2), ("B", [], 1)]
    assert rows[3].text == "### 1. Clause text\nbody\n#### deep"
    said = chunking.clause_context(chunking.header_chunks(docs(spark, text))).where("chunk_no = 3").first().text
    assert said.startswith("## Điều 1. One\n### 1. Clause")
    curriculum = chunking.header_chunks(docs(spark, text), max_level=6, category="curriculum")
    assert curriculum.count() == 7


def test_titles_are_merged(spark):
    text = "# ABOUT\nshort\n# MORE\n## Điều 1. X\n" + "long body text\n" * 20
    rows = chunking.merge_titles(chunking.header_chunks(docs(spark, text))).orderBy("chunk_no").collect()
    assert [(r.header, r.titles_merged) for r in rows] == [("ABOUT MORE", 2), ("Điều 1", 0)]


def test_table_groups_and_rows(spark):
    plo = "note\n| P | T |\n|---|---|\nlost | 1\n**PLO1. A** | |\n1 | 1\n**PLO2. B** | |\n2 | 1"
    rows = chunking.group_chunks(docs(spark, plo, "| a |\n|---|\n| 1 |"), ["doc_id"], "plo").orderBy("doc_id", "group_no").collect()
    assert [(r.doc_id, r.group_no, r.header) for r in rows] == [(0, 1, "**PLO1. A** | |"), (0, 2, "**PLO2. B** | |"), (1, 0, None)]
    assert rows[0].text == "| P | T |\n|---|---|\n**PLO1. A** | |\n1 | 1"
    table = "\n".join(["| h |", "|---|", *(f"| {i} |" for i in range(38))])
    parts = chunking.row_chunks(docs(spark, table), ["doc_id"]).orderBy("part").collect()
    assert [p.header for p in parts] == ["Rows 1-15", "Rows 16-30", "Rows 31-38"]
    kinds = spark.createDataFrame([("Chuẩn đầu ra",), ("Kế hoạch học tập",), ("x",), (None,)], "h string").select(chunking.table_type(F.col("h")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["plo", "study_plan", "unknown", "unknown"]


def test_html_tables_become_sentences(spark):
    text = "before <table><tr><th>Name</th><th>Mark</th></tr><tr><td>An <b>Lê</b></td><td>8</td></tr></table> after <table><tr><td>x</td></tr></table>"
    assert chunking.flatten_html_tables(docs(spark, text)).first().text == "before - Name: An Lê; Mark: 8 after <table><tr><td>x</td></tr></table>"


GRADES = """<table><tr><td>other</td></tr></table><table><tr><th>STT</th><th>Mã HP</th></tr>
<tr><td colspan=10>Học kỳ 1 - Năm học 2023-2024</td></tr><tr><td>1</td><td>IT001</td><td>Nhập môn</td><td>4</td><td>8</td><td>7</td><td>-</td><td>9</td><td>8.5</td><td></td></tr>
<tr><td>2</td><td>IT002</td><td>OOP</td><td>3</td><td></td><td></td><td></td><td></td><td>Miễn</td><td></td></tr><tr><td>Trung bình học kỳ</td><td>8</td></tr>
<tr><td>Học kỳ hè</td></tr><tr><td>3</td><td>X</td><td>Y</td><td>2</td><td>0</td><td>0</td><td>0</td><td>0</td><td>0.0</td></tr></table>"""


def test_grades(spark):
    pages = spark.createDataFrame([(1, GRADES), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    courses = portal.grade_courses(portal.html_table_rows(pages, ["mã hp", "stt"]))
    rows = courses.orderBy("stt").collect()
    assert [(r.stt, r.semester, r.credits, r.average_score, r.is_exempt) for r in rows] == [(1, "HK1 năm học 2023-2024", 4, 8.5, False), (2, "HK1 năm học 2023-2024", 3, None, True), (3, None, 2, 0.0, False)]
    assert rows[0].practice_score is None and rows[0].final_score == 9.0
    by = {r.semester: r for r in portal.averages(courses, ["semester"]).collect()}
    assert (by["HK1 năm học 2023-2024"].total_registered_credits, by["HK1 năm học 2023-2024"].gpa_10, by["HK1 năm học 2023-2024"].gpa_4) == (7, 8.5, 3.4)
    assert (by[None].gpa_10, by[None].gpa_4) == (0.0, None)


def test_averages(spark):
    rows = spark.createDataFrame([(8.0, 3), (6.0, 1), (None, 2)], "average_score double, credits int").withColumn("s", F.lit(1))
    r = portal.averages(rows, ["s"]).first()
    assert (r.total_registered_credits, r.gpa_credits, r.gpa_10, r.gpa_4) == (6, 4, 7.5, 3.0)


def test_exams_and_schedule(spark):
    html = "<table><tr><th>STT</th><th>Mã MH</th><th>Mã lớp</th></tr><tr><td>1</td><td>IT1</td><td>IT1.A</td><td>2</td><td>3</td><td>1/1/2025</td><td>B1</td><td>-</td></tr><tr><td>x</td><td>a</td><td>b</td></tr></table>"
    rows = portal.exam_rows(portal.html_table_rows(spark.createDataFrame([(1, html)], "page_id long, html string"), ["mã mh"])).collect()
    assert [(r.stt, r.course_name, r.exam_date, r.exam_form) for r in rows] == [(1, "IT1", "1/1/2025", None)]
    card = '<div class="tkb-card lt"><b class="tkb-title">IT1.A</b><b class="tkb-title">Nhập môn</b><i class="tkb-sub">1/1 - 2/2</i><i class="tkb-sub">B1</i></div>'
    html = f"<table><tr><th>Tiết</th><th>Thứ 2</th></tr><tr><td>Tiết 1</td><td rowspan=3>{card}</td></tr><tr><td>Tiết 2</td></tr><tr><td>Tiết 5</td><td>{card}</td></tr></table>"
    rows = portal.schedule_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.subject_code, r.type, r.day_of_week, r.period, r.date_range, r.room) for r in rows] == [("IT1.A", "lt", "Thứ 2", "1-3", "1/1 - 2/2", "B1")]


def test_spans(spark):
    table = portal.find_table("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>", ["a"])
    assert portal.expanded_rows(table) == [["a", "b", "b"], ["a", "c", "d"]]


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    folder = tmp_path / "raw" / "regulation"
    folder.mkdir(parents=True)
    (folder / "a1.docx").write_bytes(docx("one", "two"))
    (folder / "a1.txt").write_text("text")
    (folder / "b2-long.txt").write_text("other")
    (folder / "c.docx").write_bytes(b"broken")
    (folder / "empty.txt").write_text("")
    raw = files.raw_files(spark, str(tmp_path / "raw"))
    wanted = spark.createDataFrame([("regulation", "a1"), ("regulation", "b2"), ("regulation", "zz")], "category string, document_id string")
    found = files.find_raw(raw, wanted)
    assert {(r.document_id, r.ext) for r in found.collect()} == {("a1", ".docx"), ("b2", ".txt")}
    parsed = {r.path.rsplit("/", 1)[1]: r for r in files.parse_files(files.valid_files(raw)).collect()}
    assert parsed["a1.docx"].text == "one\ntwo" and parsed["c.docx"].error and len(parsed) == 4
    (folder / "d.md").write_text("# Tiêu")
    (folder / "d.json").write_text('{"title": "T"}')
    got = files.markdown_documents(spark, str(folder), "title string").collect()
    assert [(r.document_id, r.category, r.title, r.text) for r in got] == [("d", "regulation", "T", "# Tiêu")]
    (folder / "chunks.json").write_text('[{"chunk_id": "k", "text": "t", "metadata": {"document_id": "m"}}, {"id": "i", "doc_id": "x", "text": "u"}]')
    assert sorted((r.chunk_id, r.document_id) for r in files.chunk_files(spark, str(folder / "chunks.json")).collect()) == [("i", "x"), ("k", "m")]
    (tmp_path / "a.yaml").write_text('# note\nUIT: "Trường"\nHK: \'Học kỳ\'\nXX: ""\n')
    assert files.acronyms(str(tmp_path / "a.yaml")) == {"UIT": "Trường", "HK": "Học kỳ", "XX": ""}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "document_id string, v int")
    sinks.upsert_index(rows, path)
    sinks.upsert_index(spark.createDataFrame([("a", 9)], "document_id string, v int"), path)
    assert sorted((r.document_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
    good, bad = sinks.split_rejected(docs(spark, "word " * 300, "short"))
    assert good.count() == 1 and bad.first().rejection_reason == "too_short" and bad.first().length == 5
    pages = spark.createDataFrame([("https://x/a/b", "t", "T")], "url string, text string, title string")
    assert sinks.crawled_pages(pages, F.lit("2024-01-01")).first().folder == "a-b"


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "url string, href string")
    got = files.crawl(spark.createDataFrame([("a",)], "url string"), links, lambda u: F.length(u), depth=3)
    assert {(r.url, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_portal_session(spark):
    pages = spark.createDataFrame([("<a>Đăng xuất</a>", "x"), ("<input id='edit-name'>", "user/login")], "html string, url string")
    assert [(r.logged_in, r.expired) for r in files.fetched(pages).collect()] == [(True, False), (False, True)]


def test_flat_metadata_by_kind_of_column(spark):
    df = spark.sql("select 'a' s, 2 n, array('x', 'y') l, named_struct('k', 1) d, date'2024-01-31' day, true b")
    assert sinks.flat_metadata(df).first().asDict() == {"s": "a", "n": 2, "l": "x, y", "d": '{"k":1}', "day": "2024-01-31", "b": True}
    assert "d" not in sinks.flat_metadata(df, nested="drop").columns


def test_broken_files_of_chunks_and_items_give_no_rows(spark):
    rows = spark.createDataFrame([("/a/x.json", "[{"), ("/a/y.json", ""), ("/a/z.json", None), ("/a/q.json", '[{"id": "1", "question": "w"}]')], "path string, value string")
    assert [(r.file, r.id) for r in files.item_rows(rows).collect()] == [("q.json", "1")]
    assert [r.chunk_id for r in files.chunk_rows(rows).collect()] == ["1"]


def test_sub_chunks_by_tokens_of_the_caller(spark):
    parts = chunking.sub_chunks(docs(spark, "abcdefg"), ["doc_id"], limit=3, size=4, overlap=1, split=lambda c: F.split(c, "")).orderBy("sub_no").collect()
    assert [r.text for r in parts] == ["a b c d", "d e f g"]


def heap_crawl(seeds, links, score, depth, most, batch, pages=None):
    """The plain way: a heap, from which batches are taken."""
    heap = [(-score(u), 0, u) for u in set(seeds)]
    heapq.heapify(heap)
    seen, out, fetched = set(), [], 0
    while heap and fetched < most:
        taken = []
        while heap and len(taken) < min(batch, most - fetched):
            p, d, u = heapq.heappop(heap)
            if u not in seen:
                seen.add(u)
                taken.append((u, d))
        for u, d in taken:
            ok = pages is None or u in pages
            fetched += ok
            out.append((u, d, ok))
            if ok and d < depth:
                for v in links.get(u, ()):
                    if v not in seen:
                        heapq.heappush(heap, (-score(v), d + 1, v))
    return out


@pytest.mark.parametrize("batch, most, some", [(1, 12, False), (4, 15, True), (50, 1000, False)])
def test_best_first_crawl_takes_what_a_heap_takes(spark, batch, most, some):
    rng = random.Random(batch)
    names = [f"https://{'a.' if k % 5 else ''}{'x.org' if k % 7 else 'y.net'}/p{k}" for k in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(200)] + [(names[1], None), (None, names[2]), (names[1], names[1])]
    inside = lambda u: "x.org" in u
    graph = {}
    for a, b in edges:
        if a and b and inside(b):
            graph.setdefault(a, []).append(b)
    score = lambda u: len(u) % 3
    pages = set(names[::2]) | set(names[:6]) if some else None
    expected = heap_crawl(names[1:4], graph, score, 3, most, batch, pages)
    got = best_first.crawl_best_first(
        spark.createDataFrame([(u,) for u in [*names[1:4], names[1], None]], "url string"), spark.createDataFrame(edges, "url string, href string"), lambda u: F.length(u) % 3, 3, most, batch,
        best_first.in_domains("x.org"), lambda u: F.endswith(u, F.lit("1")), pages and spark.createDataFrame([(u,) for u in pages], "url string"),
    ).orderBy("seq").collect()
    assert [(r.url, r.depth, r.fetched) for r in got] == expected
    assert all(r.kept == (r.fetched and r.url.endswith("1")) for r in got)
    assert best_first.crawl_best_first(spark.createDataFrame([], "url string"), spark.createDataFrame(edges, "url string, href string"), lambda u: F.length(u)).count() == 0


def greedy_sentences(pieces, size, overlap):
    """Chunks of (text, tokens) pieces by plain loops."""
    out, start = [], 0
    while start < len(pieces):
        stop, used = start, 0
        while stop < len(pieces) and (stop == start or used + pieces[stop][1] <= size):
            used += pieces[stop][1]
            stop += 1
        out.append(("".join(p for p, _ in pieces[start:stop]).strip(), used))
        if stop == len(pieces):
            break
        room, back, kept = min(overlap, size - pieces[stop][1]), stop, 0
        while back - 1 > start and kept + pieces[back - 1][1] <= room:
            back -= 1
            kept += pieces[back][1]
        start = back
    return out


def test_sentence_chunks_are_whole_sentences(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("w" * rng.randint(1, 6) for _ in range(n))
    ends = [". ", "!\n", "? ", '." ', "\n\n", "...  "]
    texts = []
    for _ in range(12):
        parts = [(say(rng.randint(1, 12)) + rng.choice(ends)) for _ in range(rng.randint(3, 40))]
        texts.append(parts)
    df = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(texts)], "doc_id int, text string")
    got = chunking.sentence_chunks(df, ["doc_id"], limit=5, size=20, overlap=7).orderBy("doc_id", "sub_no").collect()
    for i, parts in enumerate(texts):
        whole = "".join(parts)
        expected = greedy_sentences([(p, len(p.split())) for p in parts], 20, 7) if len(whole.split()) > 5 else [(whole, len(whole.split()))]
        assert [(r.text, r.tokens) for r in got if r.doc_id == i] == expected


def test_sentence_chunks_of_odd_texts(spark):
    rows = [(1, ""), (2, None), (3, "one two three four five six seven eight nine ten"), (4, "head\n---\n" + "a b. " * 4), (5, "a b c d e f\n---\n  ")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in chunking.sentence_chunks(df, ["doc_id"], limit=4, size=4, overlap=2).orderBy("doc_id", "sub_no").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.tokens, r.sub_total))
    assert got == {1: [("", 0, 1)], 3: [("one two three four", 4, 3), ("five six seven eight", 4, 3), ("nine ten", 2, 3)], 4: [("head\na b. a b.", 4, 3)] * 3, 5: [("a b c d e f\n", 0, 1)]}


def test_student_table_by_attributes_and_places(spark):
    table = '<TABLE bordercolor="FFFFFF" border="0" cellpadding="0" cellspacing="0" width="100%" id="x">{}</TABLE>'
    rows = [
        "<tr><td>Họ và tên</td><td> Lê&nbsp;Văn\n A </td><td>Ngày sinh</td><td>01/02/2003</td><td>Giới tính</td><td><b>Nam</b></td></tr>",
        "<tr><td>Mã SV</td><td>23520819</td><td>Lớp</td><td></td><td>Khoa</td><td>KHMT</td></tr>",
        "<tr><td>Bậc</td><td>ĐH</td><td>Hệ</td><td>CQ</td></tr>",
    ]
    other = '<table width="100%" border="0"><tr><td>sinh viên</td></tr></table>'
    pages = [
        (1, other + table.format("".join(rows))), (2, table.format(rows[0])), (3, table.format("".join([rows[0].replace("<td>", "<th>").replace("</td>", "</th>"), rows[1].replace("<td>Khoa</td>", "")]))), (4, other), (5, None), (6, ""),
    ]
    got = {r.page_id: r for r in portal.student_info(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert tuple(got[1])[1:] == ("Lê Văn A", "01/02/2003", "Nam", "23520819", None, "KHMT", "ĐH", "CQ")
    assert got[2].name == "Lê Văn A" and got[2].student_id is None and got[2].degree is None
    assert all(v is None for v in tuple(got[3])[1:]) and all(all(v is None for v in tuple(got[k])[1:]) for k in (4, 5, 6))


def test_levels_of_tables_and_preambles(spark):
    text = "Căn cứ a\nCăn cứ b\nBảng 1\n| a |\nĐiều 1. x\nBảng 2: y\n\n| a |\n1. " + "từ " * 12 + "\n**Bảng 3**\n<table></table>\nBảng không có gì\n# Phụ lục\n### Bảng 4\n| a |\nCăn cứ sau"
    lines = fixed(spark, text, markdown.heading_levels, markdown.table_levels).split("\n")
    assert [x for x in lines if "Bảng" in x or "Căn" in x] == ["## Căn cứ a", "Căn cứ b", "## Bảng 1", "### Bảng 2: y", "#### Bảng 3", "Bảng không có gì", "## Bảng 4", "Căn cứ sau"]


def test_workbooks_and_test_sets(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [("id", "question"), ("1", "what"), ("2", "why")]
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="S" sheetId="1"/></sheets></workbook>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/worksheets/sheet1.xml", sheet.format("".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)))
    got = files.excel_rows(spark, f"file://{tmp_path}/b.xlsx", ["id", "question"]).orderBy("rn").collect()
    assert [(r.id, r.question) for r in got] == rows[1:]
    folder = tmp_path / "sets"
    folder.mkdir()
    (folder / "one.json").write_text('[{"id": "a", "question": "q", "ground_truth": "t", "metadata": {"k": "v"}}]')
    (folder / "bad.json").write_text("[{")
    items = files.test_sets(spark, f"file://{folder}").collect()
    assert [(r.file, r.id, r.ground_truth, r.metadata) for r in items] == [("one.json", "a", "t", {"k": "v"})]


def test_merged_maps_keep_the_last_value_of_each_name(spark):
    rows = [(1, "p", 1, 1, {"a": "1", "b": "1"}), (1, "p", 2, 1, {"b": "2"}), (1, "p", 2, 2, None), (1, "p", 1, 2, {"c": None, "a": "3"}), (2, "p", 1, 1, {}), (None, "p", 1, 1, {"z": "9"})]
    df = spark.createDataFrame(rows, "document_id int, stage string, ts int, seq int, metadata map<string,string>")
    got = {r.document_id: r.metadata for r in stage_log.merged_maps(df, ["document_id", "stage"], "metadata", ["ts", "seq"]).collect()}
    assert got == {1: {"a": "3", "b": "2", "c": None}, None: {"z": "9"}}

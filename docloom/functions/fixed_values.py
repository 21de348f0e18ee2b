"""Word lists, patterns and lookup tables that results depend on."""

from __future__ import annotations

# Spelling pairs, replaced in this order.
SPELLING = [
    ("khoá", "khóa"), ("Khoá", "Khóa"), ("KHOÁ", "KHÓA"), ("toá", "tóa"), ("Toá", "Tóa"), ("TOÁ", "TÓA"), ("khoăn", "khoản"), ("Khoăn", "Khoản"), ("KHOĂN", "KHOẢN"),
    ("ngòai", "ngoài"), ("Ngòai", "Ngoài"), ("NGÒAI", "NGOÀI"), ("giùm", "giúm"), ("Giùm", "Giúm"), ("GIÙM", "GIÚM"),
]

# Lines of a letterhead, the lines at which content starts, and texts at which it ends.
LETTERHEAD = [
    r"^#\s*ĐẠI HỌC QUỐC GIA", r"^##\s*TRƯỜNG ĐẠI HỌC", r"^#\s*CỘNG HÒA XÃ HỘI CHỦ NGHĨA", r"^##\s*Độc lập\s*-\s*Tự do\s*-\s*Hạnh phúc", r"^Số:\s*\d+", r"^Tp\.\s*Hồ Chí Minh,\s*ngày",
    r"^----+\s*$",
]
CONTENT_START = r"^#\s*(QUYẾT ĐỊNH|THÔNG BÁO|CÔNG VĂN|THÔNG TIN|QUY ĐỊNH|QUY CHẾ)"
CONTENT_END = ["Bài viết liên quan", r"Trang \d", "PHÒNG ĐÀO TẠO ĐẠI HỌC", "Back to top"]

# Content quality.
MIN_LENGTH, MAX_LINK_SHARE, MAX_HEADER_SHARE, MIN_SCORE = 100, 0.7, 0.8, 40.0
ERROR_KEYWORDS = ["page not found", "trang không tồn tại", "không có kết quả"]
NAVIGATION_KEYWORDS = ["đăng nhập", "login", "sitemap", "bản đồ trang"]
USEFUL_KEYWORDS = ["quy định", "quyết định", "học phần", "chương trình", "sinh viên", "đào tạo", "môn học", "khóa luận", "thực tập", "tốt nghiệp", "điểm", "học kỳ"]
STOP_WORDS = [
    "và", "của", "có", "cho", "từ", "được", "này", "đó", "các", "những", "với", "theo", "để", "trong", "nếu", "the", "a", "an", "is", "are", "was", "were", "be",
]
LETTERS = "a-zA-Zàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"

# Categories of folder names, the first that fits.
CATEGORY_PATTERNS = [
    ("regulation", [r"^\d+-", "quyet-dinh", "quy-dinh", "quy-che", "quy-trinh", "huong-dan"]),
    ("curriculum", ["content-cu-nhan", "content-ky-su", "chuong-trinh-dao-tao", "danh-muc-mon-hoc", "content-chuong-trinh", "chuong-trinh-tien-tien", "de-an-song-nganh", "content-cac-nganh"]),
    ("announcement", ["thong-bao", "cap-nhat-ket-qua", "lich-thi", "lich-hoc"]),
]
CATEGORIES = ["regulation", "curriculum", "announcement", "other"]

# URLs of a portal.
URL_IMPORTANT = ["/thong-bao/", "/quy-dinh/", "/lich-thi/", "/tot-nghiep/", "/hoc-tap/", "/ke-hoach/", "/ban-hanh/", "/huong-dan/", "/bieu-mau/", "/mau-bieu/"]
URL_EXCLUDED = [r"/node/\d+", "/user/", "/admin/", "/search/", "/comment/", r"\?page=\d+", "/printpdf/", "/print/", "/share/", "/taxonomy/"]
URL_YEARS = ["2022", "2023", "2024", "2025"]
URL_WEIGHTS = [("/thong-bao/", 50), ("/quy-dinh/", 45), ("/lich-thi/", 40), ("/tot-nghiep/", 40), ("/hoc-tap/", 35), ("/ke-hoach/", 30), ("/huong-dan/", 30)]
URL_YEAR_BONUS = [("2025", 30), ("2024", 20), ("2023", 10)]
DOWNLOADS = r"(?i)\.(pdf|docx?|xlsx?)$"

# Regulation and curriculum structure.
SECTION_MARKERS = [r"^CHƯƠNG\s+[IVXLCDM0-9]+", r"^##?\s*Chương\s+\d+", r"^\*?\*?Điều\s+\d+\."]
SPECIAL_SECTIONS = ["MỤC LỤC", "DANH MỤC TỪ VIẾT TẮT", "QUYẾT ĐỊNH"]
PREAMBLE, TABLE_CAPTION = ["Căn cứ", "Xét đề nghị", "QUYẾT ĐỊNH"], "Bảng"
GROUP_ROWS = {"plo": r"(?i)^\*\*(?:PLO|LO|CĐR)\s*\d+", "study_plan": r"(?i)^\*\*Học kỳ\s+\d+\*\*"}
TABLE_TYPES = [("CHUẨN ĐẦU RA", "plo"), ("KẾ HOẠCH GIẢNG DẠY", "study_plan"), ("KẾ HOẠCH HỌC TẬP", "study_plan")]
DOCUMENT_TYPES = {"original": "Văn bản gốc", "update": "Văn bản sửa đổi", "supplement": "Văn bản bổ sung"}
MAJOR_CODES = {
    "Công nghệ Thông tin": "CNTT", "Hệ thống Thông tin": "HTTT", "Khoa học Máy tính": "KHMT", "Kỹ thuật Phần mềm": "KTPM", "Kỹ thuật Máy tính": "KTMT",
    "Mạng máy tính và Truyền thông dữ liệu": "MMT", "An toàn Thông tin": "ATTT", "Thương mại điện tử": "TMĐT", "Khoa học Dữ liệu": "KHDL", "Trí tuệ Nhân tạo": "TTNT", "Thiết kế Vi mạch": "TKVMC",
    "Truyền thông đa phương tiện": "TTĐPT",
}

# Programs by the words that name them, and names of the university that are not programs.
UNIVERSITY_NAMES = ["trường đại học công nghệ thông tin", "đại học công nghệ thông tin", "đhcntt", "uit", "trường"]
PROGRAM_KEYWORDS = {
    "khoa-hoc-may-tinh": ["khoa học máy tính", "khmt", "computer science", "khoa hoc may tinh"],
    "ky-thuat-may-tinh": ["kỹ thuật máy tính", "ktmt", "computer engineering", "ky thuat may tinh"],
    "cong-nghe-thong-tin": ["công nghệ thông tin", "cntt", "information technology", "cong nghe thong tin"],
    "he-thong-thong-tin": ["hệ thống thông tin", "httt", "information systems", "he thong thong tin"],
    "ky-thuat-phan-mem": ["kỹ thuật phần mềm", "ktpm", "software engineering", "ky thuat phan mem"],
    "khoa-hoc-du-lieu": ["khoa học dữ liệu", "khđl", "data science", "khoa hoc du lieu"],
    "tri-tue-nhan-tao": ["trí tuệ nhân tạo", "ttnt", "artificial intelligence", "ai", "tri tue nhan tao"],
    "mang-may-tinh-va-truyen-thong-du-lieu": ["mạng máy tính và truyền thông dữ liệu", "mmtttdl", "mạng máy tính", "truyền thông dữ liệu", "networking", "mang may tinh"],
    "an-toan-thong-tin": ["an toàn thông tin", "attt", "information security", "cybersecurity", "an toan thong tin"],
    "thuong-mai-dien-tu": ["thương mại điện tử", "tmđt", "e-commerce", "thuong mai dien tu"],
    "thiet-ke-vi-mach": ["thiết kế vi mạch", "tkvm", "vlsi design", "thiet ke vi mach"],
    "truyen-thong-da-phuong-tien": ["truyền thông đa phương tiện", "ttđpt", "multimedia", "truyen thong da phuong tien"],
}

# Files of a document by preference.
RAW_EXTENSIONS = [".pdf", ".docx", ".doc", ".html", ".txt"]
STAGES = ["parse", "clean", "normalize", "filter", "fix-markdown", "flatten-table", "metadata", "chunk", "embed-index"]

# Codes, dates, years, semesters and student ids in names and texts.
NAME_CODE = r"(\d+)[-_]([a-z]+)-([a-zÀ-ỹ]+(?:-[a-zÀ-ỹ]+)?)"
TEXT_CODE = r"(?iu)(\d+/Q[ĐD]-[A-ZÀ-ỹ]+(?:-[A-ZÀ-ỹ]+)?)"
NAME_DATE = r"[-_]?(\d{1,2})-(\d{1,2})-(\d{2,4})(?:_|$)"
INTAKE_YEAR, ANY_YEAR = r"khoa-(?:\d{2}-)?(\d{4})", r"\b(20\d{2})\b"
SEMESTER = r"(?iuU)(?:HK|Học\s*kỳ)\s*(\d+)\s*-\s*(?:Năm\s*học\s*|Năm\s*)?(\d{4})\s*-\s*(\d{4})"
NAMED_STUDENT, BARE_STUDENT = r"(?iuU)(?:MSSV|Mã\s+SV)[:\s]*(\d{8})\b", r"\b([12]\d{7})\b"

# The student table of a portal's grade page: its attributes, and for each field the row, the cell, and the cells that the row has at least.
STUDENT_TABLE = {"cellpadding": "0", "cellspacing": "0", "border": "0", "bordercolor": "FFFFFF", "width": "100%"}
STUDENT_FIELDS = {
    "name": (0, 1, 6), "dob": (0, 3, 6), "gender": (0, 5, 6), "student_id": (1, 1, 6), "class_name": (1, 3, 6), "faculty": (1, 5, 6),
    "degree": (2, 1, 4), "training_system": (2, 3, 4),
}

# Suffix rules of the Porter2 stemmer of English, and the stop words that go with it in lexical search.
STEM_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STEM_INVARIANT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
STEM_KEPT_ING = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEM_PREFIXES, STEM_ENDINGS = ["gener", "commun", "arsen"], "cdeghkmnrt"
STEM_R1 = [
    {
        "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
        "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
    },
    {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""},
]
STEM_R2 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
ENGLISH_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]

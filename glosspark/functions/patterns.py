"""Patterns and word lists.

Fixed values: results depend on each of them, so they are stated in full. Java syntax;
``\\w`` of a Unicode engine is written ``[\\pL\\pN_]``.
"""

WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
WORD = r"[\pL\pN_]"
LETTER_LATIN = r"[A-Za-zÀ-ỹ]"
VIETNAMESE = "[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"

# Leaders: runs that stand for a blank to fill in. Their least lengths differ by document kind.
LEADER_PDF = r"\.{3,}|_{3,}|-{5,}|…{2,}"
LEADER_DOCX = r"\.{3,}|_{3,}|-{3,}|…+|\t+"
LEADER_IMAGE = r"\.{5,}|_{4,}|-{4,}"
FORM_SPLIT = LEADER_PDF + r"|\s*:\s*"
FILLER_CHARS = r"[\._\-=:;\s]+"

LIST_LAYOUT = r"^\s*([•‣◦⁃∙▪▫●○■□★☆·]|\-\s|\*\s|\d{1,3}[.)]\s|[a-zA-Z][.)]\s|[ivxIVX]{1,4}[.)]\s)"
LIST_PREFIX_PDF = r"^(\s*(?:[•‣◦⁃∙●○■□·]|\-\s|\*\s|\d{1,3}[.)]\s|[a-zA-Z][.)]\s|[ivxIVX]{1,4}[.)]\s))"
LIST_PREFIX_TEXT = r"^(\s*(?:[-+*•◦▪▫○●■□☐☑✓✔◆◇]|\d+[.)]|[A-Za-z][.)]|[ivxIVX]{1,4}[.)])\s*)"
LONE_BULLET = r"^\s*[o•‣◦⁃∙●○■□·]\s*$"
MERGE_LIST_START = r"^\s*(?:[•‣◦⁃∙●○■□·+\-\*]|\d{1,3}[.)]\s|[a-zA-Z][.)]\s|[ivxIVX]{1,4}[.)]\s)"
PAGE_NUMBER = r"(?i)^\s*(\d{1,4})\s*$|^\s*[-–—]\s*\d{1,4}\s*[-–—]\s*$|^\s*trang\s+\d{1,4}\s*$|^\s*page\s+\d{1,4}\s*$"
FORM_FIELD = (
    r"(Họ\s*(và|&)?\s*tên|Ngày\s*sinh|Địa\s*chỉ|Số\s*(điện\s*thoại|CMND|CCCD)"
    r"|Giới\s*tính|Email|Mã\s*số|MSSV|MSV|\bLớp\b|Khóa\s*học|Chức\s*(vụ|danh)|Đơn\s*vị|Phòng|Ngày\s*tháng"
    r"|Số\s*hiệu|Ký\s*tên|Nơi\s*cấp|Quốc\s*tịch|Dân\s*tộc|Tôn\s*giáo|Sinh\s*viên"
    r"|Name|Date\s*of\s*birth|Address|Phone|ID\s*(No|Number)|Student\s*(ID|No\.?)?|Class)"
)

# Tokens that are never translated.
FUNC_CALL_TOKEN = r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*\([^()\n]*\)\s*[;.,:]?\s*$"
CODE_IDENT_TOKEN = r"^\s*(?:[A-Za-z_]*_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9_]*|[A-Z][a-z0-9]+[A-Z]{2,}[A-Za-z0-9_]*)\s*$"
SHORT_ABBREVIATION = r"^\s*[A-Z]{2,5}\.?\s*$"
NUMBER_HEADING = r"^\s*(?:No\.?|NO\.?|Stt\.?|STT\.?)\s*$"
SQL_TYPE = (
    r"(?i)^\s*(?:N?VARCHAR|CHAR|TEXT|INT|INTEGER|BIGINT|SMALLINT|TINYINT|DATE|DATETIME|TIMESTAMP|BOOLEAN|BOOL|FLOAT|DOUBLE|DECIMAL)"
    r"\s*(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?\s*$"
)
DB_CONSTRAINT = r"(?i)^\s*(?:PRIMARY\s*KEY|FOREIGN\s*KEY|NOT\s*NULL|NULL|UNIQUE|PK|FK)\s*$"
BULLET_PREFIX = r"^\s*[+\-•\x{F02B}\x{F0B7}o]\s*"
PASCAL_IDENT = r"^(?:[A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]*)*|[a-z]+[A-Z][a-zA-Z0-9]*|[A-Za-z]+_[A-Za-z0-9_]+)$"
NONTRANSLATABLE = ("pk", "fk", "id", "mssv", "msv", "stt", "null", "n/a", "na", "sql", "api", "url", "uuid", "dob", "no", "no.")
CODE_CALL = r"(?:[a-z]+[A-Z]\w*|[A-Z][a-z]+(?:[A-Z]\w*)+|[A-Za-z]+_\w+)\s*\("
TYPED_IDENT = (
    r"(?i)(?:[a-z]+[A-Z]\w*|[A-Z][a-z]+(?:[A-Z]\w*)+|[A-Za-z]+_\w+)\s*\(\s*"
    r"(?:PK|FK|string|int|float|boolean|date|datetime|nvarchar|varchar|char|text|integer|bigint|smallint)\b"
)
CLASS_LISTING = r"(?m)^\s*[+\-•\x{F02B}\x{F0B7}o]\s*(?:[A-Z][a-z]+(?:[A-Z][a-zA-Z]*)*|[a-z]+[A-Z][a-zA-Z]*)\s*:"
MULTI_CAP_IDENT = r"(?<![a-zA-Z\x{C0}-\x{1EF9}])(?:[A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]*)+|[a-z]+[A-Z][a-zA-Z0-9]*)(?![a-zA-Z\x{C0}-\x{1EF9}])"

# Canonical text of short table cells, by lower-cased text with single blanks.
CONSTRAINT_TEXT = {
    "pk": "PK", "fk": "FK", "primary key": "Primary Key", "primarykey": "Primary Key", "foreign key": "Foreign Key", "foreignkey": "Foreign Key",
    "unique": "Unique", "null": "NULL", "tên trường": "Field name", "tên trƣờng": "Field name", "tenruong": "Field name",
    "kiểu dữ liệu": "Data type", "kiểu dữliệu": "Data type", "kiểu dl": "Data type", "ràng buộc": "Constraint",
}
GLOSSARY = {
    "userid": "Mã người dùng", "user id": "Mã người dùng", "username": "Tên đăng nhập", "password": "Mật khẩu", "role": "Vai trò",
    "primary key": "Khóa chính", "not null": "Không null", "null": "null", "unique": "Duy nhất", "constraint": "Ràng buộc",
    "data type": "Kiểu dữ liệu", "description": "Mô tả", "name": "Tên", "code": "Mã", "school": "Trường", "class": "Lớp", "email": "Email",
    "code person use": "Mã người dùng", "name post input": "Tên đăng nhập",
}
TABLE_HEADERS = {
    "user id": "User ID", "userid": "User ID", "data type": "Data Types", "data types": "Data Types", "description": "Description",
    "constraints": "Constraints", "constraint": "Constraints", "not nul": "Not null",
}
TABLE_TERMS = {"school": "Field", "mô tả": "Description", "mo ta": "Description", "ràng buộc": "Constraints", "rang buoc": "Constraints", "data types": "Data Types", "data type": "Data Types"}

# Lexical fixes, in order.
CLEANUP = (
    (r"(?i)\bNAMEBUILDING\b", "NAME BUILDING"),
    (r"(?i)\bma_khach_hang\b", "customer_id"),
    (r"(?i)\bngay_ban\b", "sale_date"),
    (r"(?i)\bNot\s+nul\b", "Not null"),
    (r"(?i)\bInfo\s+tin\s+basic\b", "Basic Information"),
    (r"(?i)\bWhere\s+the\s+topic\s+is\s+applied\b", "Application of the project"),
    (r"(?i)\bDevelopment\s+direction\s*:\s*Is\s+there\b", "Development direction: Yes"),
    (r"(?i)\bSTUDENT\s+ID\b", "Student ID"),
    (r"(?i)\bData\s+types\b", "Data Types"),
    (r"(?iu)\bKHOA\s*CÔNG\s*NGHỆ\s*THÔNG\s*TIN\b", "FACULTY OF INFORMATION TECHNOLOGY"),
    (r"(?iu)Gửi\s+lại\s+phiếu\s+đăng\s+ký\s+qua\s+Email\s*:", "Resubmit the registration form via Email:"),
)
# Passages that a last pass replaces before the fixes above.
PHRASES = (
    (r"(?i)\bKHOA\s+CONG\s+NGHE\s+THONG\s+TIN\b", "FACULTY OF INFORMATION TECHNOLOGY"),
    (r"(?i)Gui\s+lai\s+phieu\s+dang\s+ky\s+qua\s+Email\s*:", "Resubmit the registration form via Email:"),
)

# Masks, in the order that they are applied.
MASK_STEPS = (
    ("CODE", r"\b[A-Za-z_][A-Za-z0-9_]*\([^()\n]{0,80}\)|\b[A-Za-z_][A-Za-z0-9_]*\s*\(\s*\)", False),
    ("ID", r"\b(?:[A-Za-z_]*_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9_]*|[A-Z][a-z0-9]+[A-Z]{2,}[A-Za-z0-9_]*)\b", False),
    ("ID", r"\b(?:PK|FK|ID|MSSV|MSV|STT|NULL|N/A|API|SQL|URL|UUID|DOB|No\.)\b", True),
    ("ID", r"\b(?:N?VARCHAR|CHAR|TEXT|INT|INTEGER|BIGINT|SMALLINT|TINYINT|DATE|DATETIME|TIMESTAMP|BOOLEAN|BOOL|FLOAT|DOUBLE|DECIMAL)\s*(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?\b", True),
    ("SYM", r"(\.{2,}|_{2,}|-{2,}|\+{2,})", False),
    ("GLY", "([\ue000-\uf8ff□☐☑✓✔▪▫■●○◦◆◇◻◼◽◾→←↔↦➜➤➔➟➢➣]+)", False),
)
MASK_LEAK = r"(\[\[(?:CODE|ID|SYM|GLY)\d{3}\]\]|__(?:CODE|ID|SYM|GLY)\d{3}__)"

# Checks of a translation.
ECHO_MARKERS = ("you are a professional translator", "critical rules", "qa checklist", "preserve_layout", "line_by_line", "translation target", "dịch từ", "## ")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
FAIL_FAST_WORDS = r"(?i)429|too many requests|rate|insufficient|free-models|402|credit"
RETRY_WORDS = r"(?i)temporarily|timed out|timeout|connection"
PROMO_WORDS = ("sale", "discount", "offer", "book now", "vacation", "summer", "up to", "% off", "promo", "hotline", "free", "limited", "special", "deal", "subscribe")
FORM_WORDS_EN = r"(?i)\b(name|date|address|phone|email|dob|id)\b"
FORM_WORDS_VI = r"(?i)(?<![\pL\pN_])(họ tên|ngày|địa chỉ|số điện thoại|email|cmnd|cccd)(?![\pL\pN_])"

# Text fixes after optical recognition.
TONE_VOWELS = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴĐ"
ALL_VOWELS = "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY" + TONE_VOWELS
INITIALS = "ngh|nh|ng|ch|gh|gi|kh|ph|qu|th|tr|[bcdđghklmnpqrstvx]"
LETTER_EXTENDED = r"[a-zA-Z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]"
SYMBOLS = {"\uf02b": "+", "\uf0b7": "•", "\uf0a7": "§"}

"""Word lists, tables, patterns and formats that results depend on."""

from __future__ import annotations

# Month names and their numbers.
MONTH_BASE = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12}
MONTH_LONG = {"SEPT": 9, "JANUARY": 1, "FEBRUARY": 2, "MARCH": 3, "APRIL": 4, "JUNE": 6, "JULY": 7, "AUGUST": 8, "SEPTEMBER": 9, "OCTOBER": 10, "NOVEMBER": 11, "DECEMBER": 12}
# What a printed letter is misread as.
CONFUSED = {"A": "4R", "B": "8R6", "C": "G0OQ", "D": "O0P", "E": "FB8", "F": "EPT", "G": "6C0O", "I": "1LT", "J": "IL1T", "L": "I1", "M": "HNW", "N": "MHW", "O": "0QDC", "P": "RF", "R": "PBK", "S": "5", "T": "I7", "U": "VY0", "V": "UY", "Y": "V7"}
# Misreadings that are words of their own, and misreadings of two letters.
MONTH_BANNED = frozenset("WAR WAY JAM TAN MAN MAP CAR CAP BAR BAN PAN FAR FAT SET NET OUT OIL MAX".split())
MONTH_EXTRA = {"MIAY": 5, "MAV": 5, "JUI": 7, "AU6": 8, "DFC": 12, "NOU": 11, "DEG": 12, "APB": 4, "SEPI": 9, "0EC": 12}
# Characters that stand for a separator.
SEPARATORS = {",": ".", ";": ".", ":": ".", "·": ".", "•": ".", "'": ".", "`": ".", "’": ".", "*": ".", '"': ".", "_": "-", "—": "-", "–": "-", "~": "-", "\\": "/", "|": "/"}
# Noise, in order, with its label.
NOISE = [
    (r"(?<![:\d])(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?![:\d])", "시각"),
    (r"0\d{1,2}-\d{3,4}-\d{4}", "전화번호"),
    (r"(?<!\d)\d{13}(?!\d)", "바코드"),
    (r"\d{1,3}(,\d{3})+", "가격/수량"),
    (r"\b\d+\s?(KCAL|MG|ML|KG)\b", "영양성분"),
]
# Words that mark an expiry date and a manufacturing date.
EXPIRY_WORDS = ["소비기한", "유통기한", "까지", "BEST BEFORE", "BEST IF USED BY", "USE BY", "USED BY", "EXP", "BBE"]
MADE_WORDS = ["제조일자", "제조일", "생산일", "MFG", "MFD", "PACKED"]
# Shapes of misread dates and what they become, in order.
SHAPES = [
    (r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])[.](0[1-9]|[12]\d|3[01])\d?(?!\d)", "$1.$2.$3"),
    (r"(?<!\d)(0[1-9]|[12]\d|3[01])[./\-](0[1-9]|1[0-2])(20\d{2})(?!\d)", "$1/$2/$3"),
    (r"(?<!\d)(20\d{2})[.\-/](0[1-9]|1[0-2])[.\-/](0[1-9]|[12]\d|3[01])\d(?=[A-Za-z]|$|\s)", "$1.$2.$3"),
    (r"(?<!\d)(20\d{2})[.\-/](0[1-9]|1[0-2])X(0[1-9]|[12]\d|3[01])(?!\d)", "$1.$2.$3"),
    (r"(?<![\d./\-])(0[1-9]|1[0-2])[./\-](20[1-3]\d)(?![\d./\-])", "$2.$1"),
]
MONTH_YEAR = r"(?<![\d.\-/])(?<!\d )\b({0})[A-Z]*\s*[-.]?\s*(20[1-3]\d)\b(?![.\-/]?\d)"
COLON_DATE = r"(?<!\d)(\d{2,4}):(\d{1,2}):(\d{1,4})(?!\d)"
# Shapes of dates in digits.
RUN_8 = r"(?<!\d)(\d{8,9})(?!\d)"
TRIPLE = r"(?<!\d)(\d{1,5})\s*[./\-]\s*(\d{1,2})\s*[./\-]\s*(\d{1,7})(?!\d)"
YEAR_MONTH_RUN_DAY = r"(?<!\d)(\d{4})(\d{2})\s*[./\-]\s*(\d{1,2})(?!\d)"
YEAR_MONTH = r"(?<!\d)(\d{4})\s*[./\-]\s*(\d{1,2})(?!\d)"
RUN_6 = r"(?<!\d)(\d{6})(?!\d)"
MONTH_DAY = r"(?<!\d)(0[1-9]|1[0-2])\s*[./\-]\s*([0-2]\d|3[01])(?!\d)"
DATE_SHAPED = r"\d{1,4}\s*[./\-]\s*\d{1,2}\s*[./\-]\s*\d{1,4}|(?<!\d)\d{6,8}(?!\d)|(?i:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
# Names of the interpretations, by what they say.
RULES = {
    "no year": "MM.DD (연도 미검출)", "YDM": "YYYY.DD.MM (가운데 13↑ → 일)", "YMD": "YYYY.MM.DD (연도 선치 → 순서대로)", "MDY": "MM/DD/YYYY (둘째칸 13↑)", "DMY": "DD/MM/YYYY (연도 후치 → 글로벌 표준)",
    "yDM": "YY.DD.MM (가운데 13↑ → 일)", "yMD": "YY.MM.DD (앞이 연도 → 한국 관행)", "MDy": "MM.DD.YY (둘째칸 13↑)", "DMy": "DD.MM.YY (뒤가 연도)",
}
# Reasons in rule strings.
WHY = {
    "expiry": "소비기한 키워드 인접", "made": "제조일자 키워드 인접(감점)", "cut": "꼬리/머리 잡음 절단", "fallback": "구분자 없는 6자리 (예비후보)", "joined": "인접 박스 결합", "none": "날짜 후보 미검출",
    "rescued": "[특수포맷/오류구제]", "us": "[미국(MDY) 바코드/포장재 보정]", "eu": "[유럽표기(DD.MM.YY) 모호성 보정]", "exp": "[소비기한(EXP) 우선 채택]", "dot": "[도트 6->0 보정]", "w": "[W->dot 보정]", "9ep": "[9EP->SEP 보정]",
}
# Scores. Cells found; then what adds and what takes away.
CELL_SCORE = {3: 20, 2: 8, 1: 0}
MONTH_NAME, MONTH_MISREAD, MONTH_BONUS, MONTH_ALONE, NEIGHBOUR = 150, 60, 20, 5, 30
EXPIRY, MADE, CUT, FALLBACK, JOINED, JOINED_YEAR = 30, 35, 10, 25, 2, 6
# Rescue patterns, and the months they know.
RESCUE_MONTHS = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "JLL": 7, "AUG": 8, "SEP": 9, "9EP": 9, "OCT": 10, "NOV": 11, "DEC": 12}
REPEATED_YEAR = r"\b(\d{2})\1[.\-/\s](\d{1,2})[.\-/\s](\d{1,2})"
TRAILING_SERIAL = r"\b(20[1-3]\d)[.\-/\s](0[1-9]|1[0-2])[.\-/\s](\d{2})\d{1,4}\b"
JOINED_MONTH_DAY = r"\b(20[1-3]\d)[.\-/\s](0[1-9]|1[0-2])([0-2]\d|3[01])\b"
SPACED = r"\b(\d{2})\s+(0[1-9]|1[0-2])\s+([0-3]\d)(?:[A-Za-z0-9]*)?\b"
SPACED_UNLESS = r"\d{2}[.\-/]\d{2}"
ATTACHED_MONTH = r"\b(?:EXP|USEBY|BESTBY|BE)?[:\s]?({0})\s*(\d{{1,2}})\s*(\d{{2,4}})\b"
BEST_BEFORE_COLON = r"\b(BB[0D]):"
RESCUE_YEARS = (2015, 2035)
# Words of a region, and patterns of the other overrides.
EU_WORDS = r"\b(CONSUMIR|PREFERIBILMENTE|ENTRO|MOZZARELLA|LOTTO|NUTELLA|UTELLA|CONSERVARE|FONTI|CONSOMMER|AVANT|PATES|MINDESTENS|HALTBAR|PREFERENTEMENTE|SKITTLES|GULLON|DECECCO|PARMIGIANO|REGGIANO|BARILLA|PRODUCTOFITALY|PRODUCT\s+OF\s+ITALY)\b"
KR_WORDS = r"\b(HACCP|ORION|LOTTE|CROWN|HAITAI|BINGGRAE|CJ|OTTOGI|NONGSHIM)\b|\.CO\.KR|\.KR|[가-힣]"
US_WORDS = r"\b(NET\s*WT|JALAPENO)\b"
BARCODE = r"(?<!\d)(\d{12,13})(?!\d)"
US_PREFIX = 139
EU_DATE = r"(?:^|[^\d])([0-3]\d)[./\-](0[1-9]|1[0-2])[./\-](1[5-9]|2[0-9]|3[0-4])(?!\d)"
EXP_DATE = r"(?:EXP|BBE|BEST\s*BEFORE)[:\s/]*([0-3]?\d)[./\-]?(0[1-9]|1[0-2])[./\-]?(20[1-3]\d|\d{2})"
DOT_6 = r"\b(20[1-3]\d)[.]6([1-9])[.]([0-3]\d)\b"
DOT_W = r"\b(20[1-3]\d)[Ww]([1-9])[.]([0-3]\d)\b"
DOT_9EP = r"\b9EP\s+([0-3]?\d)\s+(20[1-3]\d)\b"
# Image files, and the columns of a prediction.
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
PREDICTION = ("image_id", "year", "month", "day", "final_date")
MISSING = ("", "NONE", "NAN", "NULL", "-")


def month_spellings() -> dict[str, int]:
    """Spelling to month: the long names, the short ones with every letter misread once but for the banned words, and the extra ones. What is known first stays, but for the extra ones."""
    known = dict(MONTH_LONG)
    for name, month in MONTH_BASE.items():
        for word in [name, *(name[:i] + other + name[i + 1 :] for i, c in enumerate(name) for other in CONFUSED.get(c, ""))]:
            if word not in MONTH_BANNED:
                known.setdefault(word, month)
    return known | MONTH_EXTRA

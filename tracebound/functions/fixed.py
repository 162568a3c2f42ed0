"""Results depend on these exact words, patterns and numbers.

They are data, not logic. Every one of them can be replaced through a parameter
of the function that uses it.
"""

# --- whitespace -----------------------------------------------------------
# The Unicode whitespace set used for trimming and collapsing. The body of a
# regex character class, valid in Java and in RE2.
WS = (
    r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
# The same set as characters, for btrim.
WS_CHARS = "".join(
    chr(c)
    for c in (
        0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
    )
)

# --- numeric tokens ---------------------------------------------------------
NUMERIC_PATTERNS = {
    "analysis": r"(?<![\p{L}\p{N}])[-+]?\d+(?:[.,]\d+)*(?:%|‰)?",
    "editorial": r"\d+(?:[,.]\d+)*",
    "ledger": r"(?i)[-+]?\d[\d,.]*(?:%|亿元|万元|元|万台|台|kW|MW|GW)?",
    "preflight": r"(?i)[-+]?\d[\d,.]*(?:%|亿元|万元|亿美元|万台|台|kW|MW|GW)?",
    "bare": r"[-+]?\d[\d,.]*",
}
PREFLIGHT_UNIT_SUFFIX = r"(?i)(?:亿元|万元|亿美元|万台|台|kW|MW|GW|%)$"
LEADING_NUMBER = r"[-+]?\d+(?:\.\d+)?"

# --- terms ------------------------------------------------------------------
QUALIFIERS_AUDIT = (
    "预计", "约", "至少", "至多", "可能", "大约", "不超过", "不低于", "同比", "复合增速",
)
QUALIFIERS_PREFLIGHT = (
    "预计", "约", "至少", "至多", "可能", "大约", "不超过", "不低于", "同比", "复合增长",
)
PROTECTED_TERMS = (
    "亿元", "万元", "千元", "百万元", "美元", "人民币", "元", "%", "％", "nm", "GB/s",
    "TB/s", "kW", "MW", "GW", "不受", "取决于", "依赖", "受限", "限制", "不足", "短板",
    "瓶颈", "缺口", "预计", "可能", "至少", "至多", "以上", "以下",
)
LABEL_UNITS = (
    "亿美元", "亿元", "万元", "美元", "GB/s", "Gbps", "kW", "MW", "W", "nm", "μm", "mm",
    "cm", "%", "‰",
)
CALENDAR_UNITS = ("年", "月", "日", "天")
LEXICAL_WORD = r"[a-z0-9]{3,}"
CJK_RUN = r"[\x{3400}-\x{9fff}]{2,}"
CJK_CHAR = r"[\x{3400}-\x{9fff}]"
RATIONALE_PUNCTUATION = ".,;:!?，。；：！？"
SENTENCE_ENDS = "。！？"
LEXICAL_SUPPORT_SHARE = 0.15

# --- structure --------------------------------------------------------------
HEADING_LEVEL_1 = r"^[一二三四五六七八九十百]+、\S"
HEADING_LEVEL_2 = r"^（[一二三四五六七八九十百]+）\S"
TITLE_ENDING = r"(?:报告|方案|研究|白皮书)$"
TITLE_MAX_CHARS = 80
ENTITY_PREFIX = r"^（[一二三四五六七八九十百]+）\s*"
ENTITY_MARKER = r"材料.*分析"
MIN_ENTITIES = 4
MIN_DIMENSIONS = 3
DIMENSION_DEFAULT = "材料概览"
DIMENSION_ORDER = (
    "材料概览", "全球", "国内", "深圳", "技术现状", "技术难点", "价值链分析", "行动建议", "其他",
)
OPENING_CHARS = 48
# (label, where, pattern): where is "opening" (first 48 characters) or "text".
TEXT_DIMENSION_RULES = (
    ("深圳", "opening", r"(?:深圳|深汕)"),
    ("国内", "text", r"^(?:国内|我国|中国)"),
    ("国内", "opening", r"(?:国内|国产)"),
    ("全球", "text", r"^(?:全球|海外)"),
    ("全球", "opening",
     r"(?:全球.*(?:市场|规模|份额)|市场集中|企业集中|供应商|美日.*(?:主导|垄断)"
     r"|由.*(?:美|日).*(?:主导|垄断)|G4、G5级别.*垄断|目前.*(?:美|日|韩|企业).*(?:主导|垄断))"),
    ("行动建议", "text", r"^建议"),
    ("技术现状", "text", r"^表\s*\d+.*(?:技术现状|关键核心技术)"),
)
ROW_DIMENSION_RULES = (
    ("技术现状", "text", r"技术现状|关键核心技术|技术卡点"),
    ("技术难点", "text", r"技术难点|卡脖子|原因分析"),
    ("价值链分析", "text", r"价值链"),
)
DATA_IMAGE_PATTERN = (
    r"(?i)(?:统计图|图表|表格|流程图|产业链|关系图|市场规模|市占率|国产化率|市场分布|趋势|增速"
    r"|测算|chart|table|flow|diagram)"
)

# --- media ------------------------------------------------------------------
MEDIA_TYPES = {
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pdf": "application/pdf",
}

# --- HTML -------------------------------------------------------------------
HTML_SCRIPT_STYLE = r"(?i)<(script|style)\b[^>]*>[\s\S]*?</\1>"
HTML_BLOCK = (
    r"(?i)<h[1-6]\b[\s\S]*?</h[1-6]>|<p\b[\s\S]*?</p>"
    r"|<table\b[\s\S]*?</table>|<img\b[^>]*>"
)
HTML_BREAK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|br|div|footer|h[1-6]|header|hr|li|main"
    r"|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>"
)
HTML_ROW = r"(?i)<tr\b[\s\S]*?</tr>"
HTML_CELL = r"(?i)<t[hd]\b[\s\S]*?</t[hd]>"
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
)
OPTIONAL_CLOSE_TAGS = ("p", "li", "td", "th", "tr", "dt", "dd", "option")
HIDDEN_TAG = (
    r"(?i)\shidden(?:[\s=>/]|$)|\baria-hidden\s*=\s*[\"']?true"
    r"|\bstyle\s*=\s*[\"'][^\"']*\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b"
)
# (code, pattern)
UNSAFE_CONTENT_RULES = (
    ("network-runtime", r"\b(?:fetch|XMLHttpRequest|WebSocket|EventSource)\s*\("),
    ("dynamic-code", r"\beval\s*\(|\bnew\s+Function\s*\("),
    ("remote-dynamic-import", r"(?i)\bimport\s*\(\s*[\"']https?://"),
    ("remote-css", r"(?i)(?:@import\s+|url\(\s*[\"']?)https?://"),
    ("remote-resource",
     r"(?i)<(?:script|img|source|video|audio|link)\b[^>]*\b(?:src|href|poster)\s*=\s*[\"']https?://"),
    ("literal-color", r"(?i)(?:#[0-9a-f]{3,8}\b|\brgba?\s*\(|\bhsla?\s*\()"),
)
#: Rules that only hold for one kind of file.
UNSAFE_CONTENT_KINDS = {"remote-css": "css", "remote-resource": "html", "literal-color": "css"}
EXTERNAL_ATTR = r"(?i)(?:src|href)\s*=\s*[\"'](https?://[^\"']+)"
EXTERNAL_CSS_URL = r"(?i)url\(\s*[\"']?(https?://[^)'\"\s]+)"

# --- tables and series ---------------------------------------------------------
NUMERIC_CELL = r"^([+-]?\d+(?:,\d{3})*(?:\.\d+)?)[%s]*([^\d]*)$" % WS
QUANTITATIVE_THRESHOLD = 8
TOP_ROWS = 12
PALETTE_SIZE = 8
MIN_BAR_PERCENT = 2.0
AXIS_RATIOS = (0.0, 0.25, 0.5, 0.75, 1.0)

# --- reuse --------------------------------------------------------------------
PASSAGE_MIN_CHARS = 60
FRAGMENT_MIN_CHARS = 16
EXPOSURE_ERROR_SHARE = 0.45
EXPOSURE_WARNING_SHARE = 0.30
NEAR_DUPLICATE_THRESHOLD = 0.85
REPEATED_TEXT_MIN = 3
BLOCK_MAX_CJK = 600

# --- audit --------------------------------------------------------------------
TRANSFORMATIONS = (
    "preserve", "merge", "split", "summarize", "visualize", "fold", "appendix",
)
BULK_MIN_UNITS = 10
BULK_APPENDIX_SHARE = 0.8
OVERRIDE_FIELDS = ("text", "title", "assetPath", "structure")
OVERRIDE_CELL_FIELD = r"^datasets\.\d+\.rows\.\d+\.\d+$"
METRIC_FIELDS = ("label", "value", "unit", "time", "scope", "source")
LEVELS = ("low", "medium", "high")
CONTENT_ROLES = ("evidence", "technical-explanation", "regional-case", "context", "decorative")
LOSS_SENSITIVE_ROLES = ("evidence", "technical-explanation", "regional-case")
TREATMENTS = ("use-original", "redraw", "reference-only", "omit")
ASSESSMENT_MIN_CHARS = 12
DECISION_MIN_CHARS = 8
SAFE_ID = r"(?i)^[a-z0-9._:-]+\z"
NON_VALUE_KEYS = ("order", "revision", "schemaVersion")
MAX_QUESTIONS = 3
FORBIDDEN_QUESTION = (
    r"(?iu)\b(?:layout|component|card|dashboard|interaction|map|chart|theme|colou?r|font"
    r"|visual\s+style)\b|排版|布局|组件|卡片|仪表盘|交互|地图|图表|配色|字体|视觉风格"
)
EXPLICIT_DELEGATION = (
    r"(?iu)你决定|你来定|看着办|直接做|你判断|由你决定|you decide|use your judgment|go ahead"
    r"|decide for me"
)
PATCH_TYPES = (
    "setText", "setDataCell", "moveNode", "cloneNode", "deleteNode", "replaceAsset",
)

# --- files allowed as stage inputs, and their kinds ------------------------------
ALLOWED_SOURCE_FILES = (
    "readable-source.md", "fact-ledger.json", "source-map.json", "tables-and-datasets.json",
    "asset-contact-sheet.html", "extraction-warnings.json",
)
ALLOWED_FILE_KINDS = (
    ("interview.json", "interview"),
    ("content-brief.json", "content-brief"),
    ("manifest.json", "content-brief"),
)
ALLOWED_PREFIX_KINDS = (
    ("assets/", "visual-reference"),
    ("visual-references/", "visual-reference"),
)

# Patterns of the page rules Q-03 to Q-05; ATTRIBUTE and VALUE stand for what a caller asks for.
ELEMENT_WITH = (
    r"(?i)<([a-z][\w-]*)\b([^>]*\bATTRIBUTE\s*=\s*[\"']([^\"']+)[\"'][^>]*)>([\s\S]*?)</\1>"
)
TAG_WITH = r"(?i)<[a-z][^>]*\bATTRIBUTE\s*=\s*[\"']VALUE[\"'][^>]*>"
VALUE_OF = r"(?i)\b(?:ATTRIBUTE)\s*=\s*[\"']([^\"']+)[\"']"
CHART_PAYLOAD = (
    r"(?i)<script\b[^>]*\bdata-chart-data-for\s*=\s*[\"']([^\"']+)[\"'][^>]*>([\s\S]*?)</script>"
)

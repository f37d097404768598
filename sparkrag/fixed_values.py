"""Fixed values.

Everything in this file is a constant that has to have exactly this value for results to agree
with the published behaviour: closed label sets, word lists, thresholds, regular expressions and
output texts.  It holds data only; the logic that uses it lives in ``functions`` and ``operators``.
Patterns are written in Java regex syntax because Spark evaluates them; each is held whole.
"""

# --- character classes -------------------------------------------------------------------------
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGIT = r"\p{Nd}"
WORDCH = r"[\p{L}\p{N}_]"
CJK = r"\x{4e00}-\x{9fff}"
THAI = r"\x{e00}-\x{e7f}"

# --- text normalization ------------------------------------------------------------------------
ZERO_WIDTH_CHARS = "​‌‍⁠﻿"
EDGE_CHARS = " \t\r\n\u3000。，、；：,;:~～"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"

# --- parser residue ----------------------------------------------------------------------------
RESIDUE_KEYS = (
    "bbox|type|content|index|angle|lines|spans|blocks|para_blocks|page_idx"
    "|page_size|discarded_blocks|image_path|sub_type|html|text_level|score"
)
RESIDUE_TYPE_VALUES = (
    "text|title|list|table|image|figure|inline_equation|interline_equation"
    "|table_caption|image_caption|table_footnote|image_body|table_body"
    "|index|algorithm|code|equation|header|footer|page_number|discarded"
    "|ref_text|caption|footnote|title_level|content_list|abstract|formula"
)
RESIDUE_BODY_WORDS = "image_body|table_body|para_blocks|discarded_blocks"
HTML_TABLE_TAG = r"(?i)</?(?:table|tr|td|th|thead|tbody)\b[^>]*>"
HTML_ANY_TAG = r"</?[a-zA-Z][^>]{0,60}>"
HTML_ENTITY = r"&(?:#x?[0-9a-fA-F]+|amp|quot|lt|gt|nbsp|apos);"
URL = r"https?://[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TABLE_MARK = r"(?i)</?t[dhr]\b|</?table\b"
RESIDUE_BBOX = rf"\{{?{WS}*['\"]bbox['\"]{WS}*:{WS}*\[[^\]]*\]{WS}*,?"
RESIDUE_SCALAR = (rf"['\"](?:{RESIDUE_KEYS})['\"]{WS}*:{WS}*"
                  rf"(?:-?\p{{Nd}}+(?:\.\p{{Nd}}+)?|true|false|null|None|True|False){WS}*,?")
RESIDUE_KEY = rf"['\"](?:{RESIDUE_KEYS})['\"]{WS}*:{WS}*"
RESIDUE_MARK = rf"['\"](?:{RESIDUE_KEYS})['\"]{WS}*:"
RESIDUE_TYPE = rf"['\"](?:{RESIDUE_TYPE_VALUES})['\"]"
RESIDUE_BODY = rf"(?<!{WORDCH})(?:{RESIDUE_BODY_WORDS})(?!{WORDCH})"
STRUCT_PUNCT = (rf"[\[\]{{}}]+|(?<![{CJK}\p{{L}}\p{{N}}_])['\"](?![{CJK}\p{{L}}\p{{N}}_])")
# The published form repeats a group, which Java evaluates by recursion: 1500 commas in a row
# overflow the stack.  Runs of the mark and white space with two marks and more say the same.
ORPHAN_PUNCT = (rf"{WS}*,[,{WS[1:-1]}]*,{WS}*|{WS}*'['{WS[1:-1]}]*'{WS}*")
QUOTED_VALUE = rf"'{WS}*([^']{{1,40}}?){WS}*'"
LONE_QUOTE = rf"(?<![{CJK}A-Za-z])'|'(?![{CJK}A-Za-z])"
BARE_BBOX = (
    rf"(?<![\p{{Nd}}.%℃×~-]){WS}\p{{Nd}}{{1,4}}{WS}*,{WS}*\p{{Nd}}{{1,4}}"
    rf"(?:{WS}*,{WS}*\p{{Nd}}{{1,4}}){{1,3}}{WS}*(?![\p{{Nd}}.]*{WS}*"
    r"(?:kg|g|mm|cm|m|km|%|℃|天|日|月|年|次|倍|亩|株|个|米|厘米|毫米))"
)
# LaTeX residue: pattern and replacement, in this order.
LATEX_MEASURES = [
    (rf"(?i)(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WS}*\\+mathrm\{{(mm|cm|m|km|kg|g|mg|L|mL|ha)\}}", "$1 $2"),
    (rf"(?i)(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WS}*\\+sim{WS}*(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WS}*"
     rf"(?:\^\{{\\+circ\}})?{WS}*\\+mathrm\{{C\}}", "$1–$2℃"),
    (rf"(?i)(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WS}*(?:\^\{{\\+circ\}})?{WS}*\\+mathrm\{{C\}}", "$1℃"),
    (r"\\+sim", "~"), (r"\\+times", "×"), (r"\\+cdot", "·"), (r"\\+pm", "±"),
    (rf"\\+mu(?!{WORDCH})", "μ"),
    (r"\\geqslant", "≥"), (r"\\leqslant", "≤"),
    (rf"\\+(?:mathrm|mathbf|mathbb|text|tag|rightharpoon|circ)(?!{WORDCH})", " "),
]
LATEX_ESCAPE = (r"\\+([%&#_$])", "$1")
LATEX_PERCENT = rf"(\p{{Nd}}+(?:\.\p{{Nd}}+)?){WS}*\\+%"
TEMPERATURE_WORDS = ("温度", "低温", "高温", "积温", "摄氏", "temperature")
RESIDUE_EDGE_CHARS = " ,;'\""
LETTERS = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{e00}-\x{e7f}A-Za-z]"
DIGIT_CHARS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
# All but line ends, bars, 。 and ；.  Java takes five times as long for the class that excludes them.
CAPTION_CHARS = r"[\x00-\x09\x0b-\x7b\x7d-\x{3001}\x{3003}-\x{ff1a}\x{ff1c}-\x{10ffff}]"
CAPTION_LABEL = (rf"(?:表|图|附表|Table|Fig(?:ure)?){WS}*[\p{{Nd}}IVX]{{1,3}}(?:[-–—.]\p{{Nd}}{{1,3}})?"
                 rf"[.:：{WS[1:-1]}]{{0,3}}")
CAPTION = rf"({CAPTION_LABEL})({CAPTION_CHARS}{{4,70}})"
CAPTION_BOUNDARY = (rf"(?![A-Za-z])(?:{WS}(?:{WS}|\p{{Nd}}{{2,}})|\p{{Nd}}+\.\p{{Nd}}+|\){WS}*[.。])")
CAPTION_START = rf"^(?:表|图|附表|Table|Fig(?:ure)?){WS}*[\p{{Nd}}IVX]"
CAPTION_HEAD = (rf"^(?:表|图|附表|Table|Fig(?:ure)?){WS}*[\p{{Nd}}IVX]+(?:[-–—.]\p{{Nd}}+)?"
                rf"[.:：{WS[1:-1]}]*")

# --- corpus thresholds -------------------------------------------------------------------------
MIN_CHUNK_CHARS = 60
MIN_CLEAN_CHARS = 20
GRADE_MIN_WORD_RATIO = 0.55
GRADE_MAX_DIGIT_RATIO = 0.35
BODY_MIN_WORD_RATIO = 0.5
CORPUS_CHUNK_SIZE, CORPUS_CHUNK_OVERLAP = 900, 150
DEDUP_KEY_CHARS = 400
RAW_FRAGMENT_CHARS = 1200
TABLE_HEAD_CHARS, TABLE_TEXT_CHARS = 120, 2400
SPARSE_CHARS_PER_TEN_PAGES = 200
FAQ_DOC = r"^FAQ_(en|zh|th|ms)_\d+$"
DAMAGED_TABLE_NOTE = "（注：该表格在历史数据中已损坏，表头丢失，数值不可引用）"
TABLE_PREFIX = "【表格】"

# --- blocks and section chunks -----------------------------------------------------------------
BLOCK_TYPES = ("text", "title", "table", "image", "scan_page")
BLOCK_TYPE_NAMES = {
    "text": "text", "paragraph": "text", "body": "text",
    "title": "title", "header": "title", "section_header": "title",
    "table": "table", "tbl": "table",
    "image": "image", "img": "image", "figure": "image",
    "scan_page": "scan_page", "page_image": "scan_page",
}
MD_TABLE_LINE = r"(?m)^\s*\|.+\|\s*$"
IMAGE_PATH = r"(?i)\.(?:jpg|jpeg|png|webp|tif|tiff|bmp)\b|^data:image/|^!\["
SENTENCE_ENDINGS = "。.！!？?；;：:"
NUMBERED_TITLE = (
    r"^(?:第?[一二三四五六七八九十百\p{Nd}]+[章节部分篇.、\s]|[IVX]+\.|\p{Nd}+\.\p{Nd}*\s)"
)
SECTION_CHUNK_SIZE, SECTION_OVERLAP_RATIO, SECTION_MIN_TAIL = 800, 0.15, 150
PARAGRAPH_GAP_FACTOR = 1.5
OCR_LINE_HEIGHT = 20

# --- labels ------------------------------------------------------------------------------------
INTENTS = (
    "disease_diagnosis", "pest_diagnosis", "disease_control", "pest_control", "fertilization",
    "irrigation", "nutrient_diagnosis", "flowering_management", "fruit_management", "pruning",
    "soil_management", "weather_risk", "harvest", "variety_query", "general_knowledge",
    "asset_query", "alarm_query", "task_create", "task_query", "task_update",
)
INTENT_ALIASES = {"irrigation_decision": "irrigation"}
GROWTH_STAGES = (
    "seedling", "vegetative", "pre_flowering", "flowering", "fruit_set", "fruit_development",
    "pre_harvest", "harvest", "post_harvest", "unknown",
)
STAGE_TERMS = [
    ("花芽分化", "pre_flowering"), ("花芽诱导", "pre_flowering"), ("花芽", "pre_flowering"),
    ("pre-flowering", "pre_flowering"), ("pre flowering", "pre_flowering"),
    ("诱导开花", "pre_flowering"),
    ("开花期", "flowering"), ("盛花期", "flowering"), ("花期", "flowering"), ("开花", "flowering"),
    ("anthesis", "flowering"), ("flowering", "flowering"), ("ออกดอก", "flowering"),
    ("berbunga", "flowering"),
    ("坐果期", "fruit_set"), ("坐果", "fruit_set"), ("幼果期", "fruit_set"), ("谢花后", "fruit_set"),
    ("fruit set", "fruit_set"), ("fruit-set", "fruit_set"),
    ("果实发育", "fruit_development"), ("膨果期", "fruit_development"),
    ("果实膨大", "fruit_development"), ("fruit development", "fruit_development"),
    ("苗期", "seedling"), ("幼苗期", "seedling"), ("幼苗", "seedling"), ("seedling", "seedling"),
    ("ต้นกล้า", "seedling"),
    ("营养生长期", "vegetative"), ("营养生长", "vegetative"), ("抽梢", "vegetative"),
    ("vegetative", "vegetative"), ("flushing", "vegetative"),
    ("采前期", "pre_harvest"), ("采前", "pre_harvest"), ("pre-harvest", "pre_harvest"),
    ("pre harvest", "pre_harvest"),
    ("采收期", "harvest"), ("收获期", "harvest"), ("采收", "harvest"), ("harvesting", "harvest"),
    ("harvest", "harvest"), ("เก็บเกี่ยว", "harvest"), ("menuai", "harvest"),
    ("采后处理", "post_harvest"), ("采后", "post_harvest"), ("后熟", "post_harvest"),
    ("post-harvest", "post_harvest"), ("post harvest", "post_harvest"),
    ("ripening", "post_harvest"), ("การบ่ม", "post_harvest"), ("pascapanen", "post_harvest"),
]
ENTITY_SLOTS = ("cultivar", "orchard", "plot", "fertilizer", "pesticide", "disease", "pest")
PLANT_PARTS = ("root", "trunk", "stem", "branch", "leaf", "flower", "fruit", "seed", "shoot",
               "whole_plant")
ENVIRONMENT_KEYS = ("rainfall", "soil_moisture", "temperature", "humidity", "drainage")
RISK_FLAGS = (
    "diagnosis_requested", "dosage_requested", "pesticide_related", "regulation_related",
    "weather_dependent", "realtime_data_required", "domain_knowledge_required",
    "business_action_required",
)

# --- terminology -------------------------------------------------------------------------------
TERM_META_KEYS = ("_note", "_meta", "_purpose")
CATEGORY_PREFIX_TYPE = {
    "variety_thai": ("CULTIVAR", "cultivar"),
    "variety_malaysia": ("CULTIVAR", "cultivar"),
    "variety_indonesia": ("CULTIVAR", "cultivar"),
    "disease": ("DISEASE", "disease"),
    "pest": ("PEST", "pest"),
    "nutrient": ("NUTRIENT", "nutrient"),
    "phenology": ("PHENOLOGY", "phenology"),
    "cultivation": ("CULTIVATION", "cultivation"),
    "postharvest": ("POSTHARVEST", "postharvest"),
    "plant_organ": ("PLANT_ORGAN", "plant_organ"),
    "symptom": ("SYMPTOM", "symptom"),
    "malay_common": ("MALAY_COMMON", "malay_common"),
    "fruit_identity": ("FRUIT", "fruit_identity"),
}
SLOT_BY_TYPE = {"cultivar": "cultivar", "disease": "disease", "pest": "pest",
                "nutrient": "fertilizer"}
MALAY_CATEGORY, SYMPTOM_CATEGORY = "malay_common", "symptom"
ORCHARD_PATTERNS = [r"(?i)orchard\s*[-_]?\s*(\p{Nd}+)", r"(\p{Nd}+)\s*号园",
                    r"สวน\s*(?:ที่\s*)?(\p{Nd}+)"]
PLOT_PATTERNS = [r"(?i)plot\s*[-_]?\s*(\p{Nd}+)", r"(\p{Nd}+)\s*号地块",
                 r"แปลง\s*(?:ที่\s*)?(\p{Nd}+)", r"(?i)petak\s*(\p{Nd}+)"]

# --- rule intents and risk patterns ------------------------------------------------------------
RULE_INTENTS = [
    ("task_create", [
        "(创建|新建|帮我建|建一个).{0,8}(工单|任务)", "(?i)create.{0,15}task",
        "(?i)buat.{0,12}tugasan", "(สร้าง|เปิด).{0,12}(งาน|ใบสั่งงาน)"]),
    ("task_update", [
        r"(工单|任务)\s*\p{Nd}*\s*(号)?\s*(改|更新|标记|完成|取消|关闭|设为)",
        "(把|将).{0,10}(工单|任务).{0,10}(改|更新|完成|取消|关闭)",
        "(?i)(mark|update|set).{0,12}task.{0,15}(completed|done|status)",
        "(?i)kemaskini.{0,12}tugasan"]),
    ("task_query", [
        "(查询|查一下|查看|看看).{0,6}(工单|任务)", "(工单|任务).{0,6}(状态|进度|列表)",
        "(?i)(check|show|list).{0,20}tasks?", "(?i)semak.{0,10}tugasan"]),
    ("alarm_query", ["(告警|报警|警报)", "(?i)alarms?", "การแจ้งเตือน", "(?i)amaran"]),
    ("asset_query", [
        "(传感器|设备|资产).{0,6}(有|多少|列表|清单|几)",
        "(有多少|几台|几个|多少台|多少个).{0,4}(传感器|设备|资产)",
        "(?i)(list|show).{0,12}(devices?|sensors?|assets?)",
        "(?i)senarai.{0,12}(peralatan|aset)"]),
]
DOSE = (r"(?i)\p{Nd}+\s*(?:ml|kg|ppm|กรัม|มิลลิลิตร|ลิตร|克|毫升|升|g|l)(?![a-z0-9])"
        "|浓度|剂量|稀释|dosage|dilution")
PESTICIDE = ("(?i)农药|杀虫剂|杀菌剂|除草剂|喷药|用药"
             "|pesticides?|insecticides?|fungicides?|herbicides?|spray"
             "|ยาฆ่าแมลง|ยากำจัด|racun perosak|racun serangga|racun kulat")
REGULATION = ("(?i)法规|标准|规程|sop|出口|食品安全|检疫|regulations?|standards?|export|food safety"
              "|มาตรฐาน|piawaian|eksport|keselamatan makanan")
WEATHER = ("(?i)天气|下雨|降雨|下雨了|雨季|台风|weather|rain|forecast"
           "|ฝน|อากาศ|พยากรณ์|hujan|cuaca")
REALTIME = ("(?i)传感器|实时|当前土壤|现在的|此刻|sensors?|real[- ]?time|live data|soil moisture"
            "|เซ็นเซอร์|ความชื้นในดินตอนนี้|sensor|kelembapan tanah sekarang")
BUSINESS_ACTION = ("(?i)创建|新建|帮我建|帮我安排|安排(?:一次|一个|巡检|排水|施肥)"
                   "|create.{0,20}task|schedule.{0,12}(?:task|inspection)"
                   "|สร้าง.{0,8}งาน|เปิดงาน|buat.{0,10}tugasan|jadualkan")
DIAGNOSIS = ("(?i)是什么病|得了什么|什么病害|什么虫|缺什么|怎么诊断"
             "|diagnose|what (?:disease|pest|deficiency)|เป็นโรคอะไร|โรคอะไร|penyakit apa|kenapa")
# Words of which a text holds at least one, in lower case, wherever the pattern matches; of several groups
# it holds one each.  Looking for them first spares most texts the pattern.
_ASSETS = ("传感器", "设备", "资产")
NEEDS = {
    **dict(zip([p for _, ps in RULE_INTENTS for p in ps], [
        [("工单", "任务")], [("create",), ("task",)], [("tugasan",)], [("สร้าง", "เปิด")],
        [("工单", "任务")], [("工单", "任务")], [("task",), ("completed", "done", "status")],
        [("kemaskini",)],
        [("工单", "任务")], [("工单", "任务")], [("task",), ("check", "show", "list")], [("semak",)],
        [("告警", "报警", "警报")], [("alarm",)], [("การแจ้งเตือน",)], [("amaran",)],
        [_ASSETS], [_ASSETS], [("device", "sensor", "asset"), ("list", "show")], [("senarai",)],
    ], strict=True)),
    PESTICIDE: [("农药", "杀虫剂", "杀菌剂", "除草剂", "喷药", "用药", "pesticide", "insecticide", "fungicide",
                 "herbicide", "spray", "ยาฆ่าแมลง", "ยากำจัด", "racun")],
    REGULATION: [("法规", "标准", "规程", "sop", "出口", "食品安全", "检疫", "regulation", "standard", "export",
                  "food safety", "มาตรฐาน", "piawaian", "eksport", "keselamatan makanan")],
    WEATHER: [("天气", "下雨", "降雨", "雨季", "台风", "weather", "rain", "forecast", "ฝน", "อากาศ",
               "พยากรณ์", "hujan", "cuaca")],
    REALTIME: [("传感器", "实时", "当前土壤", "现在的", "此刻", "sensor", "realtime", "real-time", "real time",
                "live data", "soil moisture", "เซ็นเซอร์", "ความชื้นในดินตอนนี้", "kelembapan tanah")],
    BUSINESS_ACTION: [("创建", "新建", "帮我建", "安排", "create", "schedule", "สร้าง", "เปิดงาน", "tugasan",
                       "jadualkan")],
    DIAGNOSIS: [("是什么病", "得了什么", "什么病害", "什么虫", "缺什么", "怎么诊断", "diagnose", "what disease",
                 "what pest", "what deficiency", "โรคอะไร", "penyakit apa", "kenapa")],
}
DIAGNOSIS_INTENTS = ("disease_diagnosis", "pest_diagnosis", "nutrient_diagnosis")
BUSINESS_WRITE_INTENTS = ("task_create", "task_update")
KNOWLEDGE_INTENTS = (
    "disease_diagnosis", "pest_diagnosis", "disease_control", "pest_control", "fertilization",
    "irrigation", "nutrient_diagnosis", "flowering_management", "fruit_management", "pruning",
    "soil_management", "weather_risk", "harvest", "variety_query",
)

# --- routing and evidence gate -----------------------------------------------------------------
COMPLEX_FLAGS = ("business_action_required", "realtime_data_required")
TOOL_INTENTS = ("asset_query", "alarm_query", "task_create", "task_query", "task_update")
EVIDENCE_FLAGS = ("pesticide_related", "dosage_requested", "regulation_related",
                  "diagnosis_requested")
EVIDENCE_INTENTS = ("disease_diagnosis", "pest_diagnosis", "nutrient_diagnosis",
                    "disease_control", "pest_control")
GATE_INTENTS = (
    "disease_diagnosis", "pest_diagnosis", "nutrient_diagnosis", "disease_control",
    "pest_control", "fertilization", "irrigation", "flowering_management", "fruit_management",
    "soil_management",
)

# --- chunk records -----------------------------------------------------------------------------
DOMAIN_BY_SLOT = [("disease", "plant_protection"), ("pest", "plant_protection"),
                  ("fertilizer", "fertilization"), ("cultivar", "variety")]
DOMAIN_KEYWORDS = [
    ("fertilization", ("施肥", "肥料", "fertiliz", "ใส่ปุ๋ย", "baja")),
    ("irrigation", ("灌溉", "浇水", "irrigat", "watering", "ให้น้ำ", "siram")),
    ("plant_protection", ("病害", "虫害", "农药", "disease", "pest", "โรค", "penyakit")),
    ("flowering_management", ("开花", "花期", "flowering", "ออกดอก", "berbunga")),
    ("fruit_management", ("果实", "坐果", "fruit set", "ผล", "buah")),
    ("pruning", ("修剪", "整枝", "pruning", "ตัดแต่ง", "pangkas")),
    ("soil_management", ("土壤", " acidity", "soil", "ดิน", "tanah")),
    ("harvest", ("采收", "收获", "harvest", "เก็บเกี่ยว", "tuai")),
    ("postharvest", ("采后", "后熟", "postharvest", "ripening", "การบ่ม", "pascapanen")),
]
SOURCE_TYPE_BY_PROVENANCE = {"legacy_faq": "faq", "legacy_thai": "document",
                             "legacy_lit_salvage": "literature", "pdf_parse": "document"}
DEFAULT_ROLE_SCOPE = ("worker", "manager")
ALL_ORCHARDS = "ALL"
SEARCH_TABLE_WIDTHS = {"chunk_id": 63, "tenant_id": 63, "text": 4095, "document_id": 511,
                       "language": 7, "domain": 63, "source_type": 31}
SEARCH_TABLE_SLICES = {"role_scope": 8, "orchard_scope": 16}

# --- retrieval ---------------------------------------------------------------------------------
STOPWORDS = ("the", "a", "an", "of", "for", "and", "or", "is", "are", "to", "in", "on", "how",
             "what", "do", "i", "my", "me")
LATIN_TOKEN = r"[a-z][a-z0-9_.-]+"
MAX_TOKENS = 120
BM25_K1, BM25_B = 1.5, 0.75
DENSE_MIN_SCORE = 0.3
ROUTES = ("dense_original", "dense_canonical", "bm25_original", "bm25_expanded")
RRF_WEIGHTS = {"dense_original": 0.20, "dense_canonical": 0.30, "bm25_original": 0.15,
               "bm25_expanded": 0.35}
RRF_K = 60
RERANK_MIN_SCORE, RERANK_TOP_K, RERANK_PASSAGE_CHARS = 0.3, 5, 512
EVIDENCE_TOP_N = 8
MIN_EVIDENCE_DOCS = 2
MAX_RETRIEVALS = 2
REQUIRED_SLOTS = ("cultivar", "disease", "pest", "fertilizer", "pesticide")
NUMERIC_CONDITION = (r"(?i)\p{Nd}+\s*(?:ml|kg|ppm|กรัม|มิลลิลิตร|ลิตร|克|毫升|升|g|l)(?![a-z0-9])"
                     "|浓度|剂量|稀释")
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
REASON_NO_EVIDENCE = "无任何证据"
REASON_ENTITY = "关键实体未覆盖: "
REASON_SYMPTOM = "核心症状词未被证据覆盖: "
REASON_NO_NUMBER = "查询含数值条件但证据无任何数字"
REASON_CONFLICT = ("证据数值与查询条件 ", " 不一致，疑来源冲突")
REASON_SINGLE = ("证据单点（", " 份），不足以支撑专业结论")
CITATION = r"\[([A-Za-z0-9_\-]+)\]"

# --- dialogs -----------------------------------------------------------------------------------
RECENT_MESSAGES = 16
SUMMARY_CHARS = 6000
SMALLTALK = ("谢谢", "你好", "好的", "嗯", "好", "ok", "okay", "hi", "hello")
SUMMARY_USER, SUMMARY_ASSISTANT, SUMMARY_TOOL = "用户问：", "回答要点：", "工具结果："
SUMMARY_USER_CHARS, SUMMARY_ASSISTANT_CHARS, SUMMARY_TOOL_CHARS, REPEAT_KEY_CHARS = 60, 80, 60, 40
TOKEN_CLASS = r"[\x{2e80}-\x{9fff}\x{e00}-\x{e7f}\x{f900}-\x{faff}]"
BUDGET_TOTAL = 8000
BUDGET_RATIOS = {"system": 0.10, "summary": 0.15, "history": 0.25, "rag": 0.35, "query": 0.05,
                 "output": 0.10}
SECTION_MARKERS = {"summary": "【会话摘要】", "history": "【最近对话】",
                   "business_state": "【当前业务状态】", "query": "【当前问题】"}
ROLE_NAMES = {"user": "用户", "assistant": "助手", "tool": "工具"}
ROLE_NAME_OTHER, RENDER_CHARS = "消息", 300
TOOL_OMITTED = "[工具输出已省略]"
STATE_ENTITIES, STATE_STAGE, STATE_PENDING = "涉及实体：", "生育阶段：", "待确认操作："

# --- evaluation --------------------------------------------------------------------------------
COVERAGE_TYPES = ("text", "table", "image", "scan_page")
COVERAGE_BY_BLOCK = {"text": "text", "qa_pair": "text", "table": "table", "image": "image",
                     "scan_page": "scan_page"}
ABSTAIN_MARKERS = ("暂无足够", "没有提供足够", "无法回答", "证据不足",
                   "not provide enough evidence", "insufficient evidence")
FAILURE_MARKERS = [
    ("LLM_TOKEN_OVERFLOW", ("token", "overflow", "上下文长度", "context length")),
    ("SUMMARY_FAILED", ("摘要失败", "summary fail")),
    ("MODEL_CONTEXT_ERROR", ("context window", "最大上下文")),
    ("NO_RESPONSE", ("未能完成", "未生成", "不可用", "无法解析")),
]
LANGUAGES = ("zh", "en", "th", "ms")
JUDGE_SCORE = r"(?<![\p{L}\p{N}_])(0(?:\.\p{Nd})?|1(?:\.0)?)(?![\p{L}\p{N}_])"
IMAGE_TEXT_LABELS = ("图中文字：", "农业语义：")

# --- operations --------------------------------------------------------------------------------
ROLES = ("worker", "manager", "admin")
ROLE_TOOLS = {
    "worker": ("agriculture_rag", "asset_query", "task_query"),
    "manager": ("agriculture_rag", "asset_query", "task_query", "task_create", "task_update",
                "weather", "sensor"),
}
EVERYONE_TOOL = "user_context"
CONTEXT_LANGUAGES = ("auto", "zh", "en", "th", "ms")
TASK_STATUSES = ("pending", "in_progress", "done", "cancelled")
TASK_PRIORITIES = ("low", "normal", "high")
TASK_ERRORS = {
    "title": "参数错误: title 必填",
    "priority": "参数错误: priority 需为 low/normal/high",
    "task_id": "参数错误: task_id 必填",
    "status": "参数错误: status 需为 ['pending', 'in_progress', 'done', 'cancelled'] 之一",
    "patch": "参数错误: 至少提供 status/assignee/title/description 之一",
}
PATCH_FIELDS = ("status", "assignee", "title", "description")
ASSET_TYPES = {"orchards": "orchard", "plots": "plot", "devices": "device", "workers": "worker",
               "orchard": "orchard", "plot": "plot", "device": "device", "worker": "worker"}
LOOKUP_ROWS = 20
FORECAST_DEFAULT_DAYS, FORECAST_MAX_DAYS, FORECAST_DEFAULT_LOCATION = 3, 7, "DEFAULT"
PENDING_PREFIX = "PENDING_CONFIRMATION: "
ERROR_OBSERVATION_PREFIXES = ("工具执行失败", "权限不足", "工具不存在")
TRACE_KEEP, TRACE_DOCS = 1000, 10
TIMEOUT_MESSAGE = r"(?i)timeout|timed?\s*out"
OVERFLOW_MESSAGE = (r"(?i)maximum\s+context|token.{0,10}limit|context.{0,10}(length|window)"
                    r"|too\s+many\s+tokens")
ERROR_STRATEGIES = {
    "RAG_NO_RESULT": ("rewrite", "rag_rewrite", None),
    "RAG_LOW_CONFIDENCE": ("evidence_check", None, None),
    "TOOL_TIMEOUT": ("retry_once", "tool", "fallback"),
    "TOOL_PERMISSION_DENIED": ("direct_reply", None, None),
    "TOOL_INVALID_ARGUMENT": ("direct_reply", None, None),
    "LLM_TIMEOUT": ("retry", "llm", None),
    "LLM_TOKEN_OVERFLOW": ("memory_degrade", None, None),
    "SUMMARY_FAILED": ("memory_degrade", None, None),
    "TASK_CREATE_FAILED": ("idempotent_retry", "tool", None),
}
DEFAULT_STRATEGY = ("retry_once", None, None)

# --- Thai repair -------------------------------------------------------------------------------
THAI_SUSPECT = (r"[ํ๎˚˙]|[่-๋][ิ-ื]"
                r"|([่-๋])\1")
THAI_DOUBLE_TONE = r"([่-๋])\1า|า([่-๋])\2"
THAI_SHIFTED_FONT = (r"๎|[˚˙]า|(?<=[฀-๿])[˚˙]"
                     r"|[˚˙](?=[฀-๿])")
THAI_LONE_NIKHAHIT = r"ํ(?!า)"
THAI_CLEAN_TONE = r"[่้]"
THAI_WORD_FIXES = {
    "ไฟทอปธอรํา":
        "ไฟทอปธอรา",
    "ไฟทอบธอรํา":
        "ไฟทอปธอรา",
}
THAI_TONE_BEFORE_VOWEL = r"([่-๋])([ิ-ื])"
THAI_STACKED_AM = r"ํ([่-๋])า"
THAI_HALF_AM = (r"[˚˙]า|(?<=[฀-๿])[˚˙]"
                r"|[˚˙](?=[฀-๿])")

# --- route reasons -----------------------------------------------------------------------------
ROUTE_REASONS = {
    "complex_flags": ("risk_flags=", "（实时数据/业务操作→ReAct 编排）"),
    "tool_intents": ("intent=", " 需要业务工具（资产/告警/工单→ReAct）"),
    "evidence_flags": ("risk_flags=", "（高风险结论须证据支撑）"),
    "evidence_intents": ("intent=", " ∈ 诊断防治类标签（§13 默认强制 RAG）"),
    "entities": ("entities=", " 涉及植保专业内容（§13 专业诊断，安全侧）"),
    "simple": ("intent=", " 普通问题，直接 LLM（可选 RAG）"),
}
